from datetime import datetime, timedelta
from threading import Event

from roomscope.sources import blobs, schemas
from roomscope.streaming import messages


def test_objects_and_sinks(spark, tmp_path):
    (tmp_path / "b/p").mkdir(parents=True)
    (tmp_path / "b/p/x.jpg").write_bytes(b"abc")
    listed = blobs.objects(spark, str(tmp_path / "b"))
    assert [r.length for r in blobs.listing(spark, str(tmp_path / "b")).collect()] == [3]
    keys = spark.createDataFrame([("p/x.jpg",), ("p/y.jpg",)], "k string")
    assert {tuple(r) for r in blobs.with_existence(keys, "k", listed, str(tmp_path / "b")).collect()} == {("p/x.jpg", True), ("p/y.jpg", False)}
    keys = spark.createDataFrame([("s3://bucket/p/x.jpg",), ("x.jpg",), (None,)], "path string")
    for folder in (f"{tmp_path}/b", f"file://{tmp_path}/b/"):
        assert {tuple(r) for r in blobs.with_existence(keys, "path", listed, folder).collect()} == {("s3://bucket/p/x.jpg", True), ("x.jpg", False), (None, False)}
    assert [r.value for r in blobs.decoded(listed, lambda b: len(b), "int").collect()] == [3]
    assert [r.value for r in blobs.decoded(listed, lambda b: 1 / 0, "int").collect()] == [None]
    made = spark.createDataFrame([("q/z.bin", bytearray(b"12345")), (None, bytearray(b"1"))], "k string, c binary")
    assert [r.key for r in blobs.write_blobs(made, "k", "c", str(tmp_path / "b")).collect()] == ["q/z.bin"]
    assert (tmp_path / "b/q/z.bin").read_bytes() == b"12345"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, x string")
    for _ in range(2):
        blobs.replace_parts(df, str(tmp_path / "t"), "job_id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    blobs.append(df, str(tmp_path / "t"), "job_id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert blobs.to_messages(df).where("value like '%job_id%'").count() == 2


def test_messages(spark):
    raw = spark.createDataFrame([('{"project_id":"p"}',), ('{"project_id":"p","action":"cancel"}',), ("{",), (None,), ("{}",)], "body string")
    rows = messages.parse(raw).collect()
    assert [r.valid for r in rows] == [True, True, False, False, False]
    assert (rows[0].action, rows[0].enable_beat_sync) == ("run", True)
    assert messages.runnable(messages.parse(raw)).count() == 1


def test_formats_and_schemas(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", b\nnext'), (2, None)], "id long, t string")
    blobs.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in blobs.read_csv(spark, str(tmp_path / "c"), "id bigint, t string").collect()} == {tuple(r) for r in df.collect()}
    blobs.write_orc(df, str(tmp_path / "o"), "id")
    assert blobs.read_orc(spark, str(tmp_path / "o")).count() == 2
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION '{tmp_path}/w'")
    schemas.create_tables(spark, "shop")
    assert {t.name for t in spark.catalog.listTables("shop")} >= set(schemas.TABLES)
    schemas.drop_tables(spark, "shop")
    assert not {t.name for t in spark.catalog.listTables("shop")} & set(schemas.TABLES)
    spark.sql("DROP DATABASE shop CASCADE")


def _stream(spark, tmp_path, rows, schema, files=1):
    """A stream over files written one after the other."""
    folder = str(tmp_path / "in")
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_queue_to_table_and_rejects(spark, tmp_path):
    raw = _stream(spark, tmp_path, [(1, '{"project_id":"p"}'), (2, "{"), (3, '{"project_id":"q","action":"stop"}'), (4, '{"project_id":"q"}')], "id long, body string", 2)
    for _ in range(2):  # the second run finds nothing new
        messages.drain_to_table(messages.runnable(messages.parse(raw)), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4]
    bad = messages.rejected(messages.parse(spark.createDataFrame([("{",), ('{"project_id":"q","action":"stop"}',), ('{"project_id":"p"}',)], "body string")))
    assert sorted(r.reason for r in bad.collect()) == ["action stop", "no project"]


def test_a_failed_batch_comes_again(spark, tmp_path):
    stream, seen = _stream(spark, tmp_path, [(1,), (2,)], "id long"), []

    def handle(batch, n):
        seen.append(sorted(r.id for r in batch.collect()))
        if len(seen) == 1:
            raise RuntimeError("once")

    stop = Event()
    make = lambda: stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert messages.poll(make, stop, pause=0.1) == 1
    assert seen == [[1, 2], [1, 2]]
    stop.set()
    assert messages.poll(make, stop) == 0


def test_windows_late_rows_and_stream_join(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    day = timedelta(days=1)
    (tmp_path / "in").mkdir()
    for k, rows in enumerate([[(1, at(1)), (1, at(2))], [(1, at(72))], [(1, at(73))], [(1, at(3))], [(1, at(200))]]):
        spark.createDataFrame(rows, "k long, at timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/f{k}"))
    stream = spark.readStream.schema("k long, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    messages.drain_to_table(messages.windowed_counts(stream, "at", "k"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.start.date().toordinal() - at(0).date().toordinal(), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 2), (3, 2)}  # the row of hour 3 came too late
    batch = spark.createDataFrame([(1, at(30))], "k long, at timestamp")
    assert {r.start for r in messages.windowed_counts(batch, "at", "k", "2 days", slide="1 day").collect()} == {at(0), at(0) + day}
    left, right = (spark.createDataFrame(rows, "k long, at timestamp") for rows in ([(1, at(0)), (2, at(0))], [(1, at(1)), (1, at(3)), (2, at(-1))]))
    pairs = messages.joined(left.withColumnRenamed("at", "a"), right.withColumnRenamed("at", "b"), "k", "a", "b", "2 HOURS")
    assert [r.b for r in pairs.select("r.b").collect()] == [at(1)]
