"""Queries over single records, batches of work, edits, models, formats and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import models, tables
from ..operators import joins, stages
from ..session import shared_folder
from ..sources import blobs, schemas
from ..sources.tables import table
from ..streaming import messages


def _one(spark: SparkSession, root: str, name: str) -> DataFrame:
    return table(spark, root, name).dropDuplicates(["id"])


def job_lookup(spark: SparkSession, root: str, job_id: int = 13) -> DataFrame:
    """The status of one job; the equality reaches the scan."""
    return table(spark, root, "jobs").where(F.col("id") == job_id).limit(1).select(F.col("id").alias("job_id"), "project_id", "status", "current_phase", "error_message")


def first_job(spark: SparkSession, root: str) -> DataFrame:
    return joins.first_rows(table(spark, root, "jobs").select("id", "project_id"), 1, F.col("id"))


def error_text(spark: SparkSession, root: str) -> DataFrame:
    return _one(spark, root, "jobs").where("error_message is not null").select("id", F.substring("error_message", 1, 1000).alias("error"))


def job_photo_batch(spark: SparkSession, root: str) -> DataFrame:
    """All jobs with the ready photos of their projects, in one join; jobs without photos have 0."""
    ready = table(spark, root, "photos").where("status = 2").select("id", "project_id").distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("photos"))
    return _one(spark, root, "jobs").select("id", "project_id").join(ready, "project_id", "left").select(F.col("id").alias("job_id"), F.coalesce("photos", F.lit(0)).alias("photos"))


def missing_work(spark: SparkSession, root: str) -> DataFrame:
    """What is still to be computed per job: rows that have no vector, no label or override, no depth."""
    rows = _one(spark, root, "job_photos")
    no_label = F.coalesce(F.nullif("room_override", F.lit("")), F.nullif("room_label", F.lit(""))).isNull()
    count = lambda on, name: F.count(F.when(on, 1)).alias(name)
    return rows.groupBy("job_id").agg(count(F.col("embedding").isNull(), "embeddings"), count(no_label, "labels"), count(F.col("depth_variance").isNull(), "depths"))


def label_source(spark: SparkSession, root: str) -> DataFrame:
    """Whether a label comes from the override, stands already, or must come from the model."""
    kind = F.when(F.nullif("room_override", F.lit("")).isNotNull(), "override").when(F.nullif("room_label", F.lit("")).isNotNull(), "label").otherwise("model")
    return _one(spark, root, "job_photos").groupBy(kind.alias("source")).agg(F.count(F.lit(1)).alias("photos"))


def source_ids_csv(spark: SparkSession, root: str) -> DataFrame:
    return _one(spark, root, "clips").select("id", F.array_join("source_photo_ids", ",").alias("photos"))


def cluster_debug(spark: SparkSession, root: str) -> DataFrame:
    debug = F.to_json(F.struct(F.coalesce("image_count", F.lit(0)).alias("image_count"), "sfm_eligible"))
    return _one(spark, root, "room_clusters").select("id", debug.alias("debug"))


def clusters_per_job(spark: SparkSession, root: str) -> DataFrame:
    return _one(spark, root, "room_clusters").groupBy("job_id").agg(F.count(F.lit(1)).alias("clusters"))


def clip_hours_per_job(spark: SparkSession, root: str) -> DataFrame:
    return _one(spark, root, "clips").groupBy("job_id").agg(F.round(F.sum("duration"), 4).alias("seconds"), F.round(F.sum("duration") / 3600, 6).alias("hours"))


def depth_range(spark: SparkSession, root: str) -> DataFrame:
    """Least, largest, variance and deviation of each grid; in the JVM."""
    g = table(spark, root, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("g"))
    mean = F.aggregate("g", F.lit(0.0), lambda s, e: s + e) / F.size("g")
    g = g.withColumn("mean", mean)
    var = F.aggregate(F.transform("g", lambda e: (e - F.col("mean")) * (e - F.col("mean"))), F.lit(0.0), lambda s, e: s + e) / F.size("g")
    return g.select("vec_id", F.round(F.array_min("g"), 9).alias("low"), F.round(F.array_max("g"), 9).alias("high"), F.round(var, 9).alias("variance"), F.round(F.sqrt(var), 9).alias("deviation"))


def photo_groups(spark: SparkSession, root: str) -> DataFrame:
    """Photos with the id and size of their group of one job and label: the write of groups and the back-reference in one pass."""
    label = c.effective_label(F.col("room_override"), F.col("room_label"))
    rows = _one(spark, root, "job_photos").select("id", "job_id", label.alias("label"))
    return joins.grouped_ids(rows, "id", "job_id", "label").select("id", "group_id", "size")


def latest_event(spark: SparkSession, root: str) -> DataFrame:
    """The state of each user from the log of events."""
    return joins.latest_by(table(spark, root, "events"), "user_id", "event_type", "ts", "event_id")


def state_stream(spark: SparkSession, root: str) -> DataFrame:
    """The same by keyed state over a stream: the last row that each key gave out."""
    raw = spark.readStream.schema(table(spark, root, "events").schema).option("pathGlobFilter", "events*").parquet(root)
    states = messages.latest_states(raw.withColumn("at", F.col("ts").cast("timestamp")), "user_id", "event_type", "at")
    out = shared_folder(spark, "states")
    messages.drain(states, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), shared_folder(spark, "offsets"), "update")
    rows = spark.read.schema("key string, n bigint, last_value string").parquet(out)
    return rows.groupBy(F.col("key").cast("bigint").alias("user_id")).agg(F.max("n").alias("events"), F.max_by("last_value", "n").alias("event_type"))


def sliding_counts(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("at", F.col("ts").cast("timestamp"))
    counted = messages.windowed_counts(e, "at", "event_type", "2 days", "1 hour", "1 day")
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def view_to_purchase(spark: SparkSession, root: str) -> DataFrame:
    """Views and the user's purchases within an hour after, joined on buckets of time."""
    e = table(spark, root, "events").select("event_id", "user_id", "ts", "event_type")
    pairs = joins.within(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "ts", "ts", 3600)
    return pairs.select(F.col("l.event_id").alias("view_id"), F.col("r.event_id").alias("purchase_id"))


def beat_grid_snap(spark: SparkSession, root: str) -> DataFrame:
    """Start times moved to the nearest beat of their timeline."""
    grid = _one(spark, root, "timelines").where("size(beat_grid) > 0").select(F.col("id").alias("timeline_id"), "beat_grid")
    rows = _one(spark, root, "timeline_clips").where("in_time is not null and not isnan(in_time)").select("id", "timeline_id", "in_time")
    return rows.join(grid, "timeline_id").select("id", joins.nearest_of(F.col("beat_grid"), F.col("in_time")).alias("beat"))


def edited_timelines(spark: SparkSession, root: str) -> DataFrame:
    """Clips of timelines after edits, here made from their ids: every 7th removed, of those every 35th restored, every 5th trimmed, every 3rd moved to the front."""
    rows = _one(spark, root, "timeline_clips").where("in_time is not null and out_time is not null and not isnan(in_time) and not isnan(out_time)").select("id", "order_index", "in_time", "out_time")
    kinds = [(7, 1, "remove", 0.0), (35, 2, "restore", 0.0), (5, 3, "trim", 1.5), (3, 4, "move", 0.0)]
    edit = F.array(*[F.when(F.col("id") % k == 0, F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.lit(v).alias("value"))) for k, seq, op, v in kinds])
    edits = rows.select("id", F.explode(edit).alias("e")).where("e is not null").select("id", "e.seq", "e.op", "e.value")
    out = joins.fold_edits(rows, edits, "id")
    return out.select("id", "order_index", F.round("in_time", 6).alias("in_time"), F.round("out_time", 6).alias("out_time"))


def uncached_clips(spark: SparkSession, root: str) -> DataFrame:
    """Clips whose settings, by hash, no valid entry of a cache has; clips with an even id are the cache, valid for 30 days."""
    made = F.md5(F.concat_ws("|", F.coalesce("motion_type", F.lit("")), F.coalesce("model_used", F.lit("")), F.coalesce("job_id", F.lit(0)).cast("string")))
    rows = _one(spark, root, "clips").select("id", "loaded_at", made.alias("hash"))
    cached = rows.where("id % 2 = 0").select("hash", (F.col("loaded_at") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    return stages.not_cached(rows.where("id % 2 = 1"), cached, "hash", "2024-03-01 00:00:00").select("id", "hash")


def model_embedding(spark: SparkSession, root: str) -> DataFrame:
    """The vectors of a model that gives its input back, so that only the interface works: batches, one load per worker, unit length."""
    v = models.embedding(F.col("embedding"), lambda: lambda images: images, "echo")
    return table(spark, root, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


def user_event_map(spark: SparkSession, root: str) -> DataFrame:
    """Counts per kind as one map per user."""
    by = table(spark, root, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = by.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # one entry per kind
    return m.select("user_id", F.size(F.map_keys("m")).alias("kinds"), F.coalesce(F.element_at("m", F.lit("click")), F.lit(0)).alias("clicks"), F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("events"))


def approximate_users(spark: SparkSession, root: str) -> DataFrame:
    """Whether the sketch of distinct users per kind is within a tenth of the exact number."""
    by = table(spark, root, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("near"), F.count_distinct("user_id").alias("exact"))
    return by.select("event_type", "exact", (F.abs(F.col("near") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


def order_ranks(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    month = Window.partitionBy("o_custkey").orderBy(days).rangeBetween(-30, 0)
    return o.select("o_orderkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("share"), F.round(F.cume_dist().over(w), 9).alias("cumulative"), F.round(F.sum("o_totalprice").over(month), 2).alias("month_spend"), F.count(F.lit(1)).over(month).alias("month_orders"))


def allowed_motions(spark: SparkSession, root: str) -> DataFrame:
    """The entries of a comma list by a table function."""
    tables.register(spark)
    _one(spark, root, "room_clusters").createOrReplaceTempView("roomscope_clusters")
    return spark.sql("SELECT id, m.place, m.entry FROM roomscope_clusters, LATERAL split_list(allowed_motion_types) m")


def median_price(spark: SparkSession, root: str) -> DataFrame:
    """The median by an aggregate function over batches."""
    return table(spark, root, "part").groupBy("p_brand").agg(F.round(tables.middle("p_retailprice"), 4).alias("median"))


def _trip(write, read):
    def run(spark: SparkSession, root: str) -> DataFrame:
        rows, path = table(spark, root, "customer").select("c_custkey", "c_name", "c_mktsegment"), shared_folder(spark, "trip")
        write(rows, path)
        return read(spark, path)

    return run


csv_round_trip = _trip(blobs.write_csv, lambda s, p: blobs.read_csv(s, p, "c_custkey bigint, c_name string, c_mktsegment string"))
orc_round_trip = _trip(blobs.write_orc, blobs.read_orc)


def object_existence(spark: SparkSession, root: str) -> DataFrame:
    """Which of some keys have an object below the folder of the tables."""
    keys = spark.createDataFrame([("region.parquet",), ("s3://tables/nation.parquet",), ("nothing.parquet",), ("parquet",)], "key string")
    return blobs.with_existence(keys, "key", blobs.objects(spark, root, "[rn]*.parquet"), root)


def declared_columns(spark: SparkSession, root: str) -> DataFrame:
    """Tables, with how many of their declared columns the files have under that name and type."""
    rows = []
    for name, ddl in schemas.TABLES.items():
        there = {f.name: f.dataType.simpleString() for f in table(spark, root, name).schema}
        wanted = dict(x.split(" ", 1) for x in ddl.split(", "))
        rows.append((name, len(wanted), sum(there.get(k) == v for k, v in wanted.items())))
    return spark.createDataFrame(rows, "table_name string, columns int, as_declared int")


QUERIES = {
    f.__name__: f
    for f in (job_lookup, first_job, error_text, job_photo_batch, missing_work, label_source, source_ids_csv, cluster_debug, clusters_per_job, clip_hours_per_job, depth_range, photo_groups, latest_event, state_stream, sliding_counts, view_to_purchase, beat_grid_snap, edited_timelines, uncached_clips, model_embedding, user_event_map, approximate_users, order_ranks, allowed_motions, median_price, object_existence, declared_columns)
} | {"csv_round_trip": csv_round_trip, "orc_round_trip": orc_round_trip}
_D = "(SELECT DISTINCT ON (id) * FROM {})"
_JP, _CLIPS, _JOBS, _RC, _TC, _TL = (_D.format(t) for t in ("job_photos", "clips", "jobs", "room_clusters", "timeline_clips", "timelines"))
_HASH = "md5(coalesce(motion_type, '') || '|' || coalesce(model_used, '') || '|' || CAST(coalesce(job_id, 0) AS VARCHAR))"
_CUSTOMER = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
SQL = {
    "job_lookup": "SELECT id AS job_id, project_id, status, current_phase, error_message FROM jobs WHERE id = 13 LIMIT 1",
    "first_job": "SELECT id, project_id FROM jobs ORDER BY id LIMIT 1",
    "error_text": f"SELECT id, left(error_message, 1000) AS error FROM {_JOBS} WHERE error_message IS NOT NULL",
    "job_photo_batch": f"SELECT j.id AS job_id, count(p.id) AS photos FROM {_JOBS} j LEFT JOIN (SELECT DISTINCT id, project_id FROM photos WHERE status = 2) p ON p.project_id = j.project_id GROUP BY j.id",
    "missing_work": f"SELECT job_id, count(*) FILTER (embedding IS NULL) AS embeddings, count(*) FILTER (coalesce(nullif(room_override, ''), nullif(room_label, '')) IS NULL) AS labels, count(*) FILTER (depth_variance IS NULL) AS depths FROM {_JP} GROUP BY 1",
    "label_source": f"SELECT CASE WHEN room_override <> '' THEN 'override' WHEN room_label <> '' THEN 'label' ELSE 'model' END AS source, count(*) AS photos FROM {_JP} GROUP BY 1",
    "source_ids_csv": f"SELECT id, array_to_string(source_photo_ids, ',') AS photos FROM {_CLIPS}",
    "cluster_debug": f"SELECT id, '{{\"image_count\":' || coalesce(image_count, 0) || ',\"sfm_eligible\":' || sfm_eligible || '}}' AS debug FROM {_RC}",
    "clusters_per_job": f"SELECT job_id, count(*) AS clusters FROM {_RC} GROUP BY 1",
    "clip_hours_per_job": f"SELECT job_id, round(sum(duration), 4) AS seconds, round(sum(duration) / 3600, 6) AS hours FROM {_CLIPS} GROUP BY 1",
    "depth_range": "SELECT vec_id, round(min(v), 9) AS low, round(max(v), 9) AS high, round(var_pop(v), 9) AS variance, round(stddev_pop(v), 9) AS deviation FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1",
    "photo_groups": f"SELECT id, min(id) OVER w AS group_id, count(*) OVER w AS size FROM (SELECT id, job_id, coalesce(nullif(room_override, ''), nullif(room_label, ''), 'unknown') AS label FROM {_JP}) WINDOW w AS (PARTITION BY job_id, label)",
    "latest_event": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY 1",
    "state_stream": "SELECT user_id, count(*) AS events, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY 1",
    "sliding_counts": "SELECT strftime(date_trunc('day', ts) - to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, range(2) t(k) GROUP BY ALL",
    "view_to_purchase": "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'",
    "beat_grid_snap": f"SELECT c.id, list_min(list_transform(list_filter(t.beat_grid, lambda b: b IS NOT NULL AND NOT isnan(b)), lambda b: {{'d': abs(b - c.in_time), 'v': b}})).v AS beat FROM {_TC} c JOIN {_TL} t ON t.id = c.timeline_id WHERE len(t.beat_grid) > 0 AND c.in_time IS NOT NULL AND NOT isnan(c.in_time)",
    "edited_timelines": f"SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE order_index END AS order_index, round(in_time, 6) + 0.0 AS in_time, round(CASE WHEN id % 5 = 0 THEN least(out_time, in_time + 1.5) ELSE out_time END, 6) + 0.0 AS out_time FROM {_TC} WHERE in_time - in_time = 0 AND out_time - out_time = 0 AND (id % 7 <> 0 OR id % 35 = 0)",
    "uncached_clips": f"WITH k AS (SELECT id, loaded_at, {_HASH} AS hash FROM {_CLIPS}) SELECT id, hash FROM k WHERE id % 2 = 1 AND hash NOT IN (SELECT hash FROM k WHERE id % 2 = 0 AND loaded_at + INTERVAL 30 DAY > TIMESTAMP '2024-03-01 00:00:00')",
    "model_embedding": "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / n, 6) AS first, round(CAST(embedding[64] AS DOUBLE) / n, 6) AS last FROM (SELECT *, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)",
    "user_event_map": "SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'click') AS clicks, count(*) AS events FROM events GROUP BY 1",
    "approximate_users": "SELECT event_type, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY 1",
    "order_ranks": """SELECT o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS cumulative, round(sum(o_totalprice) OVER m, 2) AS month_spend, count(*) OVER m AS month_orders FROM orders
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), m AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)""",
    "allowed_motions": f"SELECT id, CAST(k AS INTEGER) AS place, trim(string_split(allowed_motion_types, ',')[k]) AS entry FROM {_RC}, range(1, 100) t(k) WHERE k <= len(string_split(allowed_motion_types, ',')) AND trim(string_split(allowed_motion_types, ',')[k]) <> ''",
    "median_price": "SELECT p_brand, round(median(p_retailprice), 4) AS median FROM part GROUP BY 1",
    "csv_round_trip": _CUSTOMER,
    "orc_round_trip": _CUSTOMER,
    "object_existence": "SELECT * FROM (VALUES ('region.parquet', true), ('s3://tables/nation.parquet', true), ('nothing.parquet', false), ('parquet', false)) t(key, there)",
    "declared_columns": "SELECT table_name, CAST(count(*) AS INTEGER) AS columns, CAST(count(*) AS INTEGER) AS as_declared FROM information_schema.columns WHERE table_name IN ('photos', 'jobs', 'room_clusters', 'job_photos', 'clips', 'timelines', 'timeline_clips') GROUP BY 1",
}
