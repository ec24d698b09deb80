"""Queries over photos, jobs, clusters and timelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import imaging
from ..operators import rooms
from ..sources.tables import table


def _photos(spark: SparkSession, root: str) -> DataFrame:
    """One row per job photo."""
    return table(spark, root, "job_photos").dropDuplicates(["id"])


def photo_scan(spark: SparkSession, root: str) -> DataFrame:
    """Ready photos of every project in order of position, nulls last and then read as 0."""
    ready = table(spark, root, "photos").where("status = 2").select("id", "project_id", "s3_object_key", "filename", "width", "height", "position", "room_type", "metadata").distinct()
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.asc_nulls_last("position"), "id"))
    return ready.select("id", "project_id", place.alias("place"), F.coalesce("s3_object_key", F.lit("")).alias("s3_object_key"), "filename", "width", "height", F.coalesce("position", F.lit(0)).alias("position"), "room_type", F.coalesce("metadata", F.lit("{}")).alias("metadata"))


def project_exists(spark: SparkSession, root: str) -> DataFrame:
    jobs = table(spark, root, "jobs").select("project_id").distinct()
    known = table(spark, root, "photos").select("project_id", F.lit(True).alias("known")).distinct()
    return jobs.join(known, "project_id", "left").select("project_id", F.coalesce("known", F.lit(False)).alias("exists_in_photos"))


def key_parse(spark: SparkSession, root: str) -> DataFrame:
    return _photos(spark, root).select("id", c.object_key(F.col("s3_uri")).alias("object_key"))


def effective_label(spark: SparkSession, root: str) -> DataFrame:
    return _photos(spark, root).groupBy(c.effective_label(F.col("room_override"), F.col("room_label")).alias("label")).agg(F.count(F.lit(1)).alias("photos"))


def base_and_final_score(spark: SparkSession, root: str) -> DataFrame:
    made = c.base_score(F.col("sharpness"), F.col("exposure_score"), F.col("composition_score"))
    final = c.final_score(F.col("base_score"), F.col("manual_metadata"), F.col("exclude"))
    return _photos(spark, root).select("id", F.round(made, 6).alias("base"), F.round(final, 6).alias("final"))


def _gray(column: str = "embedding") -> Column:
    return F.transform(F.col(column), lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 300 * e.cast("double")).cast("double"))))


def image_scores(spark: SparkSession, root: str) -> DataFrame:
    """Sharpness, exposure and composition of 8x8 grids."""
    grids = table(spark, root, "embeddings").select("vec_id", _gray().alias("g"))
    scored = grids.select("vec_id", imaging.gray_scores(F.col("g"), 8, 8).alias("s"))
    return scored.select("vec_id", *[F.round(f"s.{k}", 6).alias(k) for k in ("sharpness", "exposure", "composition")])


def depth_metrics(spark: SparkSession, root: str) -> DataFrame:
    grids = table(spark, root, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("d"))
    m = grids.select("vec_id", imaging.depth_metrics(F.col("d"), 8, 8).alias("m"))
    return m.select("vec_id", F.round("m.variance", 6).alias("variance"), F.col("m.layers").alias("layers"), c.photo_tier(F.col("m.variance"), F.col("m.layers")).alias("tier"))


def zero_shot_label(spark: SparkSession, root: str) -> DataFrame:
    """The nearest of the labels' mean vectors, and its softmax share. Labels are a vocabulary: one prototype row each."""
    v = table(spark, root, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    mean = v.groupBy("label").agg(F.array(*[F.avg(F.get("x", F.lit(k))) for k in range(64)]).alias("p"))
    unit = lambda name: F.transform(name, lambda e: e / F.sqrt(F.aggregate(name, F.lit(0.0), lambda s, q: s + q * q)))
    protos = mean.select(F.col("label").alias("proto"), unit("p").alias("p"))
    # the vocabulary goes to every row as one array, so that rows times labels are never shuffled
    all_ = protos.agg(F.sort_array(F.collect_list(F.struct("proto", "p"))).alias("protos"))
    product = lambda p: F.aggregate(F.zip_with("x", p, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    scores = F.transform("protos", lambda q: F.struct(product(q["p"]).alias("d"), (-q["proto"]).alias("label")))
    scored = v.crossJoin(F.broadcast(all_)).select("vec_id", scores.alias("s"))  # one row
    best = scored.select("vec_id", F.array_max("s").alias("best"), F.aggregate("s", F.lit(0.0), lambda t, e: t + F.exp(e["d"])).alias("all"))
    return best.select("vec_id", (-F.col("best.label")).alias("label"), F.round(F.exp("best.d") / F.col("all"), 6).alias("confidence"))


def room_sub_clusters(spark: SparkSession, root: str) -> DataFrame:
    photos = _photos(spark, root).where(~F.coalesce("exclude", F.lit(False)))
    label = c.effective_label(F.col("room_override"), F.col("room_label"))
    rows = photos.select("id", "job_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return rooms.numbered(rooms.sub_clusters(rows)).select("id", "job_id", "label", "first_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"))


def cluster_metrics(spark: SparkSession, root: str) -> DataFrame:
    rows = _photos(spark, root).where("room_cluster_id is not null and not coalesce(exclude, false)")
    mean = F.avg(F.when(~F.isnan("depth_variance"), F.col("depth_variance")))
    m = rows.groupBy("room_cluster_id").agg(F.count(F.lit(1)).alias("image_count"), mean.alias("mean"))
    return m.select("room_cluster_id", "image_count", F.round("mean", 9).alias("depth_variance"), c.depth_tier(F.round("mean", 9)).alias("tier"))


def hero_photo(spark: SparkSession, root: str) -> DataFrame:
    """One photo per cluster: marked ones first, then the highest score; ties to the least id."""
    rows = _photos(spark, root).where("room_cluster_id is not null and not coalesce(exclude, false)")
    text = F.col("manual_metadata")
    score = F.coalesce(F.when(~F.isnan("final_score"), F.col("final_score")), F.lit(0.0)) * 10
    rank = F.when(c.truthy(c.json_text(text, "hero_room")), 100.0).when(c.truthy(c.json_text(text, "preferred_opening")), 50.0).otherwise(score)
    best = rows.groupBy("room_cluster_id").agg(F.max_by("id", F.struct(rank.alias("rank"), -F.col("id"))).alias("hero_photo_id"))
    return best.select("room_cluster_id", "hero_photo_id")


def status_counts(spark: SparkSession, root: str) -> DataFrame:
    jobs = table(spark, root, "jobs").dropDuplicates(["id"])
    return jobs.groupBy(F.lower(F.trim("status")).alias("status"), "current_phase").agg(F.count(F.lit(1)).alias("jobs"))


def latest_jobs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "jobs").dropDuplicates(["id"]).orderBy(F.desc("created_at"), F.desc("id")).limit(10).select("id", "project_id", "status", "created_at")


def job_duration_percentiles(spark: SparkSession, root: str) -> DataFrame:
    jobs = table(spark, root, "jobs").dropDuplicates(["id"]).where("updated_at >= created_at")
    secs = (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    by = jobs.groupBy(F.coalesce("current_phase", F.lit(0)).alias("phase")).agg(*[F.round(F.percentile(secs, F.lit(p)), 4).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.round(F.avg(F.when(F.lower(F.trim("status")) == "failed", 1.0).otherwise(0.0)), 6).alias("error_rate"))
    return by


def latest_timelines(spark: SparkSession, root: str) -> DataFrame:
    """The highest version of each job's timelines."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("version"), F.desc("id")))
    return table(spark, root, "timelines").dropDuplicates(["id"]).withColumn("place", place).where("place = 1").select("job_id", F.col("id").alias("timeline_id"), "version")


def _ms(name: str) -> Column:
    return F.when(~F.isnan(name), F.round(F.col(name) * 1000).cast("bigint"))


def timeline_offsets(spark: SparkSession, root: str) -> DataFrame:
    """Running length of each timeline's clips in order, in milliseconds."""
    rows = table(spark, root, "timeline_clips").dropDuplicates(["id"]).select("id", "timeline_id", "order_index", F.greatest(F.lit(0), _ms("out_time") - _ms("in_time")).alias("ms"))
    w = Window.partitionBy("timeline_id").orderBy("order_index", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = F.coalesce(F.sum("ms").over(w), F.lit(0))
    return rows.select("id", "timeline_id", (run - F.coalesce("ms", F.lit(0))).alias("offset_ms"), F.coalesce("ms", F.lit(0)).alias("length_ms"))


def beat_snap(spark: SparkSession, root: str, beat_ms: int = 500) -> DataFrame:
    """Start times moved to the nearest multiple of a beat."""
    rows = table(spark, root, "timeline_clips").dropDuplicates(["id"]).where("in_time is not null and not isnan(in_time)")
    return rows.select("id", (F.floor((_ms("in_time") + beat_ms // 2) / beat_ms) * beat_ms).cast("bigint").alias("snapped_ms"))


def orphan_children(spark: SparkSession, root: str) -> DataFrame:
    """Clips of no job that is still in an early phase."""
    jobs = table(spark, root, "jobs").where("current_phase is null or current_phase < 3").select(F.col("id").alias("job_id"))
    return table(spark, root, "clips").dropDuplicates(["id"]).join(jobs, "job_id", "left_anti").select("id", "job_id")


def cascade_keep(spark: SparkSession, root: str) -> DataFrame:
    """Clips whose job and cluster are both there."""
    jobs = table(spark, root, "jobs").select(F.col("id").alias("job_id"))
    clusters = table(spark, root, "room_clusters").select(F.col("id").alias("room_cluster_id"))
    return table(spark, root, "clips").dropDuplicates(["id"]).join(jobs, "job_id", "left_semi").join(clusters, "room_cluster_id", "left_semi").select("id", "job_id", "room_cluster_id")


def job_contents(spark: SparkSession, root: str) -> DataFrame:
    """Timelines, placed clips and rendered seconds of each job, along the foreign keys."""
    one = lambda t: table(spark, root, t).dropDuplicates(["id"])
    placed = one("timelines").select(F.col("id").alias("timeline_id"), "job_id").join(one("timeline_clips").select("timeline_id", "clip_id"), "timeline_id", "left")
    full = placed.join(one("clips").select(F.col("id").alias("clip_id"), "duration"), "clip_id", "left")
    return full.groupBy("job_id").agg(F.count_distinct("timeline_id").alias("timelines"), F.count("clip_id").alias("placed"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)), 4).alias("seconds"))


_JP = "(SELECT DISTINCT ON (id) * FROM job_photos)"


def _json_sql(key: str) -> str:
    return f"CAST(CASE WHEN json_valid(manual_metadata) THEN json_extract(manual_metadata, '$.{key}') END AS VARCHAR)"


def _true_sql(key: str) -> str:
    t = _json_sql(key)
    return f"coalesce({t} NOT IN ('null', 'false', '\"\"', '[]', '{{}}') AND NOT regexp_full_match({t}, '-?0+(\\.0+)?([eE][+-]?[0-9]+)?'), false)"


_PRIORITY = f"""CASE WHEN {_json_sql("hero_priority")} = 'true' THEN 1 WHEN {_json_sql("hero_priority")} = 'false' THEN 0
  WHEN {_json_sql("hero_priority")} LIKE '"%' THEN TRY_CAST(nullif(regexp_extract({_json_sql("hero_priority")}, '^"\\s*([+-]?[0-9]+)\\s*"$', 1), '') AS BIGINT)
  ELSE TRY_CAST(trunc(TRY_CAST({_json_sql("hero_priority")} AS DOUBLE)) AS BIGINT) END"""
_G = """WITH px AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, least(255.0, greatest(0.0, floor(128 + 300 * CAST(embedding[i] AS DOUBLE)))) AS v
  FROM embeddings, range(1, 65) t(i))"""

QUERIES = {
    f.__name__: f
    for f in (photo_scan, project_exists, key_parse, effective_label, base_and_final_score, image_scores, depth_metrics, zero_shot_label, room_sub_clusters, cluster_metrics, hero_photo, status_counts, latest_jobs, job_duration_percentiles, latest_timelines, timeline_offsets, beat_snap, orphan_children, cascade_keep, job_contents)
}
SQL = {
    "photo_scan": """SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY position ASC NULLS LAST, id) AS place, coalesce(s3_object_key, '') AS s3_object_key,
      filename, width, height, coalesce(position, 0) AS position, room_type, coalesce(metadata, '{}') AS metadata
      FROM (SELECT DISTINCT id, project_id, s3_object_key, filename, width, height, position, room_type, metadata FROM photos WHERE status = 2)""",
    "project_exists": "SELECT DISTINCT project_id, project_id IN (SELECT project_id FROM photos) AS exists_in_photos FROM jobs",
    "key_parse": f"SELECT id, CASE WHEN starts_with(s3_uri, 's3://') THEN CASE WHEN contains(substr(s3_uri, 6), '/') THEN substr(s3_uri, 6 + instr(substr(s3_uri, 6), '/')) ELSE '' END ELSE s3_uri END AS object_key FROM {_JP}",
    "effective_label": f"SELECT coalesce(nullif(room_override, ''), nullif(room_label, ''), 'unknown') AS label, count(*) AS photos FROM {_JP} GROUP BY ALL",
    "base_and_final_score": f"""SELECT id, round(0.4 * sharpness + 0.3 * exposure_score + 0.3 * composition_score, 6) AS base,
      round(CASE WHEN bad THEN 0.5 WHEN gone THEN 0.0 ELSE least(1.0, total) END, 6) AS final FROM (
      SELECT *, (manual_metadata IS NOT NULL AND NOT coalesce(json_valid(manual_metadata) AND json_type(CASE WHEN json_valid(manual_metadata) THEN manual_metadata END) = 'OBJECT', false)) OR ({_json_sql("hero_priority")} IS NOT NULL AND ({_PRIORITY}) IS NULL) AS bad,
        coalesce(exclude, false) OR {_true_sql("exclude")} AS gone,
        coalesce(nullif(base_score, 0.0), 0.5) + CASE WHEN {_true_sql("hero_global")} THEN 0.3 ELSE 0 END + CASE WHEN {_true_sql("hero_room")} THEN 0.2 ELSE 0 END
        + CASE WHEN {_true_sql("preferred_opening")} THEN 0.1 ELSE 0 END + CASE WHEN {_true_sql("preferred_closing")} THEN 0.1 ELSE 0 END + coalesce(({_PRIORITY}) * 0.05, 0.0) AS total
      FROM {_JP})""",
    "image_scores": _G + """, nb AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS rt, lag(v) OVER k AS u, lead(v) OVER k AS d FROM px
        WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), k AS (PARTITION BY vec_id, x ORDER BY y)),
      e AS (SELECT *, coalesce(l, v) + coalesce(rt, v) + coalesce(u, v) + coalesce(d, v) - 4 * v AS lap,
        sqrt(pow(CASE WHEN l IS NULL THEN rt - v WHEN rt IS NULL THEN v - l ELSE (rt - l) / 2 END, 2) + pow(CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END, 2)) AS g FROM nb),
      s AS (SELECT vec_id, var_pop(lap) AS vl, avg(v) AS m, stddev_pop(v) AS sd, 2 * (avg((v < 20)::INT) + avg((v > 235)::INT)) AS pen, avg(g) + 1e-8 AS w,
        (avg(g) + avg(g) FILTER (y >= 2 + 0 AND y <= 7) + avg(g) + avg(g) FILTER (x >= 2 AND x <= 7)) / 4 AS thirds, avg(g) FILTER (y BETWEEN 2 AND 4 AND x BETWEEN 2 AND 4) AS centre FROM e GROUP BY vec_id)
      SELECT vec_id, round(least(1.0, vl / 500), 6) AS sharpness,
        round(greatest(0.0, least(1.0, (0.5 * (1 - abs(m - 128) / 128) + 0.5 * least(1.0, sd / 60)) * (1 - pen))), 6) AS exposure,
        round(0.6 * least(1.0, thirds / w / 2) + 0.4 * least(1.0, centre / w / 2), 6) AS composition FROM s""",
    "depth_metrics": """WITH d AS (SELECT vec_id, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)),
      n AS (SELECT vec_id, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8) AS v FROM d WINDOW w AS (PARTITION BY vec_id)),
      b AS (SELECT vec_id, v, least(floor(v / (max(v) OVER (PARTITION BY vec_id)) * 10), 9) AS bin FROM n),
      k AS (SELECT vec_id, count(*) FILTER (n > 3.2) AS layers FROM (SELECT vec_id, bin, count(*) AS n FROM b GROUP BY ALL) GROUP BY vec_id),
      s AS (SELECT vec_id, var_pop(v) AS variance FROM n GROUP BY vec_id)
      SELECT vec_id, round(variance, 6) AS variance, layers, CASE WHEN variance > 0.1 AND layers >= 4 THEN 'high' WHEN variance > 0.05 AND layers >= 2 THEN 'medium' ELSE 'low' END AS tier FROM s JOIN k USING (vec_id)""",
    "zero_shot_label": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
      m AS (SELECT label, i, avg(x[i]) AS v FROM e, range(1, 65) t(i) GROUP BY ALL),
      p AS (SELECT label, list(v / nrm ORDER BY i) AS p FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY label)) AS nrm FROM m) GROUP BY label),
      s AS (SELECT vec_id, p.label, list_dot_product(x, p.p) AS d FROM e, p)
      SELECT vec_id, arg_max(label, (d, -label)) AS label, round(max(exp(d)) / sum(exp(d)), 6) AS confidence FROM s GROUP BY vec_id""",
    "room_sub_clusters": f"""WITH RECURSIVE o AS MATERIALIZED (SELECT id, job_id, coalesce(nullif(room_override, ''), nullif(room_label, ''), 'unknown') AS label, CAST(embedding AS DOUBLE[]) AS e,
        coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM {_JP} WHERE NOT coalesce(exclude, false)),
      p AS MATERIALIZED (SELECT id, job_id, label, ok, CASE WHEN ok THEN e ELSE [1.0::DOUBLE] END AS e FROM o),
      g AS MATERIALIZED (SELECT *, bool_and(ok) OVER w AND min(len(e)) OVER w = max(len(e)) OVER w AS divided, min(id) OVER w AS group_first FROM p WINDOW w AS (PARTITION BY job_id, label)),
      u AS MATERIALIZED (SELECT id, job_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM g WHERE divided),
      l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.job_id = b.job_id AND a.label = b.label AND round(list_dot_product(a.e, b.e), 9) >= 0.7),
      r AS (SELECT id, id AS first FROM u UNION SELECT l.b, r.first FROM r JOIN l ON l.a = r.id WHERE r.first < l.b),
      c AS (SELECT g.id, g.job_id, g.label, coalesce(m.first, g.group_first) AS first_id FROM g LEFT JOIN (SELECT id, min(first) AS first FROM r GROUP BY 1) m ON m.id = g.id),
      n AS (SELECT *, min(first_id) OVER (PARTITION BY job_id, label) AS label_first FROM c)
      SELECT id, job_id, label, first_id, dense_rank() OVER (PARTITION BY job_id ORDER BY label_first, label, first_id) AS cluster_seq FROM n""",
    "cluster_metrics": f"""SELECT room_cluster_id, n AS image_count, round(m, 9) AS depth_variance, CASE WHEN round(m, 9) > 0.06 THEN 'high' WHEN round(m, 9) > 0.035 THEN 'medium' ELSE 'low' END AS tier
      FROM (SELECT room_cluster_id, count(*) AS n, avg(CASE WHEN NOT isnan(depth_variance) THEN depth_variance END) AS m FROM {_JP} WHERE room_cluster_id IS NOT NULL AND NOT coalesce(exclude, false) GROUP BY 1)""",
    "hero_photo": f"""SELECT room_cluster_id, arg_max(id, (CASE WHEN {_true_sql("hero_room")} THEN 100.0::DOUBLE WHEN {_true_sql("preferred_opening")} THEN 50.0::DOUBLE
      ELSE coalesce(CASE WHEN NOT isnan(final_score) THEN final_score END, 0.0) * 10 END, -id)) AS hero_photo_id FROM {_JP} WHERE room_cluster_id IS NOT NULL AND NOT coalesce(exclude, false) GROUP BY 1""",
    "status_counts": "SELECT lower(trim(status)) AS status, current_phase, count(*) AS jobs FROM (SELECT DISTINCT ON (id) * FROM jobs) GROUP BY ALL",
    "latest_jobs": "SELECT id, project_id, status, created_at FROM (SELECT DISTINCT ON (id) * FROM jobs) ORDER BY created_at DESC, id DESC LIMIT 10",
    "job_duration_percentiles": """SELECT coalesce(current_phase, 0) AS phase, round(quantile_cont(s, 0.5), 4) AS p50, round(quantile_cont(s, 0.95), 4) AS p95, round(quantile_cont(s, 0.99), 4) AS p99,
      round(avg((lower(trim(status)) = 'failed')::INT), 6) AS error_rate FROM (SELECT *, (epoch_us(updated_at) - epoch_us(created_at)) / 1e6 AS s FROM (SELECT DISTINCT ON (id) * FROM jobs) WHERE updated_at >= created_at) GROUP BY 1""",
    "latest_timelines": "SELECT job_id, id AS timeline_id, version FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY version DESC, id DESC) AS place FROM (SELECT DISTINCT ON (id) * FROM timelines)) WHERE place = 1",
    "timeline_offsets": """WITH r AS (SELECT id, timeline_id, order_index, coalesce(CASE WHEN in_time IS NULL OR out_time IS NULL OR isnan(in_time) OR isnan(out_time) THEN 0
        ELSE greatest(0, TRY_CAST(round(out_time * 1000) AS BIGINT) - TRY_CAST(round(in_time * 1000) AS BIGINT)) END, 0) AS ms FROM (SELECT DISTINCT ON (id) * FROM timeline_clips))
      SELECT id, timeline_id, CAST(sum(ms) OVER (PARTITION BY timeline_id ORDER BY order_index, id ROWS UNBOUNDED PRECEDING) - ms AS BIGINT) AS offset_ms, ms AS length_ms FROM r""",
    "beat_snap": "SELECT id, TRY_CAST(floor((round(in_time * 1000) + 250) / 500) * 500 AS BIGINT) AS snapped_ms FROM (SELECT DISTINCT ON (id) * FROM timeline_clips) WHERE in_time IS NOT NULL AND NOT isnan(in_time)",
    "orphan_children": "SELECT id, job_id FROM (SELECT DISTINCT ON (id) * FROM clips) WHERE job_id NOT IN (SELECT id FROM jobs WHERE current_phase IS NULL OR current_phase < 3)",
    "cascade_keep": "SELECT id, job_id, room_cluster_id FROM (SELECT DISTINCT ON (id) * FROM clips) WHERE job_id IN (SELECT id FROM jobs) AND room_cluster_id IN (SELECT id FROM room_clusters)",
    "job_contents": """SELECT t.job_id, count(DISTINCT t.id) AS timelines, count(tc.clip_id) AS placed, round(coalesce(sum(c.duration), 0.0), 4) AS seconds FROM (SELECT DISTINCT ON (id) * FROM timelines) t
      LEFT JOIN (SELECT DISTINCT ON (id) * FROM timeline_clips) tc ON tc.timeline_id = t.id LEFT JOIN (SELECT DISTINCT ON (id) * FROM clips) c ON c.id = tc.clip_id GROUP BY 1""",
}
