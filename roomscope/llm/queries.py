"""Queries of the training-data problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import table
from . import abuse, clusters, neighbours, packing, tokenizer, topn

VOCABULARY = tokenizer.vocabulary("byte_bpe_50k")


LINK = 0.85


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    found = clusters.members(table(spark, root, "job_photos"), "id", "embedding", LINK)
    return found.select(F.col("id").alias("photo_id"), F.col("first_id").alias("first_photo_id"))


def p3_clusters(spark: SparkSession, root: str) -> DataFrame:
    photos = table(spark, root, "job_photos")
    found = cut_lineage(clusters.members(photos, "id", "embedding", LINK))
    told = clusters.describe(photos, "id", "embedding", "room_cluster_id", found)
    return told.select(F.col("first_id").alias("first_photo_id"), "size", F.col("typical_ids").alias("typical_photo_ids"), F.col("groups").alias("room_clusters"))


def p3_rooms(spark: SparkSession, root: str) -> DataFrame:
    """The room_cluster_ids under which the photos of each cluster are recorded, and how many photos are under each."""
    photos = table(spark, root, "job_photos")
    rooms = clusters.recorded(photos, "id", "room_cluster_id", clusters.members(photos, "id", "embedding", LINK))
    return rooms.select(F.col("first_id").alias("first_photo_id"), F.col("grp").alias("room_cluster_id"), F.col("rows").alias("photos"))


def p3_leaves(spark: SparkSession, root: str) -> DataFrame:
    """The leaves of the tree: groups of which any two photos are linked, with size and the photos nearest to the centre."""
    found = clusters.leaf_sizes(table(spark, root, "job_photos"), "id", "embedding", LINK)
    return found.select(F.col("leaf").alias("leaf_id"), "size", F.col("typical_ids").alias("typical_photo_ids"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    best = topn.top_n(table(spark, root, "job_photos"), "room_cluster_id", "id", "final_score", 3)
    return best.select(F.col("grp").alias("room_cluster_id"), F.col("item").alias("photo_id"))


def p4_ranked(spark: SparkSession, root: str) -> DataFrame:
    best = topn.top_n(table(spark, root, "job_photos"), "room_cluster_id", "id", "final_score", 3)
    return best.select(F.col("grp").alias("room_cluster_id"), F.col("item").alias("photo_id"), F.col("score").alias("final_score"), "place")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = neighbours.similar_pairs(table(spark, root, "job_photos"), "id", "embedding", 5, LINK)
    return pairs.select(F.col("a").alias("photo_id_a"), F.col("b").alias("photo_id_b"))


def p5_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The five nearest, however far, of every row whose id is divisible by 50, against all rows."""
    near = neighbours.neighbours(table(spark, root, "job_photos"), "id", "embedding", 5, queries=_every_50th)
    return near.select(F.col("id").alias("photo_id"), F.col("near_id").alias("similar_photo_id"), "place", "cosine")


def _every_50th(c: Column) -> Column:
    return F.pmod(c, F.lit(50)) == 0


def p5_recall(spark: SparkSession, root: str) -> DataFrame:
    """Of the true five nearest (of at least LINK) of every row whose id is divisible by 50, compared with all rows, how many pairs p5_found has."""
    photos = table(spark, root, "job_photos")
    true = neighbours.exact_nearest(photos, "id", "embedding", _every_50th, 5, LINK)
    pairs = true.select(F.least("id", "near_id").alias("photo_id_a"), F.greatest("id", "near_id").alias("photo_id_b")).distinct()
    both = pairs.join(p5_found(spark, root).withColumn("there", F.lit(1)), ["photo_id_a", "photo_id_b"], "left")
    return both.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("there").alias("found"))


def p3_recall(spark: SparkSession, root: str) -> DataFrame:
    """Of the links of every row whose id is divisible by 50 with its five nearest, how many lie within one cluster of p3_found."""
    found = p3_found(spark, root)
    true = neighbours.exact_nearest(table(spark, root, "job_photos"), "id", "embedding", _every_50th, 5, LINK)
    side = lambda name: found.select(F.col("photo_id").alias(name), F.col("first_photo_id").alias(f"first_{name}"))
    both = true.join(side("id"), "id", "left").join(side("near_id"), "near_id", "left")
    return both.agg(F.count(F.lit(1)).alias("links"), F.count(F.when(F.col("first_id") == F.col("first_near_id"), 1)).alias("kept"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, root, "documents"), "doc_id", "text", VOCABULARY)


def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    ids = p6_ids(spark, root)
    return ids.select("doc_id", F.size("ids").alias("n_ids"), tokenizer.decode_column(F.col("ids"), VOCABULARY).alias("text")).drop("n_ids")


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    items = docs.select("doc_id", tokenizer.count_column(F.col("text"), VOCABULARY).alias("size"))
    packed = packing.pack_containers(items)
    return packed.select("container_id", "doc_ids", "sizes", F.col("tokens").alias("fill"), (F.lit(packing.CAPACITY) - F.col("tokens")).alias("unused"))


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers used, the fewest that could hold the tokens, and the share filled."""
    total = p7_containers(spark, root).agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"), F.sum(F.size("doc_ids")).alias("pieces"))
    return total.select("containers", F.ceil(F.col("tokens") / packing.CAPACITY).alias("at_least"), "pieces", F.round(F.col("tokens") / (F.greatest("containers", F.lit(1)) * packing.CAPACITY), 6).alias("filled"))


#: Limits that bind beside the tokens: documents, and attention cost as a quarter of a full container's.
FEW_DOCS, ATTENTION = 24, packing.CAPACITY**2 / 4


def p7_balanced(spark: SparkSession, root: str) -> DataFrame:
    """Containers under all three capacities; a text whose own attention cost is too large stands alone."""
    items = table(spark, root, "documents").select("doc_id", tokenizer.count_column(F.col("text"), VOCABULARY).alias("size"))
    packed = packing.pack_containers(items, max_docs=FEW_DOCS, attention=ATTENTION)
    cost = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, n: s + n * n)
    return packed.select("container_id", "doc_ids", "sizes", F.col("tokens").alias("fill"), cost.alias("attention"))


def p7_limits(spark: SparkSession, root: str) -> DataFrame:
    """Documents placed, containers over a limit, and whether each limit is reached, to a twentieth, by a container with room under the other two."""
    c = p7_balanced(spark, root).select("doc_ids", F.size("doc_ids").alias("docs"), "fill", "attention")
    share = {"tokens": F.col("fill") / packing.CAPACITY, "documents": F.col("docs") / FEW_DOCS, "attention_cost": F.col("attention") / ATTENTION}
    over = (F.col("fill") > packing.CAPACITY) | (F.col("docs") > FEW_DOCS) | ((F.col("attention") > ATTENTION) & (F.col("docs") > 1))
    tight = [F.max((s >= 0.95) & F.least(*(1 - share[o] for o in share if o != k)).between(0.05, 1)).alias(k) for k, s in share.items()]
    placed = c.select(F.explode("doc_ids").alias("doc_id")).agg(F.count_distinct("doc_id").alias("placed"))
    return c.agg(F.count(F.when(over, 1)).alias("over"), *tight).crossJoin(placed)  # one row each


def _scored(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    net = abuse.fit_on(table(spark, root, "content_labels"))
    return docs.select("doc_id", "source", abuse.score_column(F.col("text"), net).alias("score"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _scored(spark, root).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    return _scored(spark, root).select("doc_id", "source", F.round("score", 6).alias("score"))


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    return abuse.rates(_scored(spark, root), "source")


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters, "p3_rooms": p3_rooms, "p3_leaves": p3_leaves, "p3_recall": p3_recall, "p5_found": p5_found, "p5_nearest": p5_nearest, "p5_recall": p5_recall, "p4_found": p4_found, "p4_ranked": p4_ranked, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_balanced": p7_balanced, "p7_limits": p7_limits, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
_P4 = """SELECT room_cluster_id, id AS photo_id, final_score, row_number() OVER (PARTITION BY room_cluster_id ORDER BY final_score DESC, id) AS place
  FROM (SELECT DISTINCT id, room_cluster_id, final_score FROM job_photos WHERE room_cluster_id IS NOT NULL AND final_score IS NOT NULL AND NOT isnan(final_score))"""
#: The closure of all links, over distinct vectors; DuckDB needs the small tables.
_P3 = """WITH RECURSIVE v AS MATERIALIZED (SELECT min(id) AS id, list(DISTINCT id) AS ids, e FROM (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM job_photos
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) GROUP BY e),
  u AS MATERIALIZED (SELECT id, ids, CAST(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS DOUBLE[64]) AS e FROM v),
  l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON round(array_inner_product(a.e, b.e), 9) >= 0.85),
  r AS (SELECT id, id AS first FROM u UNION SELECT l.b, r.first FROM r JOIN l ON l.a = r.id WHERE r.first < l.b),
  c AS (SELECT unnest(u.ids) AS id, m.first FROM u JOIN (SELECT id, min(first) AS first FROM r GROUP BY 1) m ON m.id = u.id)
"""
_P5 = """WITH v AS MATERIALIZED (SELECT DISTINCT id, CAST(embedding AS DOUBLE[]) AS e FROM job_photos
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  u AS MATERIALIZED (SELECT id, CAST(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS DOUBLE[64]) AS e FROM v),
  n AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY round(array_inner_product(a.e, b.e), 9) DESC, b.id) AS place FROM u a JOIN u b ON a.id <> b.id AND round(array_inner_product(a.e, b.e), 9) >= 0.85)
  SELECT DISTINCT least(a, b) AS photo_id_a, greatest(a, b) AS photo_id_b FROM n WHERE place <= 5"""
SQL = {
    "p4_found": f"SELECT room_cluster_id, photo_id FROM ({_P4}) WHERE place <= 3",
    "p4_ranked": f"SELECT * FROM ({_P4}) WHERE place <= 3",
    "p3_found": _P3 + "SELECT id AS photo_id, first AS first_photo_id FROM (SELECT id, first, count(*) OVER (PARTITION BY first) AS n FROM c) WHERE n > 1",
    "p5_found": _P5,
    "p7_limits": "SELECT 0 AS over, true AS tokens, true AS documents, true AS attention_cost, count(DISTINCT doc_id) AS placed FROM documents",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
