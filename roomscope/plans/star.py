"""General analytics over the star schema and the event table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.tables import table
from ..streaming import messages


def _sql(text: str):
    """A query whose text both engines read."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            if t in text:
                table(spark, root, t).createOrReplaceTempView(t)
        return spark.sql(text)

    return run


def asof_price(spark: SparkSession, root: str) -> DataFrame:
    """For every purchase, the user's last view at or before it: union, sort, last value; no range join."""
    e = table(spark, root, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("event_id"), F.struct("ts", "event_id").alias("seen"))
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", F.lit(1).alias("side"), "event_id", F.lit(None).cast(views.schema["seen"].dataType).alias("seen"))
    w = Window.partitionBy("user_id").orderBy("ts", "side", F.col("seen.event_id")).rowsBetween(Window.unboundedPreceding, 0)
    return views.union(buys).withColumn("last", F.last("seen", ignorenulls=True).over(w)).where("side = 1").select("event_id", F.col("last.event_id").alias("view_id"))


def sessions(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"))


def pivot_events(spark: SparkSession, root: str) -> DataFrame:
    kinds = ["click", "purchase", "view"]
    p = table(spark, root, "events").where(F.col("event_type").isin(*kinds)).groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return p.select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def message_stream(spark: SparkSession, root: str) -> DataFrame:
    """Events as queue messages: parsed, duplicates dropped, counted per project."""
    folder = f"{root}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(folder).schema).option("pathGlobFilter", "events*").parquet(root)
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("project_id"), F.when(F.col("event_type") != "click", F.lit("run")).otherwise(F.lit("cancel")).alias("action")))
    msgs = messages.parse(raw.select(F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("at"), body.alias("body")))
    counted = messages.once(messages.runnable(msgs), "message_id", "at").select("message_id", "project_id")
    out = shared_folder(spark, "messages")
    messages.drain_to_table(counted, out, shared_folder(spark, "offsets"))
    return spark.read.schema("message_id bigint, project_id string").parquet(out).groupBy("project_id").agg(F.count(F.lit(1)).alias("jobs"))


def message_batch(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").where("event_type != 'click'").dropDuplicates(["event_id"])
    return e.groupBy(F.col("user_id").cast("string").alias("project_id")).agg(F.count(F.lit(1)).alias("jobs"))


_BOTH = {
    "pricing_summary": """SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS sum_qty, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue,
      CAST(round(avg(l_discount), 6) AS DOUBLE) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "region_revenue": """SELECT n_name, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
      JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
    "order_cube": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "line_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "line_grouping_sets": "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())",
    "customers_without_orders": "SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey",
    "customers_with_orders": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "nation_full_join": "SELECT c.k AS c_nation, s.k AS s_nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1) s ON c.k = s.k",
    "nation_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "nation_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "key_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "running_spend": "SELECT o_orderkey, row_number() OVER w AS place, CAST(round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE) AS spent, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "price_bands": "SELECT band, count(*) AS n, CAST(round(sum(p_retailprice), 2) AS DOUBLE) AS price FROM part JOIN (SELECT 'low' AS band, 0.0 AS a, 905.0 AS b UNION ALL SELECT 'middle', 905.0, 912.5 UNION ALL SELECT 'high', 912.5, 1e9) bands ON p_retailprice >= a AND p_retailprice < b GROUP BY band",
    "late_orders": "SELECT o_orderkey, CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS STRING) AS due, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 90 DAY",
    "exact_totals": "SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderpriority",
    "top_parts": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20",
}
QUERIES = {name: _sql(text) for name, text in _BOTH.items()} | {f.__name__: f for f in (asof_price, sessions, pivot_events, message_stream, message_batch)}
SQL = _BOTH | {
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "asof_price": """SELECT b.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b
      LEFT JOIN LATERAL (SELECT event_id FROM events e WHERE event_type = 'view' AND e.user_id = b.user_id AND e.ts <= b.ts ORDER BY ts DESC, event_id DESC LIMIT 1) v ON true""",
    "sessions": """WITH m AS (SELECT user_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
      SELECT user_id, CAST(sum(f) AS BIGINT) AS sessions, count(*) AS events FROM m GROUP BY user_id""",
    "pivot_events": "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY user_id",
    "message_stream": "SELECT CAST(user_id AS VARCHAR) AS project_id, count(*) AS jobs FROM events WHERE event_type <> 'click' GROUP BY 1",
    "message_batch": "SELECT CAST(user_id AS VARCHAR) AS project_id, count(*) AS jobs FROM events WHERE event_type <> 'click' GROUP BY 1",
}
