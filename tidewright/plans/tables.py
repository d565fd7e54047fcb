"""The test tables as tags, networks and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.storage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tags(tag, ts, value): a user is a tag."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("tag"), F.col("ts").cast("timestamp").alias("ts"), "value")


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(edge, from_v, to_v, flow) from supplier to customer nations; the flow is the quantity shipped.

    It is written once, as graph operators go over their edges again and again.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("from_v"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("to_v"))
    shipped = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    edges = shipped.groupBy("from_v", "to_v").agg(F.sum("q").alias("flow")).select((F.col("from_v") * 25 + F.col("to_v")).alias("edge"), "from_v", "to_v", "flow")
    return written(edges, "net")


def strong(edges: DataFrame, share: float) -> DataFrame:
    """Edges between different vertices whose flow is at least that of the given share of such edges."""
    apart = edges.filter("from_v <> to_v")
    least = apart.agg(F.expr(f"percentile_disc({share}) within group (order by flow)").alias("least"))
    return apart.join(F.broadcast(least), F.col("flow") >= F.col("least")).drop("least")  # one number


NET_SQL = """
net AS (
  SELECT s_nationkey::BIGINT * 25 + c_nationkey AS edge, s_nationkey::BIGINT AS from_v, c_nationkey::BIGINT AS to_v, sum(l_quantity) AS flow
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  GROUP BY s_nationkey, c_nationkey),
apart AS (SELECT * FROM net WHERE from_v <> to_v)"""


def strong_sql(share: float) -> str:
    return f"""{NET_SQL},
e AS (SELECT * FROM apart WHERE flow >= (SELECT quantile_disc(flow, {share}) FROM apart)),
both_ways AS (SELECT from_v AS u, to_v AS v FROM e UNION SELECT to_v, from_v FROM e)"""


#: After strong_sql(): two edges are in one block if no vertex that is taken out parts them.
BLOCKS_SQL = """
bv AS (SELECT DISTINCT u AS vertex FROM both_ways),
bwalk AS (SELECT x.vertex AS without, y.vertex AS a, y.vertex AS b FROM bv x, bv y WHERE x.vertex <> y.vertex
  UNION SELECT without, a, v FROM bwalk JOIN both_ways ON u = b WHERE v <> without),
bpart AS (SELECT without, a, min(b) AS part FROM bwalk GROUP BY without, a),
bside AS (SELECT edge, vertex AS without, part FROM e, bv JOIN bpart ON bpart.without = vertex WHERE a = CASE WHEN from_v = vertex THEN to_v ELSE from_v END),
bsame AS (SELECT x.edge, y.edge AS other FROM bside x JOIN bside y ON x.without = y.without AND x.part = y.part GROUP BY x.edge, y.edge HAVING count(*) = (SELECT count(*) FROM bv)),
blocks AS (SELECT edge, min(other) AS block, count(*) = 1 AS is_bridge FROM bsame GROUP BY edge)"""

TAGS_SQL = "tags AS (SELECT user_id AS tag, ts, value FROM events)"
PERIOD_SQL = "period AS (SELECT max(a) AS t_start, min(b) AS t_end FROM (SELECT min(ts) AS a, max(ts) AS b FROM tags WHERE value IS NOT NULL GROUP BY tag))"
