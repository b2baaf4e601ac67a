"""Graphs that the test tables hold, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.model import Graph
from lattica.plans.loop import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_next(df: DataFrame, order: list[str], cols: list[str]) -> DataFrame:
    """With ``next_<col>`` of the following row in a global order: ranges are sorted apart, and only the first row of each is passed on."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    heads = dealt.groupBy("_part").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("h")).orderBy("_part").collect()  # a row a partition
    after = [(a["_part"], b["h"]) for a, b in zip(heads, heads[1:], strict=False)]
    schema = dealt.select(F.col("_part"), F.struct(*cols).alias("_head")).schema
    follow = df.sparkSession.createDataFrame(after, schema)
    w = W.partitionBy("_part").orderBy(*order)
    out = dealt.join(F.broadcast(follow), "_part", "left")
    last = F.row_number().over(W.partitionBy("_part").orderBy(*[F.col(c).desc() for c in order])) == 1
    nexts = {f"next_{c}": F.when(last, F.col(f"_head.{c}")).otherwise(F.lead(c).over(w)) for c in cols}
    return out.withColumns(nexts).drop("_part", "_head")


def orders_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer -> customer of the next order, where its date is later."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    arcs = with_next(orders, ["o_orderkey"], ["o_custkey", "o_orderdate"]).where("next_o_orderdate > o_orderdate")
    n = _table(spark, sf_dir, "customer").agg(F.max("c_custkey") + 1).first()[0]
    return Graph(cut(arcs.select(F.col("o_custkey").alias("src"), F.col("next_o_custkey").alias("dst")).distinct()), n)


ORDERS_SQL = """v AS (SELECT unnest(range((SELECT 1 + max(c_custkey) FROM customer))) AS id),
g AS (SELECT DISTINCT o_custkey AS src, nxt AS dst FROM (
  SELECT o_custkey, o_orderdate, lead(o_custkey) OVER (ORDER BY o_orderkey) AS nxt, lead(o_orderdate) OVER (ORDER BY o_orderkey) AS nd
  FROM orders) WHERE nd > o_orderdate)"""


def events_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """User -> user of the next event."""
    events = _table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    arcs = with_next(events, ["ts", "event_id"], ["user_id"]).where("next_user_id is not null")
    n = events.agg(F.max("user_id") + 1).first()[0]
    return Graph(cut(arcs.select(F.col("user_id").alias("src"), F.col("next_user_id").alias("dst")).distinct()), n)


EVENTS_SQL = """v AS (SELECT unnest(range((SELECT 1 + max(user_id) FROM events))) AS id),
g AS (SELECT DISTINCT user_id AS src, nxt AS dst FROM (
  SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"""


def parts_graph(spark: SparkSession, sf_dir: str) -> tuple[Graph, int]:
    """(part -> supplier, number of parts)."""
    items, parts, suppliers = (_table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    p = parts.agg(F.max("p_partkey") + 1).first()[0]
    s = suppliers.agg(F.max("s_suppkey") + 1).first()[0]
    return Graph(items.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + p).alias("dst")).distinct(), p + s), p


PARTS_SQL = """k AS (SELECT (SELECT 1 + max(p_partkey) FROM part) AS p, (SELECT 1 + max(s_suppkey) FROM supplier) AS s),
v AS (SELECT unnest(range((SELECT p + s FROM k))) AS id),
g AS (SELECT DISTINCT l_partkey AS src, l_suppkey + p AS dst FROM lineitem, k)"""


def tree_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Region -> nation -> customer and supplier: ids of regions from 0, nations from 5, customers from 30, then suppliers."""
    nation, customer, supplier = (_table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    c = customer.agg(F.max("c_custkey") + 1).first()[0]
    s = supplier.agg(F.max("s_suppkey") + 1).first()[0]
    arcs = (
        nation.select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 5).cast("long").alias("dst"))
        .union(customer.select((F.col("c_nationkey") + 5).cast("long"), F.col("c_custkey") + 30))
        .union(supplier.select((F.col("s_nationkey") + 5).cast("long"), F.col("s_suppkey") + 30 + c))
    )
    return Graph(arcs, 30 + c + s)


TREE_SQL = """k AS (SELECT (SELECT 1 + max(c_custkey) FROM customer) AS c, (SELECT 1 + max(s_suppkey) FROM supplier) AS s),
v AS (SELECT unnest(range((SELECT 30 + c + s FROM k))) AS id),
g AS (SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(n_nationkey + 5 AS BIGINT) AS dst FROM nation
  UNION ALL SELECT CAST(c_nationkey + 5 AS BIGINT), c_custkey + 30 FROM customer
  UNION ALL SELECT CAST(s_nationkey + 5 AS BIGINT), s_suppkey + 30 + (SELECT c FROM k) FROM supplier)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, a, b): page -> href, numbered by page and place."""
    pages = _table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    return rows.select((F.col("page_id") * 100000 + F.col("pos")).alias("line"), F.col("url").alias("a"), F.col("href").alias("b"))


LINKS_SQL = """l AS (SELECT page_id, url AS a, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS b,
  unnest(range(1, len(regexp_extract_all(html, 'href="([^"]+)"', 1)) + 1)) AS pos FROM pages),
seen AS (SELECT name, min(k) AS k FROM (
  SELECT a AS name, (page_id * 100000 + pos - 1) * 2 AS k FROM l UNION ALL SELECT b, (page_id * 100000 + pos - 1) * 2 + 1 FROM l) GROUP BY name),
names AS (SELECT name, row_number() OVER (ORDER BY k) - 1 AS id FROM seen)"""
