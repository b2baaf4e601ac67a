"""Statistics of graphs: degrees, gaps, locality, code sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.model import Graph


def outdegrees(g: Graph) -> DataFrame:
    """(id, degree) of every node."""
    d = g.arcs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return g.nodes.join(d, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def indegrees(g: Graph) -> DataFrame:
    d = g.arcs.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    return g.nodes.join(d, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def distribution(degrees: DataFrame) -> DataFrame:
    """(degree, nodes) for every degree from 0 to the largest."""
    counts = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))
    top = counts.agg(F.max("degree").alias("top"))
    every = top.where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("degree"))
    return every.join(counts, "degree", "left").select("degree", F.coalesce("nodes", F.lit(0)).alias("nodes"))


def zigzag(x: Column) -> Column:
    """2x of x >= 0, else -2x - 1."""
    return F.when(x >= 0, 2 * x).otherwise(-2 * x - 1)


def floor_log2(x: Column) -> Column:
    """Of a positive whole number, without rounding."""
    return F.length(F.bin(x)) - 1


def summary(g: Graph) -> DataFrame:
    """One row: sizes, degree extremes with their nodes, dangling, terminal, loops, gaps and locality.

    Of equal outdegrees the first node counts, of equal indegrees the last one. A terminal node has no arc but
    a loop, if any.
    """
    per = g.arcs.groupBy("src").agg(
        F.count(F.lit(1)).alias("d"), F.min("dst").alias("low"), F.max("dst").alias("high"), F.sum(F.when(F.col("dst") == F.col("src"), 1).otherwise(0)).alias("loops"),
        F.sum(F.abs(F.col("dst") - F.col("src"))).alias("far"),
    )
    rows = g.nodes.join(per, F.col("id") == F.col("src"), "left").select("id", F.coalesce("d", F.lit(0)).alias("d"), "low", "high", F.coalesce("loops", F.lit(0)).alias("loops"), F.coalesce("far", F.lit(0)).alias("far"))
    gap = F.when(F.col("d") > 1, F.col("high") - F.col("low") + zigzag(F.col("low") - F.col("id"))).otherwise(0)
    out = rows.agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("d").alias("arcs"), F.sum("loops").alias("loops"),
        F.sum(F.when(F.col("d") == 0, 1).otherwise(0)).alias("dangling"),
        F.sum(F.when((F.col("d") == 0) | ((F.col("d") == 1) & (F.col("loops") == 1)), 1).otherwise(0)).alias("terminal"),
        F.min("d").alias("min_outdegree"), F.min_by("id", F.struct("d", "id")).alias("min_outdegree_node"),
        F.max("d").alias("max_outdegree"), F.max_by("id", F.struct(F.col("d"), -F.col("id"))).alias("max_outdegree_node"),
        F.sum(gap).alias("gaps"), F.sum("far").alias("far"),
    )
    into = indegrees(g).agg(
        F.min("degree").alias("min_indegree"), F.min_by("id", F.struct(F.col("degree"), -F.col("id"))).alias("min_indegree_node"),
        F.max("degree").alias("max_indegree"), F.max_by("id", F.struct("degree", "id")).alias("max_indegree_node"),
    )
    return out.crossJoin(into).select(
        "nodes", "arcs", "loops", "dangling", "terminal", "min_outdegree", "min_outdegree_node", "max_outdegree", "max_outdegree_node", "min_indegree", "min_indegree_node",
        "max_indegree", "max_indegree_node", F.round(F.try_divide("gaps", "arcs"), 6).alias("successor_avg_gap"), F.round(F.try_divide("far", "arcs"), 6).alias("avg_locality"),
    )


def log_deltas(g: Graph) -> DataFrame:
    """(bin, arcs): arcs other than loops by the binary logarithm of their length, rounded down."""
    return g.arcs.where("src != dst").groupBy(floor_log2(F.abs(F.col("dst") - F.col("src"))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("arcs"))


def average_log_delta(g: Graph) -> float:
    """Mean over arcs of the middle of their bin, three decimals; 0 without arcs."""
    total = half = 0
    for r in log_deltas(g).collect():  # at most 64 rows
        half += ((3 * (1 << r["bin"]) + 1).bit_length() - 2) * r["arcs"]
        total += r["arcs"]
    return round(half / (2 * total), 3) if total else 0.0


def log_gap_cost(g: Graph) -> DataFrame:
    """(cost): bits of floor(log2) over the first distance (plus one) and all gaps of each node's successors."""
    before = F.lag("dst").over(W.partitionBy("src").orderBy("dst"))
    rows = g.arcs.select("src", "dst").distinct().withColumn("before", before)
    first = floor_log2(F.abs(F.col("src") - F.col("dst")) + 1)
    cost = F.when(F.col("before").isNull(), first).otherwise(floor_log2(F.col("dst") - F.col("before")))
    return rows.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("cost"))


def cumulative_degrees(g: Graph) -> DataFrame:
    """(id, arcs_before) for ids 0..n: how many arcs the nodes before each one have.

    Blocks of nodes are summed first and their running sums added back, so no task sees all nodes.
    """
    block = 1 << 16
    d = outdegrees(g).withColumn("block", F.floor(F.col("id") / block).cast("long"))
    totals = d.groupBy("block").agg(F.sum("degree").alias("size"))
    starts = totals.select("block", (F.sum("size").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("start"))
    own = F.sum("degree").over(W.partitionBy("block").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    after = d.withColumn("own", own).join(starts, "block").select((F.col("id") + 1).alias("id"), (F.col("start") + F.col("own")).alias("arcs_before"))
    return after.union(g.arcs.sparkSession.range(1).select("id", F.lit(0).cast("long").alias("arcs_before")))


def balanced_cutpoints(g: Graph, parts: int) -> list[int]:
    """Node ids that split the graph in ranges of about equally many arcs: 0 first, n last."""
    m = g.num_arcs()
    if not m or parts <= 1:
        return [0, g.n]
    goals = g.arcs.sparkSession.createDataFrame([(i * m // parts,) for i in range(1, parts)], "goal long")
    dcf = cumulative_degrees(g)
    cut = dcf.join(F.broadcast(goals), F.col("arcs_before") >= F.col("goal")).groupBy("goal").agg(F.min("id").alias("id"))
    return sorted({0, g.n, *(r["id"] for r in cut.collect())})


#: Bits that a whole number x >= 0 takes under each code.
def code_lengths(x: Column) -> dict[str, Column]:
    log1 = floor_log2(x + 1)
    out = {"unary": x + 1, "gamma": 2 * log1 + 1, "delta": log1 + 2 * floor_log2(log1 + 1) + 1}
    for k in range(2, 6):
        h = F.floor(log1 / k)
        left = F.pow(F.lit(2.0), h * k).cast("long")
        top = F.pow(F.lit(2.0), (h + 1) * k).cast("long") - left
        # minimal binary of x + 1 - 2^(hk) below 2^((h+1)k) - 2^(hk)
        s = floor_log2(top - 1) + 1
        short = F.pow(F.lit(2.0), s).cast("long") - top
        out[f"zeta{k}"] = h + 1 + F.when(x + 1 - left < short, s - 1).otherwise(s)
    return out


def code_sizes(g: Graph) -> DataFrame:
    """(part, code, bits): bits of outdegrees, first distances and gaps under each code, without references."""
    before = F.lag("dst").over(W.partitionBy("src").orderBy("dst"))
    rows = g.arcs.select("src", "dst").distinct().withColumn("before", before)
    gaps = rows.select(
        F.when(F.col("before").isNull(), F.lit("first")).otherwise(F.lit("gap")).alias("part"),
        F.when(F.col("before").isNull(), zigzag(F.col("dst") - F.col("src"))).otherwise(F.col("dst") - F.col("before") - 1).alias("x"),
    )
    values = gaps.union(outdegrees(g).select(F.lit("outdegree").alias("part"), F.col("degree").alias("x")))
    sums = values.groupBy("part").agg(*[F.sum(c).cast("long").alias(k) for k, c in code_lengths(F.col("x")).items()])
    names = list(code_lengths(F.lit(0)))
    return sums.unpivot("part", names, "code", "bits")


def component_sizes(components: DataFrame) -> DataFrame:
    """(component, size)."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def size_distribution(components: DataFrame) -> DataFrame:
    """(size, components)."""
    return component_sizes(components).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def arg_max(values: DataFrame, by: str, tie: str | None = None, where: Column | None = None):
    """The id of the largest value; of ties the one of larger ``tie``, then the smallest id. None without rows."""
    rows = values.where(where) if where is not None else values
    key = [F.col(by), *([F.col(tie)] if tie else []), -F.col("id")]
    return rows.agg(F.max_by("id", F.struct(*key))).first()[0]


def arg_min(values: DataFrame, by: str, tie: str | None = None, where: Column | None = None):
    rows = values.where(where) if where is not None else values
    key = [F.col(by), *([F.col(tie)] if tie else []), F.col("id")]
    return rows.agg(F.min_by("id", F.struct(*key))).first()[0]
