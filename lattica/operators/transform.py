"""Transformations of graphs: each is one declarative plan over the arc table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.model import Graph


def _rest(arcs: DataFrame) -> list[str]:
    return [c for c in arcs.columns if c not in ("src", "dst")]


def transpose(g: Graph) -> Graph:
    """Every arc reversed; labels and repeated arcs stay. No shuffle."""
    return g.with_arcs(g.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *_rest(g.arcs)))


def without_loops(g: Graph) -> Graph:
    return g.with_arcs(g.arcs.where("src != dst"))


def symmetrize(g: Graph, loops: bool = True) -> Graph:
    """Both directions of every arc, once; loops once, or not at all."""
    both = F.explode(F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    arcs = g.arcs if loops else g.arcs.where("src != dst")
    return g.with_arcs(arcs.select(both.alias("a")).select("a.src", "a.dst").distinct())


def dedup(g: Graph, keep: Column | None = None) -> Graph:
    """Repeated arcs once. With labels the one of the smallest label stays, or of the smallest ``keep``."""
    if not g.labelled:
        return g.with_arcs(g.arcs.select("src", "dst").distinct())
    first = F.min_by("label", keep) if keep is not None else F.min("label")
    return g.with_arcs(g.arcs.groupBy("src", "dst").agg(first.alias("label")))


def last_write_wins(g: Graph, order: str) -> Graph:
    """Of repeated arcs the label written last, by the column ``order``."""
    return g.with_arcs(g.arcs.groupBy("src", "dst").agg(F.max_by("label", order).alias("label")))


def remove_arcs(g: Graph, gone: DataFrame) -> Graph:
    return g.with_arcs(g.arcs.join(gone.select("src", "dst"), ["src", "dst"], "left_anti"))


def union(a: Graph, b: Graph) -> Graph:
    """Arcs of either graph, once, over the larger node range."""
    return a.with_arcs(a.arcs.select("src", "dst").union(b.arcs.select("src", "dst")).distinct(), max(a.n, b.n))


def _renumbered(g: Graph, mapping: DataFrame) -> DataFrame:
    to = mapping.select(F.col("id").alias("_id"), F.col("new_id").alias("_new"))
    arcs = g.arcs.join(to, F.col("src") == F.col("_id")).drop("_id", "src").withColumnRenamed("_new", "src")
    return arcs.join(to, F.col("dst") == F.col("_id")).drop("_id", "dst").withColumnRenamed("_new", "dst").select("src", "dst", *_rest(g.arcs))


def _covers(g: Graph, mapping: DataFrame, what: str) -> None:
    found = mapping.where(F.col("id").between(0, g.n - 1)).agg(F.countDistinct("id").alias("ids"), F.count(F.lit(1)).alias("rows")).first()
    if found["ids"] != g.n or found["rows"] != g.n or mapping.count() != g.n:
        raise ValueError(f"{what} has {found['rows']} of {g.n} nodes")


def permute(g: Graph, perm: DataFrame, check: bool = True) -> Graph:
    """Node x becomes ``new_id`` of x in ``perm(id, new_id)``; arcs and labels stay as many."""
    if check:
        _covers(g, perm, "the permutation")
    return g.with_arcs(_renumbered(g, perm))


def map_nodes(g: Graph, mapping: DataFrame, n: int | None = None, check: bool = True) -> Graph:
    """Nodes under any function; arcs that meet are one. ``n`` defaults to 1 + the largest image."""
    if check:
        _covers(g, mapping, "the map")
    largest = mapping.agg(F.max("new_id")).first()[0]
    size = (largest + 1 if largest is not None else 0) if n is None else n
    if largest is not None and largest >= size:
        raise ValueError(f"the map reaches node {largest} of {size}")
    return g.with_arcs(_renumbered(g, mapping).select("src", "dst").distinct(), size)


def sort_arcs(g: Graph, parts: int | None = None, unique: bool = False) -> Graph:
    """Arcs range-partitioned by src and sorted within: the layout that prunes scans and compresses best."""
    if g.arcs.where(f"src < 0 or src >= {g.n}").take(1):
        raise ValueError(f"a source is not below {g.n}")
    g = dedup(g) if unique else g
    arcs = g.arcs.repartitionByRange(parts, "src") if parts else g.arcs.repartitionByRange("src")
    return g.with_arcs(arcs.sortWithinPartitions("src", "dst"))


def positions(labels: DataFrame) -> DataFrame:
    """With ``pos``: the place of each arc among its node's, ascending by dst."""
    return labels.withColumn("pos", F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1)


def zip_labels(a: Graph, b: Graph) -> Graph:
    """Labels paired by node and place; a node has as many as the shorter list."""
    left = positions(a.arcs).select("src", "pos", "dst", *([F.col("label").alias("left")] if a.labelled else [F.col("dst").alias("left")]))
    right = positions(b.arcs).select("src", "pos", *([F.col("label").alias("right")] if b.labelled else [F.col("dst").alias("right")]))
    return a.with_arcs(left.join(right, ["src", "pos"]).select("src", "dst", F.struct("left", "right").alias("label")))


def project(g: Graph, side: str) -> Graph:
    """One side (``left`` or ``right``) of paired labels."""
    return g.with_arcs(g.arcs.select("src", "dst", F.col(f"label.{side}").alias("label")))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    """Each ordered pair of different nodes is an arc with probability p, by a hash of the pair and the seed.

    Per node the targets are a generated sequence, tested in place: the pairs are never shuffled.
    """
    if not 0 <= p <= 1:
        raise ValueError(f"a probability is between 0 and 1: {p}")
    nodes = spark.range(n).withColumnRenamed("id", "src")
    pairs = nodes.select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"))).alias("dst")) if n else nodes.select("src", F.col("src").alias("dst"))
    uniform = F.shiftrightunsigned(F.xxhash64("src", "dst", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return Graph(pairs.where((F.col("src") != F.col("dst")) & (uniform < p)), n)


def differences(a: Graph, b: Graph, labels: bool = False) -> DataFrame:
    """Arcs of one graph that the other lacks, as often as it does: (src, dst[, label], side)."""
    cols = ["src", "dst"] + ["label"] * labels
    x, y = a.arcs.select(*cols), b.arcs.select(*cols)
    return x.exceptAll(y).withColumn("side", F.lit("left")).union(y.exceptAll(x).withColumn("side", F.lit("right")))


def first_difference(a: Graph, b: Graph, labels: bool = False) -> str | None:
    """None for equal graphs, else what differs first: the number of nodes, or the smallest node whose arcs do."""
    if a.n != b.n:
        return f"{a.n} and {b.n} nodes"
    node = differences(a, b, labels).agg(F.min("src")).first()[0]
    return None if node is None else f"the arcs of node {node}"


def is_symmetric(g: Graph, simple: bool = False) -> bool:
    """Whether every arc has its reverse; ``simple`` also rules out loops."""
    if simple and g.arcs.where("src = dst").take(1):
        return False
    back = transpose(g).arcs.select("src", "dst")
    return not g.arcs.join(back, ["src", "dst"], "left_anti").take(1)


# Permutations: tables (id, new_id)


def invert(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("new_id").alias("id"), F.col("id").alias("new_id"))


def compose(*perms: DataFrame) -> DataFrame:
    """The permutation that applies the given ones from left to right."""
    out = perms[0]
    for p in perms[1:]:
        out = out.select("id", F.col("new_id").alias("_k")).join(p.select(F.col("id").alias("_k"), "new_id"), "_k").select("id", "new_id")
    return out


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """With ``rank`` from 0 by ``order``, without ever gathering the rows in one partition.

    Rows are range-partitioned and written once; each partition then numbers its own and adds how many stand
    before it (one number a partition).
    """
    from lattica.plans.loop import cut

    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("size")).orderBy("_part").collect()
    spark, before, rows = df.sparkSession, 0, []
    for r in sizes:
        rows.append((r["_part"], before))
        before += r["size"]
    offsets = spark.createDataFrame(rows, "_part int, _before long")
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_part").withColumn("rank", (F.col("_before") + own - 1).cast("long")).drop("_part", "_before")


def ranks_of_labels(labels: DataFrame) -> DataFrame:
    """(id, new_id): nodes numbered by (label, id)."""
    return global_rank(labels.select("label", "id"), "label", "id").select("id", F.col("rank").alias("new_id"))


def random_permutation(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, new_id) in the order of a seeded hash."""
    keyed = spark.range(n).select(F.xxhash64("id", F.lit(seed)).alias("key"), "id")
    return global_rank(keyed, "key", "id").select("id", F.col("rank").alias("new_id"))
