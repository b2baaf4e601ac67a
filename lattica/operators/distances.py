"""Distances: exact balls by bit-parallel visits, register sketches for large graphs, eccentricities, radius and diameter."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.model import Graph
from lattica.operators import packed
from lattica.operators.components import strong_components
from lattica.operators.transform import transpose
from lattica.operators.visits import bfs
from lattica.plans.loop import cut

#: Pairs of nodes up to which exact all-pairs distances are computed.
EXACT_PAIRS = 2_000_000_000


def all_distances(g: Graph, max_distance: int | None = None) -> DataFrame:
    """(root, id, distance) of every pair with a path, each node at distance 0 from itself.

    One frontier loop over all roots together; as the pairs may be as many as n^2, larger graphs are refused.
    """
    if g.n * g.n > EXACT_PAIRS:
        raise ValueError(f"{g.n} nodes are too many for exact distances; use ball_sketches()")
    arcs = g.arcs.select("src", "dst").where("src != dst").distinct()
    seen = frontier = cut(g.nodes.select(F.col("id").alias("root"), "id", F.lit(0).alias("distance")))
    d = 0
    while frontier.take(1) and (max_distance is None or d < max_distance):
        d += 1
        step = frontier.select("root", F.col("id").alias("src")).join(arcs, "src").select("root", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("distance", F.lit(d)))
        seen = cut(seen.union(frontier)) if d % 8 == 0 else seen.union(frontier)
    return seen


def ball_sizes(g: Graph) -> DataFrame:
    """(root, distance, size): how many nodes are at each distance from each node, itself at 0; no pair becomes a row.

    The arcs travel packed to every task (up to ``packed.PACKED_ARCS``); a task takes blocks of roots, and visits from all
    roots of a block at once. Larger graphs go through ``all_distances`` and its limit.
    """
    spark = g.arcs.sparkSession
    if not packed.fits(g):
        return all_distances(g).groupBy("root", "distance").agg(F.count(F.lit(1)).alias("size"))
    (src, dst), n, size = packed.collected(g), g.n, packed.BLOCK_ROOTS
    blocks = -(-n // size)

    def visit(batches):
        lists = None
        for batch in batches:
            for block in batch.column("id").to_pylist():
                lists = lists or (packed.Lists.of(n, src, dst), packed.Lists.of(n, dst, src))
                root, distance, nodes = packed.ball_sizes(*lists, n, block * size, min(size, n - block * size))
                rows = [pa.array(root.astype(np.int64)), pa.array(distance.astype(np.int32)), pa.array(nodes)]
                yield pa.RecordBatch.from_arrays(rows, ["root", "distance", "size"])

    parts = max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism))
    return cut(spark.range(0, blocks, 1, parts).mapInArrow(visit, "root long, distance int, size long"), "balls")


def _size(pairs: DataFrame) -> Column:
    return F.col("size") if "size" in pairs.columns else F.lit(1).cast("long")


def neighbourhood_function(pairs: DataFrame) -> DataFrame:
    """(distance, pairs): pairs within each distance. ``pairs`` may be pairs or ball sizes."""
    from pyspark.sql import Window as W

    at = pairs.groupBy("distance").agg(F.sum(_size(pairs)).alias("here"))  # a row a distance
    return at.select("distance", F.sum("here").over(W.orderBy("distance").rowsBetween(W.unboundedPreceding, 0)).alias("pairs"))


def centralities(pairs: DataFrame, discount: Callable[[int], float] | None = None) -> DataFrame:
    """Per node, of the distances of paths that leave it: reachable nodes, sum of distances, harmonic, closeness, Lin, Nieminen.

    ``pairs`` may be pairs or ball sizes.
    """
    size = _size(pairs)
    inverse = F.sum(F.when(F.col("distance") > 0, size / F.col("distance")).otherwise(0.0))
    aggs = [F.sum(size).alias("reachable"), F.sum(size * F.col("distance")).alias("total"), inverse.alias("harmonic")]
    if discount is not None:
        top = pairs.agg(F.max("distance")).first()[0] or 0
        values = F.array(*[F.lit(float(discount(i)) if i else 0.0) for i in range(top + 1)])
        aggs.append(F.sum(size * F.element_at(values, F.col("distance") + 1)).alias("discounted"))
    out = pairs.groupBy(F.col("root").alias("id")).agg(*aggs)
    return from_sums(out)


def from_sums(sums: DataFrame) -> DataFrame:
    """Adds closeness, Lin's and Nieminen's indices to (reachable, total)."""
    s, c = F.col("total"), F.col("reachable")
    return sums.withColumns({
        "closeness": F.when(s == 0, 0.0).otherwise(1.0 / s), "lin": F.when(s == 0, 1.0).otherwise(c * c / s), "nieminen": (c * c - s).cast("double"),
    })


def eccentricities(pairs: DataFrame) -> DataFrame:
    """(id, forward, backward): the largest finite distance from and to each node."""
    out = pairs.groupBy(F.col("root").alias("id")).agg(F.max("distance").alias("forward"))
    into = pairs.groupBy("id").agg(F.max("distance").alias("backward"))
    return out.join(into, "id")


def exact_eccentricities(g: Graph) -> DataFrame:
    """(id, forward, backward) as ``eccentricities`` has them, from ball sizes of the graph and of its transpose."""
    far = [ball_sizes(x).groupBy(F.col("root").alias("id")).agg(F.max("distance").alias(name)) for x, name in ((g, "forward"), (transpose(g), "backward"))]
    return far[0].join(far[1], "id")


def default_radial(g: Graph) -> DataFrame:
    """(id) of the nodes that reach the largest strong component (of equal ones the one of the smallest node)."""
    sizes = strong_components(g)
    top = sizes.groupBy("component").agg(F.count(F.lit(1)).alias("k")).agg(F.max_by("component", F.struct(F.col("k"), -F.col("component")))).first()[0]
    return bfs(transpose(g), sizes.where(F.col("component") == top).select("id")).select("id")


@dataclass
class Extremes:
    diameter: int
    diametral: int
    radius: int | None
    radial: int | None


def extremes(ecc: DataFrame, radial: DataFrame) -> Extremes:
    """Diameter and radius with their smallest nodes; no radius without radial nodes."""
    top = ecc.agg(F.max(F.struct(F.col("forward"), (-F.col("id")).alias("m")))).first()[0]
    low = ecc.join(radial.select("id").distinct(), "id").agg(F.min(F.struct("forward", "id"))).first()[0]
    return Extremes(top["forward"], -top["m"], low["forward"] if low else None, low["id"] if low else None)


# Sketches


def _registers(log2m: int, seed: int):
    """(register index, rank) of a node's hash."""
    h = F.xxhash64("id", F.lit(seed))
    index = F.pmod(h, F.lit(1 << log2m)).cast("int")
    rest = F.shiftrightunsigned(h, log2m)
    # trailing zeros of what is left, plus one
    low = rest.bitwiseAND(-rest)
    rank = F.when(rest == 0, 64 - log2m + 1).otherwise(F.length(F.bin(low)))
    return index, rank.cast("tinyint")


def estimate(registers: str = "regs"):
    """Cardinality of an array of registers, with the correction for small sets."""
    m = F.size(registers)
    alpha = F.when(m == 16, 0.673).when(m == 32, 0.697).when(m == 64, 0.709).otherwise(F.lit(0.7213) / (1 + F.lit(1.079) / m))
    inverse = F.aggregate(registers, F.lit(0.0), lambda a, r: a + F.pow(F.lit(2.0), -r.cast("double")))
    zeros = F.aggregate(registers, F.lit(0), lambda a, r: a + F.when(r == 0, 1).otherwise(0))
    raw = alpha * m * m / inverse
    return F.when((raw <= 2.5 * m) & (zeros > 0), m * F.log(m / zeros)).otherwise(raw)


@dataclass
class BallSketches:
    sums: DataFrame  # (id, reachable, total, harmonic, discounted, closeness, lin, nieminen)
    neighbourhood: list[float]
    iterations: int


def ball_sketches(g: Graph, log2m: int = 6, seed: int = 0, max_iterations: int | None = None, threshold: float | None = None, discount: Callable[[int], float] | None = None, weights: DataFrame | None = None) -> BallSketches:
    """Approximate balls of growing radius: one sketch a node, merged with its successors' until none changes.

    Of ``(id, weight)`` nodes count as so many elements. The sums are of paths that leave a node; give the transpose for the
    others. With a threshold the loop also ends after the third iteration when the neighbourhood function grows
    by less. In each iteration only changed sketches are sent, and registers are merged as single rows that
    are pre-aggregated before the shuffle: no list of neighbours is ever gathered.
    """
    if not 4 <= log2m <= 16:
        raise ValueError(f"log2m is in 4..16: {log2m}")
    m = 1 << log2m
    index, rank = _registers(log2m, seed)
    elements = g.nodes
    if weights is not None:
        copies = F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))
        spread = g.nodes.join(weights.where("weight > 0"), "id").select(F.col("id").alias("owner"), copies.alias("copy"))
        elements = spread.select("owner", F.xxhash64("owner", "copy").alias("id"))
    else:
        elements = g.nodes.select(F.col("id").alias("owner"), "id")
    seeds = elements.select("owner", index.alias("i"), rank.alias("r")).groupBy("owner", "i").agg(F.max("r").alias("r"))
    entries = seeds.groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("i", "r"))).alias("e"))  # at most m registers
    blank = F.array_repeat(F.lit(0).cast("tinyint"), m)
    filled = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.coalesce(F.element_at("e", i.cast("int")), F.lit(0).cast("tinyint")))
    state = g.nodes.join(entries, F.col("id") == F.col("owner"), "left").select("id", F.when(F.col("e").isNull(), blank).otherwise(filled).alias("regs"))
    state = state.withColumns({"size": estimate(), "changed": F.lit(True), "total": F.lit(0.0), "harmonic": F.lit(0.0), "discounted": F.lit(0.0)})
    state = cut(state)
    arcs = g.arcs.select("src", "dst").where("src != dst").distinct().persist()
    nf, t = [float(g.n)], 0
    while g.n and (max_iterations is None or t < min(max_iterations, g.n)):
        t += 1
        sent = arcs.join(state.where("changed").select(F.col("id").alias("dst"), "regs"), "dst")
        rows = sent.select("src", F.posexplode("regs").alias("i", "r")).where("r > 0").groupBy("src", "i").agg(F.max("r").alias("r"))
        merged = rows.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("i", "r"))).alias("e"))  # at most m registers
        joined = state.join(merged, F.col("id") == F.col("src"), "left")
        new = F.when(F.col("e").isNull(), F.col("regs")).otherwise(F.transform("regs", lambda r, i: F.greatest(r, F.coalesce(F.element_at("e", i), F.lit(0).cast("tinyint")))))
        joined = joined.withColumn("new", new).withColumn("changed", F.coalesce(F.col("new") != F.col("regs"), F.lit(False)))
        joined = joined.withColumn("regs", F.col("new")).withColumn("now", F.when(F.col("changed"), estimate()).otherwise(F.col("size")))
        delta = F.greatest(F.col("now") - F.col("size"), F.lit(0.0))
        f = float(discount(t)) if discount is not None else 0.0
        state = cut(joined.select("id", "regs", F.col("now").alias("size"), "changed", (F.col("total") + delta * t).alias("total"), (F.col("harmonic") + delta / t).alias("harmonic"), (F.col("discounted") + delta * f).alias("discounted")))
        row = state.agg(F.sum("size"), F.sum(F.col("changed").cast("long"))).first()
        nf.append(max(nf[-1], row[0] or 0.0))
        if not row[1] or (threshold is not None and t > 3 and nf[-1] / nf[-2] < 1 + threshold):
            break
    arcs.unpersist()
    sums = from_sums(state.select("id", F.col("size").alias("reachable"), "total", "harmonic", "discounted"))
    return BallSketches(sums, nf, t)


def relative_error(log2m: int) -> float:
    return 1.06 / math.sqrt(1 << log2m)


# Eccentricities by bounding


@dataclass
class SumSweep:
    bounds: DataFrame  # (id, low_f, up_f, low_b, up_b)
    extremes: Extremes
    visits: int


def sum_sweep(g: Graph, radial: DataFrame | None = None, level: str = "all", max_visits: int = 1000) -> SumSweep:
    """Exact eccentricities, radius or diameter from as few breadth-first visits as bounds allow.

    ``level``: all, forward, radius_diameter, diameter, radius. Each visit from a node gives its own eccentricity
    and bounds the others': a node at distance d has at least d, and at most what the node's strong component
    can add. The next node is the one with the widest claim on what is still open.
    """
    if g.n == 0:
        raise ValueError("an empty graph has no eccentricities")
    if level not in ("all", "forward", "radius_diameter", "diameter", "radius"):
        raise ValueError(f"unknown level {level}")
    back = transpose(g)
    scc = cut(strong_components(g))
    radial = cut((radial if radial is not None else default_radial(g)).select("id").distinct())
    far = g.n + 1
    state = g.nodes.join(scc, "id").join(radial.withColumn("radial", F.lit(True)), "id", "left")
    state = cut(state.select("id", "component", F.coalesce("radial", F.lit(False)).alias("radial"), F.lit(0).alias("low_f"), F.lit(far).alias("up_f"), F.lit(0).alias("low_b"), F.lit(far).alias("up_b"), F.lit(0.0).alias("tot_f"), F.lit(0.0).alias("tot_b")))
    visits = 0
    succ = g.arcs.groupBy("src").agg(F.count(F.lit(1)).alias("d"))

    def open_rows(s: DataFrame) -> DataFrame:
        top = F.max("low_f")
        best = s.agg(top.alias("diameter"), F.max("low_b").alias("diameter_b"), F.min(F.when(F.col("radial") & (F.col("low_f") == F.col("up_f")), F.col("low_f"))).alias("radius")).first()
        open_f, open_b = F.col("low_f") < F.col("up_f"), F.col("low_b") < F.col("up_b")
        longest = max(best["diameter"], best["diameter_b"])
        # a diameter needs every start or every end bounded by it
        need_d_f, need_d_b = open_f & (F.col("up_f") > longest), open_b & (F.col("up_b") > longest)
        need_r = F.col("radial") & open_f & (F.col("low_f") < (best["radius"] if best["radius"] is not None else far))
        if level == "all":
            return s.withColumns({"need_f": open_f, "need_b": open_b})
        if level == "forward":
            return s.withColumns({"need_f": open_f, "need_b": F.lit(False)})
        need_f = F.lit(False)
        diameter_done = level == "radius" or not s.where(need_d_f).take(1) or not s.where(need_d_b).take(1)
        if not diameter_done:
            need_f = need_f | need_d_f
        if level != "diameter":
            need_f = need_f | need_r
        return s.withColumns({"need_f": need_f, "need_b": F.lit(False)})

    def both(s: DataFrame, node: int) -> DataFrame:
        """Visits from and to a node: exact values for it, and upper bounds for its strong component."""
        ahead, behind = cut(bfs(g, [node]).select("id", F.col("distance").alias("df"))), cut(bfs(back, [node]).select("id", F.col("distance").alias("db")))
        ecc_f, ecc_b = ahead.agg(F.max("df")).first()[0], behind.agg(F.max("db")).first()[0]
        s = s.join(ahead, "id", "left").join(behind, "id", "left")
        inside = F.col("df").isNotNull() & F.col("db").isNotNull()
        mine = F.col("id") == node
        s = s.withColumns({
            "low_b": F.greatest("low_b", F.coalesce("df", F.lit(0)), F.when(inside, F.lit(ecc_b) - F.col("db")).otherwise(0)),
            "low_f": F.greatest("low_f", F.coalesce("db", F.lit(0)), F.when(inside, F.lit(ecc_f) - F.col("df")).otherwise(0)),
            "up_f": F.when(mine, F.lit(ecc_f)).when(inside, F.least("up_f", F.col("db") + F.lit(ecc_f))).otherwise(F.col("up_f")),
            "up_b": F.when(mine, F.lit(ecc_b)).when(inside, F.least("up_b", F.col("df") + F.lit(ecc_b))).otherwise(F.col("up_b")),
            "tot_f": F.col("tot_f") + F.coalesce("db", F.lit(0)), "tot_b": F.col("tot_b") + F.coalesce("df", F.lit(0)),
        })
        s = s.withColumns({"low_f": F.when(mine, F.lit(ecc_f)).otherwise(F.col("low_f")), "low_b": F.when(mine, F.lit(ecc_b)).otherwise(F.col("low_b"))})
        return cut(s.drop("df", "db"))

    start = g.nodes.join(succ, F.col("id") == F.col("src"), "left").agg(F.max_by("id", F.struct(F.coalesce("d", F.lit(0)), -F.col("id")))).first()[0]
    node = start
    while True:
        state = both(state, node)
        visits += 2
        rows = open_rows(state).where("need_f or need_b")
        pick = rows.agg(F.max_by("id", F.struct(F.greatest(F.col("up_f") - F.col("low_f"), F.col("up_b") - F.col("low_b")), F.col("tot_f") + F.col("tot_b"), -F.col("id")))).first()[0]
        if pick is None:
            break
        if visits >= max_visits:
            raise RuntimeError(f"still open after {visits} visits")
        node = pick
    ecc = state.select("id", F.col("low_f").alias("forward"))
    known = ecc if level in ("all", "forward") else state.where("low_f = up_f").select("id", F.col("low_f").alias("forward"))
    found = extremes(ecc, radial) if level in ("all", "forward") else None
    if found is None:
        longest = state.agg(F.greatest(F.max("low_f"), F.max("low_b"))).first()[0]
        low = known.join(radial, "id").agg(F.min(F.struct("forward", "id"))).first()[0]
        who = state.where(f"low_f = {longest} or low_b = {longest}").agg(F.min("id")).first()[0]
        found = Extremes(longest, who, low["forward"] if low else None, low["id"] if low else None)
    return SumSweep(state.select("id", "low_f", "up_f", "low_b", "up_b"), found, visits)
