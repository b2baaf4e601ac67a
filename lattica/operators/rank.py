"""Ranking by power iteration: PageRank in three modes, BiRank on bipartite graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.predicates import State, Stop, l1_norm
from lattica.model import Graph
from lattica.plans.loop import cut

STRONG, WEAK, PSEUDO = "strong", "weak", "pseudo"


@dataclass
class Ranking:
    ranks: DataFrame  # (id, value)
    iterations: int
    l1: float | None
    linf: float | None


def pagerank(g: Graph, alpha: float = 0.85, mode: str = STRONG, preference: DataFrame | None = None, stop: Stop | None = None) -> Ranking:
    """x = x(aP + a d'u + (1 - a) 1'v): v is the preference (uniform by default), u what dangling nodes jump to.

    u is v (strong), uniform (weak) or nothing (pseudorank). Starts at v. Parallel arcs count as often as they
    stand; loops are arcs. The l1 norm that ``stop`` sees is a / (1 - a) times that of the last change. Arcs,
    with the inverse outdegree of their source, are prepared once; an iteration is one join and one aggregation.
    """
    if not 0 <= alpha < 1:
        raise ValueError(f"alpha is in [0, 1): {alpha}")
    if mode not in (STRONG, WEAK, PSEUDO):
        raise ValueError(f"unknown mode {mode}")
    stop = stop if stop is not None else l1_norm()
    if g.n == 0:
        return Ranking(g.nodes.withColumn("value", F.lit(0.0)), 0, None, None)
    degree = g.arcs.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    if preference is None:
        nodes = g.nodes.withColumn("v", F.lit(1.0 / g.n))
    else:
        nodes = g.nodes.join(preference.select("id", F.col("value").alias("v")), "id")
        if nodes.count() != g.n or preference.count() != g.n:
            raise ValueError(f"the preference must name each of {g.n} nodes once")
    nodes = cut(nodes.join(degree, F.col("id") == F.col("src"), "left").select("id", "v", F.coalesce("d", F.lit(0)).alias("d")))
    arcs = g.arcs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")).persist()
    x = nodes.withColumn("value", F.col("v"))
    iteration, l1, linf = 0, None, None
    u = {STRONG: F.col("v"), WEAK: F.lit(1.0 / g.n), PSEUDO: F.lit(0.0)}[mode]
    lost = nodes.where("d = 0").agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]
    while True:
        share = x.where("d > 0").select(F.col("id").alias("src"), (F.col("value") / F.col("d")).alias("share"))
        got = arcs.join(share, "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("times")).alias("got"))
        new = F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * u) + F.lit(1 - alpha) * F.col("v")
        x2 = x.join(got, F.col("id") == F.col("dst"), "left").select("id", "v", "d", new.alias("value"), F.abs(new - F.col("value")).alias("change"))
        x2 = cut(x2)
        row = x2.agg(F.sum("change"), F.max("change"), F.sum(F.when(F.col("d") == 0, F.col("value")))).first()
        iteration, l1, linf, lost = iteration + 1, alpha / (1 - alpha) * row[0], row[1], row[2] or 0.0
        x = x2.drop("change")
        if stop(State(iteration=iteration, l1=l1, linf=linf, nodes=g.n)):
            break
    arcs.unpersist()
    return Ranking(x.select("id", "value"), iteration, l1, linf)


def birank(g: Graph, sources: int, alpha: float = 0.85, beta: float = 0.85, preference: DataFrame | None = None, stop: Stop | None = None) -> Ranking:
    """Ranks of a bipartite graph with arcs from the first ``sources`` nodes to the others.

    With symmetric normalisation by the roots of both degrees, targets take alpha times what their sources send
    and (1 - alpha) times their preference; then sources take beta times what the new targets send and the
    rest of theirs. The preference is uniform on each side by default; the start is the preference.
    """
    if not (0 <= alpha <= 1 and 0 <= beta <= 1):
        raise ValueError("alpha and beta are in [0, 1]")
    stop = stop if stop is not None else l1_norm()
    targets = g.n - sources
    if g.arcs.where(f"src >= {sources} or dst < {sources}").take(1):
        raise ValueError(f"an arc does not lead from the first {sources} nodes to the others")
    uniform = g.nodes.withColumn("p", F.when(F.col("id") < sources, F.lit(1.0 / max(sources, 1))).otherwise(F.lit(1.0 / max(targets, 1))))
    start = uniform if preference is None else g.nodes.join(preference.select("id", F.col("value").alias("p")), "id")
    if g.n == 0 or sources == 0 or targets == 0:
        return Ranking(start.select("id", F.col("p").alias("value")), 0, None, None)
    ds = g.arcs.groupBy("src").agg(F.count(F.lit(1)).alias("ds"))
    dt = g.arcs.groupBy("dst").agg(F.count(F.lit(1)).alias("dt"))
    arcs = g.arcs.join(ds, "src").join(dt, "dst").select("src", "dst", (1 / F.sqrt(F.col("ds") * F.col("dt"))).alias("w"))
    arcs = arcs.groupBy("src", "dst").agg(F.sum("w").alias("w")).persist()
    start = cut(start)
    left, right = start.where(f"id < {sources}").withColumn("value", F.col("p")), start.where(f"id >= {sources}").withColumn("value", F.col("p"))
    iteration = 0

    def step(to: DataFrame, of: DataFrame, here: str, there: str, rate: float) -> DataFrame:
        sent = arcs.join(of.select(F.col("id").alias(there), F.col("value").alias("x")), there).groupBy(here).agg(F.sum(F.col("x") * F.col("w")).alias("got"))
        new = F.lit(rate) * F.coalesce("got", F.lit(0.0)) + F.lit(1 - rate) * F.col("p")
        return cut(to.join(sent, F.col("id") == F.col(here), "left").select("id", "p", new.alias("value"), F.abs(new - F.col("value")).alias("change")))

    while True:
        right2 = step(right, left, "dst", "src", alpha)
        left2 = step(left, right2, "src", "dst", beta)
        row = left2.union(right2).agg(F.sum("change"), F.max("change")).first()
        left, right, iteration = left2.drop("change"), right2.drop("change"), iteration + 1
        if stop(State(iteration=iteration, l1=row[0], linf=row[1], nodes=g.n)):
            break
    arcs.unpersist()
    return Ranking(left.union(right).select("id", "value"), iteration, row[0], row[1])
