"""Layered label propagation, and the orders it gives."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.predicates import State, Stop, max_updates, min_gain
from lattica.model import Graph
from lattica.operators import packed
from lattica.operators.stats import log_gap_cost
from lattica.operators.transform import global_rank, permute, ranks_of_labels
from lattica.plans.loop import cut


@dataclass
class Layer:
    gamma: float
    labels: DataFrame  # (id, label)
    updates: int
    cost: int | None = None


def propagate(g: Graph, gamma: float, seed: int = 0, stop: Stop | None = None, max_rounds: int = 100) -> Layer:
    """Labels of one layer of a symmetric graph without loops.

    Every node starts with a label of its own. In each round a seeded half of the nodes that have a changed
    neighbour takes the label of largest (1 + gamma) count - gamma (volume + 1): count is how many neighbours
    have it, volume how many nodes. The own label competes; ties go by a seeded hash. Rounds end by ``stop``
    (gain of the objective, modified nodes, updates) or when nothing changes in two halves running.

    Graphs of up to ``packed.PACKED_ARCS`` arcs run in one task, packed; larger ones take a few joins a round. The
    labels are the same.
    """
    stop = stop if stop is not None else (min_gain() | max_updates(max_rounds))
    if 0 < g.n and 0 < max_rounds and packed.fits(g):
        return _propagate_packed(g, gamma, seed, stop, max_rounds)
    arcs = g.arcs.select("src", "dst").persist()
    m = arcs.count()
    state = cut(g.nodes.select("id", F.col("id").alias("label"), F.lit(True).alias("active")))
    quiet, window, objective, updates = 0, [1.0] * 10, 0.0, 0
    for r in range(max_rounds):
        turn = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r // 2)), F.lit(2)) == r % 2
        movers = state.where("active").where(turn).select(F.col("id").alias("src"), F.col("label").alias("own"))
        votes = arcs.join(movers, "src").join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("k"))
        votes = votes.union(movers.select("src", F.col("own").alias("label"), F.lit(0).cast("long").alias("k"))).groupBy("src", "label").agg(F.sum("k").alias("k"))
        volume = state.groupBy("label").agg(F.count(F.lit(1)).alias("volume"))
        scored = votes.join(volume, "label").join(movers, "src")
        others = F.col("volume") - F.when(F.col("label") == F.col("own"), 1).otherwise(0)
        value = F.lit(1 + gamma) * F.col("k") - F.lit(gamma) * (others + 1)
        best = scored.groupBy("src").agg(F.max(F.struct(value.alias("value"), F.xxhash64("src", "label", F.lit(seed), F.lit(r)).alias("tie"), "label")).alias("best"), F.first("own").alias("own"), F.max(F.when(F.col("label") == F.col("own"), value)).alias("stay"))
        best = cut(best.select(F.col("src").alias("id"), F.col("best.label").alias("new"), (F.col("best.value") - F.col("stay")).alias("delta"), "own"))
        moved = best.where("new != own")
        row = moved.agg(F.count(F.lit(1)), F.coalesce(F.sum("delta"), F.lit(0.0))).first()
        modified, delta = row[0], row[1]
        touched = arcs.join(moved.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct().withColumn("touched", F.lit(True))
        state = state.join(moved.select("id", "new"), "id", "left").join(touched, "id", "left")
        asked = F.col("active") & ~turn
        state = cut(state.select("id", F.coalesce("new", "label").alias("label"), (asked | F.coalesce("touched", F.lit(False))).alias("active")))
        objective += delta
        gain = delta / objective if objective else 0.0
        window = [*window[1:], gain]
        updates = r + 1
        quiet = quiet + 1 if modified == 0 else 0
        if quiet >= 2 or stop(State(iteration=r, gain=gain if modified else None, mean_improvement=sum(window) / len(window), modified=modified, nodes=g.n, arcs=m)):
            break
    arcs.unpersist()
    return Layer(gamma, state.select("id", "label"), updates)


def _propagate_packed(g: Graph, gamma: float, seed: int, stop: Stop, max_rounds: int) -> Layer:
    n = g.n

    def run(batches):
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        src, dst = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int32) for i in (0, 1))
        del held
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        at = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
        ids = np.arange(n)
        label, active = ids.copy(), np.ones(n, bool)
        quiet, window, objective, updates = 0, [1.0] * 10, 0.0, 0
        for r in range(max_rounds):
            turn = (packed.xxhash64(ids, seed, r // 2) & 1) == r % 2
            movers = np.flatnonzero(active & turn)
            degree = at[movers + 1] - at[movers]
            near = dst[packed.ranges(at[movers], degree)]
            # the own label stands once more in each mover's votes, and does not count
            votes = np.concatenate([np.repeat(np.arange(len(movers)), degree) * n + label[near], np.arange(len(movers)) * n + label[movers]])
            votes, k = np.unique(votes, return_counts=True)
            who, what = votes // n, votes % n
            mine = what == label[movers[who]]
            volume = np.bincount(label, minlength=n)
            value = (1 + gamma) * (k - mine).astype(np.float64) - gamma * (volume[what] - mine + 1)
            # every mover has a vote at least, its own; of the largest values the last by (tie, label) counts
            top = np.maximum.reduceat(value, np.searchsorted(who, np.arange(len(movers)))) if len(movers) else value
            can = np.flatnonzero(value == top[who])
            tie = packed.xxhash64(movers[who[can]], what[can], seed, r)
            best = can[np.lexsort((what[can], tie, who[can]))]
            last = np.flatnonzero(np.append(who[best][1:] != who[best][:-1], True)) if len(best) else np.zeros(0, np.int64)
            best, stay = best[last], value[mine]
            new, moved = what[best], what[best] != label[movers]
            modified, delta = int(moved.sum()), float((value[best] - stay)[moved].sum())
            label[movers[moved]] = new[moved]
            gone = np.zeros(n, bool)
            gone[movers[moved]] = True
            active &= ~turn
            active[src[gone[dst]]] = True
            objective += delta
            gain = delta / objective if objective else 0.0
            window = [*window[1:], gain]
            updates = r + 1
            quiet = quiet + 1 if modified == 0 else 0
            if quiet >= 2 or stop(State(iteration=r, gain=gain if modified else None, mean_improvement=sum(window) / len(window), modified=modified, nodes=n, arcs=len(src))):
                break
        for a in range(0, n, 100_000):
            part = label[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 100_000]), pa.array(part), pa.array(np.full(len(part), updates, np.int32))], ["id", "label", "updates"])

    arcs = g.arcs.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    # one task, even for a table of no arcs, which may have no partition
    out = cut(arcs.repartition(1).mapInArrow(run, "id long, label long, updates int"))
    first = out.select("updates").first()
    if first is None:
        return Layer(gamma, g.nodes.select("id", F.col("id").alias("label")), 0)
    return Layer(gamma, out.select("id", "label"), first[0])


def layers(g: Graph, gammas: list[float], seed: int = 0, stop: Stop | None = None, max_rounds: int = 100) -> list[Layer]:
    """A layer for each gamma, ascending, each with the log-gap cost of the graph in the order its labels give."""
    out = []
    for i, gamma in enumerate(sorted(gammas)):
        layer = propagate(g, gamma, seed + i, stop, max_rounds)
        layer.cost = log_gap_cost(permute(g, ranks_of_labels(layer.labels), check=False)).first()[0]
        out.append(layer)
    return out


def combine_pair(result: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): labels that tell apart what either labelling does, close ones close.

    Nodes stand by (the first labelling's label of the node that the second one's label names, the second's
    label, the first's, id); a new number starts where the pair of labels changes.
    """
    r = result.select("id", F.col("label").alias("r"))
    both = r.join(labels.select("id", F.col("label").alias("l")), "id").join(r.select(F.col("id").alias("l"), F.col("r").alias("rl")), "l")
    ranked = global_rank(both, "rl", "l", "r", "id")
    # the first row of each pair of labels starts a number; only these firsts are numbered
    starts = ranked.groupBy("r", "l").agg(F.min("rank").alias("start"))
    numbers = global_rank(starts, "start").select("r", "l", F.col("rank").alias("label"))
    return ranked.join(numbers, ["r", "l"]).select("id", "label")


def combine(found: list[Layer]) -> DataFrame:
    """(id, label) from all layers: by falling cost, each combined with what is there and then with the cheapest one again."""
    order = sorted(found, key=lambda x: -(x.cost if x.cost is not None else 0))
    best = order[-1].labels
    result = best
    for layer in order:
        result = cut(combine_pair(result, layer.labels))
        result = cut(combine_pair(result, best))
    return result


def layered_order(g: Graph, gammas: list[float] | None = None, seed: int = 0, stop: Stop | None = None, max_rounds: int = 100) -> DataFrame:
    """(id, new_id): the permutation of all layers combined. Gammas default to 1, 1/2, ... 1/1024."""
    gammas = gammas if gammas is not None else parse_gammas([f"-{k}" for k in range(11)])
    return ranks_of_labels(combine(layers(g, gammas, seed, stop, max_rounds)))


def parse_gammas(texts: list[str]) -> list[float]:
    """``k-j`` stands for k / 2^j; ``-j`` for 1 / 2^j; ``k`` for k."""
    out = []
    for t in texts:
        k, dash, j = t.partition("-")
        out.append((int(k) if k else 1) / 2 ** (int(j) if dash else 0))
    return out


def running(labels: DataFrame) -> DataFrame:
    """(label, nodes, before): sizes of labels and nodes of smaller labels; as many rows as labels."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.withColumn("before", F.sum("nodes").over(W.orderBy("label").rowsBetween(W.unboundedPreceding, -1)))
