"""Connected components by local contraction and star steps, strong components by colours, condensation, levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.model import Graph
from lattica.plans.loop import cut, fingerprint, forget


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node each is connected with) of the edges a-b, by hooking roots and pointer jumping."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        x, y = label[x], label[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return nodes, nodes[label]


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
    return tuple(np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition to (node, root)."""
    node, root = local_roots(*_columns(batches))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    far = both.where("dst > src")
    return far.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src != dst").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(low.select("src", F.col("low").alias("dst"))).where("src != dst").distinct()


#: Edges, after each partition has contracted its own, that one task may finish alone; they are counted first.
ONE_TASK = 1_000_000


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for every endpoint of ``edges(src, dst)``; component is the smallest id in it.

    Arcs count in both directions; loops only name their node. Empty input gives no rows. Each partition
    contracts its edges to (node, root) rows, one a node, so that a hub of any degree stands once in a
    partition's result. Up to ``one_task`` such rows are finished in one partition; more take alternating large-star and
    small-star steps, each an aggregation and an equi-join, until nothing changes.
    """
    given = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    near = cut(given.mapInArrow(_contract, "node long, root long"), "contracted")
    if near.limit(one_task + 1).count() <= one_task:
        out = cut(near.coalesce(1).mapInArrow(_contract, "node long, root long"), "components").select(F.col("node").alias("id"), F.col("root").alias("component"))
        forget(near)
        return out
    nodes = cut(near.select(F.col("node").alias("id")).distinct(), "nodes")
    e = near.where("node != root").select(F.col("node").alias("src"), F.col("root").alias("dst"))
    before, last = None, near
    while True:
        e = cut(_small_star(_large_star(e)), "stars")
        forget(last)
        after = fingerprint(e, "src", "dst")
        if after == before:
            return nodes.join(e.select(F.col("src").alias("id"), F.col("dst").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        before, last = after, e


def symmetric_components(g: Graph) -> DataFrame:
    """(id, component) of every node, components numbered from 0 by their smallest node."""
    found = connected_components(g.arcs)
    labels = g.nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    return renumber(labels)


def renumber(labels: DataFrame) -> DataFrame:
    """(id, component) from (id, label): labels numbered from 0 in ascending order."""
    from lattica.operators.transform import global_rank

    ranks = global_rank(labels.select("label").distinct(), "label")
    return labels.join(ranks, "label").select("id", F.col("rank").alias("component"))


def renumber_by_size(components: DataFrame) -> DataFrame:
    """(id, component): the largest component is 0; equal sizes in the order they had."""
    from lattica.operators.transform import global_rank

    sizes = components.groupBy("component").agg((-F.count(F.lit(1))).alias("minus"))
    ranks = global_rank(sizes, "minus", "component").select("component", "rank")
    return components.join(ranks, "component").select("id", F.col("rank").alias("component"))


def _trim(e: DataFrame, gone: list[DataFrame]) -> DataFrame:
    """Arcs left when nodes without arcs in or out go, again and again; the nodes gone are appended to ``gone``."""
    while True:
        src, dst = e.select(F.col("src").alias("id")).distinct(), e.select(F.col("dst").alias("id")).distinct()
        both = cut(src.join(dst, "id", "left_semi"))
        kept = cut(e.join(both.select(F.col("id").alias("src")), "src", "left_semi").join(both.select(F.col("id").alias("dst")), "dst", "left_semi"))
        lost = src.union(dst).distinct().join(both, "id", "left_anti")
        gone.append(cut(lost.withColumn("component", F.col("id"))))
        if not gone[-1].take(1):
            gone.pop()
            return kept
        e = kept


def _spread(e: DataFrame, start: DataFrame) -> DataFrame:
    """(id, value): the largest start value that reaches each node along e; only nodes that changed send on."""
    state = cut(start)
    changed = state
    while changed.take(1):
        sent = e.join(changed, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.max("value").alias("new"))
        merged = state.join(sent, "id", "left")
        improved = F.coalesce(F.col("new") > F.col("value"), F.lit(False))
        merged = cut(merged.select("id", F.when(improved, F.col("new")).otherwise(F.col("value")).alias("value"), improved.alias("up")))
        state, changed = merged.select("id", "value"), merged.where("up").select("id", "value")
    return state


#: Arcs up to which strong components are found on the driver: a long chain of small components costs a round each.
SMALL_ARCS = 200_000


def _tarjan(arcs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its strong component) of every endpoint, without recursion."""
    succ: dict[int, list[int]] = {}
    for a, b in arcs:
        succ.setdefault(a, []).append(b)
        succ.setdefault(b, [])
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack, on, out = [], set(), []
    for root in succ:
        if root in index:
            continue
        work = [(root, iter(succ[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for y in rest:
                if y not in index:
                    index[y] = low[y] = len(index)
                    stack.append(y)
                    on.add(y)
                    work.append((y, iter(succ[y])))
                    break
                if y in on:
                    low[node] = min(low[node], index[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    cut_at = stack.index(node, 0) if stack[-1] != node else len(stack) - 1
                    part = stack[cut_at:]
                    del stack[cut_at:]
                    on.difference_update(part)
                    least = min(part)
                    out.extend((x, least) for x in part)
    return out


def strong_components(g: Graph, small_arcs: int = SMALL_ARCS) -> DataFrame:
    """(id, component) of every node; component is the smallest id in it.

    Graphs of at most ``small_arcs`` arcs (counted first) are done on the driver; larger ones by rounds:
    Nodes that cannot lie on a cycle are trimmed. Then every node takes the largest id that reaches it as its
    colour; inside a colour, the nodes that reach the node of that id form one component and leave. Rounds
    repeat on the rest.
    """
    parts: list[DataFrame] = []
    e = cut(g.arcs.select("src", "dst").where("src != dst").distinct())
    if e.limit(small_arcs + 1).count() <= small_arcs:
        found = _tarjan([(r[0], r[1]) for r in e.collect()])
        named = g.arcs.sparkSession.createDataFrame(found, "id long, low long")
        return g.nodes.join(named, "id", "left").select("id", F.coalesce("low", "id").alias("component"))
    while True:
        e = _trim(e, parts)
        if not e.take(1):
            break
        nodes = cut(e.select(F.col("src").alias("id")).distinct())
        colour = _spread(e, nodes.withColumn("value", F.col("id")))
        inside = e.join(colour.select(F.col("id").alias("src"), F.col("value").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("value").alias("b")), "dst")
        inside = cut(inside.where("a = b").select("src", "dst"))
        found = frontier = cut(colour.where("id = value").select("id", F.col("value").alias("component")))
        while True:
            back = inside.join(frontier.select(F.col("id").alias("dst"), "component"), "dst").select(F.col("src").alias("id"), "component").distinct()
            frontier = cut(back.join(found, "id", "left_anti"))
            if not frontier.take(1):
                break
            found = cut(found.union(frontier))
        parts.append(found)
        e = cut(e.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if not parts:
        return g.nodes.select("id", F.col("id").alias("component"))
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.union(p)
    low = all_parts.groupBy("component").agg(F.min("id").alias("low"))
    named = all_parts.join(low, "component").select("id", "low")
    return g.nodes.join(named, "id", "left").select("id", F.coalesce("low", "id").alias("component"))


def condensation(g: Graph, components: DataFrame) -> DataFrame:
    """(src, dst, start, end) of the graph of components: for each pair one arc of the graph that joins them.

    It is the one of the largest indegree of its start plus outdegree of its end; of ties, of the smallest ids.
    """
    from lattica.operators.stats import indegrees, outdegrees

    c = components
    arcs = g.arcs.select("src", "dst").distinct()
    arcs = arcs.join(c.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a != b")
    arcs = arcs.join(indegrees(g).select(F.col("id").alias("src"), F.col("degree").alias("i")), "src").join(outdegrees(g).select(F.col("id").alias("dst"), F.col("degree").alias("o")), "dst")
    best = arcs.groupBy("a", "b").agg(F.max(F.struct((F.col("i") + F.col("o")).alias("w"), (-F.col("src")).alias("s"), (-F.col("dst")).alias("t"))).alias("x"))
    return best.select(F.col("a").alias("src"), F.col("b").alias("dst"), (-F.col("x.s")).alias("start"), (-F.col("x.t")).alias("end"))


def topological_levels(g: Graph) -> DataFrame:
    """(id, level): in each round the nodes without arcs from what is left go; level is the round.

    Nodes on cycles, and what they lead to, have no row.
    """
    e = cut(g.arcs.select("src", "dst").distinct())
    left = g.nodes
    out, level = None, 0
    while True:
        first = cut(left.join(e.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(level).alias("level")))
        out = first if out is None else out.union(first)
        if not first.take(1):
            return cut(out)
        left = cut(left.join(first.select("id"), "id", "left_anti"))
        e = cut(e.join(first.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1


def is_acyclic(g: Graph) -> bool:
    """No cycle, and so no loop either."""
    if g.arcs.where("src = dst").take(1):
        return False
    return not _trim(cut(g.arcs.select("src", "dst").distinct()), []).take(1)
