"""Breadth-first visits as frontier loops, and depth-first visits of bounded graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.model import Graph
from lattica.operators import packed
from lattica.plans.loop import cut

#: Arcs up to which an order that only a sequential visit can give is computed on the driver.
DRIVER_ARCS = 5_000_000


def bfs(g: Graph, roots: Iterable[int] | DataFrame, node_filter: Callable[[Column, Column, Column], Column] | None = None, max_distance: int | None = None) -> DataFrame:
    """(id, distance, pred) of every node reached from the roots, each root at distance 0 and its own pred.

    Of several possible predecessors the smallest id counts. ``node_filter(id, pred, distance)`` is asked at
    discovery, of the roots as well; a node it refuses is not visited on that way, but may be on another.

    Each level joins the frontier alone with the arcs and takes out what was visited before.
    """
    spark = g.arcs.sparkSession
    start = roots if isinstance(roots, DataFrame) else spark.createDataFrame([(int(r),) for r in roots], "id long")
    if start.where(f"id < 0 or id >= {g.n}").take(1):
        raise ValueError(f"a root is not below {g.n}")
    seen = start.select("id").distinct().withColumns({"distance": F.lit(0), "pred": F.col("id")})
    if node_filter is not None:
        seen = seen.where(node_filter(F.col("id"), F.col("pred"), F.col("distance")))
    arcs = g.arcs.select("src", "dst").where("src != dst")
    seen = frontier = cut(seen)
    distance = 0
    while frontier.take(1) and (max_distance is None or distance < max_distance):
        distance += 1
        found = arcs.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), F.col("src").alias("pred"))
        if node_filter is not None:
            found = found.where(node_filter(F.col("id"), F.col("pred"), F.lit(distance)))
        fresh = found.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("pred").alias("pred"))
        frontier = cut(fresh.select("id", F.lit(distance).alias("distance"), "pred"))
        seen = cut(seen.union(frontier)) if distance % 8 == 0 else seen.union(frontier)
    return seen


def frontier_sizes(visit: DataFrame) -> DataFrame:
    """(distance, size)."""
    return visit.groupBy("distance").agg(F.count(F.lit(1)).alias("size"))


def revisits(g: Graph, visit: DataFrame) -> DataFrame:
    """(id, pred): arcs of visited nodes that lead to a node visited already, that is all but the tree's."""
    tree = visit.where("distance > 0").select(F.col("id").alias("dst"), F.col("pred").alias("src"))
    arcs = g.arcs.select("src", "dst").join(visit.select(F.col("id").alias("src")), "src")
    return arcs.join(tree, ["src", "dst"], "left_anti").select(F.col("dst").alias("id"), F.col("src").alias("pred"))


def ball(g: Graph, root: int, radius: int) -> DataFrame:
    """(id, distance) of the nodes within ``radius`` of the root."""
    return bfs(g, [root], max_distance=radius).select("id", "distance")


def bfs_order(g: Graph, roots: list[int]) -> DataFrame:
    """(id, position, distance, parent) in the order of a first-in first-out visit with ascending successors.

    Inside a level nodes stand by their parent's place, then by id; a parent is the first placed node of
    the level before that has an arc to the node.
    """
    if not roots:
        raise ValueError("no roots")
    spark = g.arcs.sparkSession
    first = list(dict.fromkeys(int(r) for r in roots))
    level = spark.createDataFrame([(r, i, 0, r) for i, r in enumerate(first)], "id long, position long, distance int, parent long")
    seen = level = cut(level)
    arcs, placed, distance = g.arcs.select("src", "dst"), len(first), 0
    while True:
        distance += 1
        found = arcs.join(level.select(F.col("id").alias("src"), "position"), "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        fresh = found.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("position", "src")).alias("p")).select("id", F.col("p.position").alias("up"), F.col("p.src").alias("parent"))
        from lattica.operators.transform import global_rank

        if not fresh.take(1):
            return seen
        level = cut(global_rank(fresh, "up", "id").select("id", (F.col("rank") + placed).alias("position"), F.lit(distance).alias("distance"), "parent"))
        placed += level.count()
        seen = cut(seen.union(level))


def bfs_permutation(g: Graph) -> DataFrame:
    """(id, new_id): the order of a breadth-first visit of all nodes, restarted at the smallest one left.

    Up to ``packed.PACKED_ARCS`` arcs the driver visits them packed; larger graphs take ``restarted_order``.
    """
    if not packed.fits(g):
        return restarted_order(g)
    order = packed.visit_order(packed.Lists.of(g.n, *packed.collected(g)), g.n)
    return g.arcs.sparkSession.createDataFrame(pa.table({"id": pa.array(order.astype(np.int64)), "new_id": pa.array(np.arange(len(order), dtype=np.int64))}), "id long, new_id long")


def restarted_order(g: Graph) -> DataFrame:
    """(id, new_id) as ``bfs_permutation`` has it, by frontier loops over plans, for graphs of any size.

    The restart that visits a node is the smallest node with a path to it: these labels come first. A shortest path from
    there has the same label all along, so that all restarts are visited together, and stand one after the other in the end.
    """
    from lattica.operators.transform import global_rank

    arcs = g.arcs.select("src", "dst").where("src != dst").distinct().persist()
    label = changed = cut(g.nodes.select("id", F.col("id").alias("root")))
    while changed.take(1):
        low = arcs.join(changed.select(F.col("id").alias("src"), "root"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("root").alias("low"))
        both = label.join(low, "id", "left")
        now = cut(both.select("id", F.least("root", "low").alias("root"), (F.col("low") < F.col("root")).alias("changed")))
        label, changed = now.select("id", "root"), now.where("changed").select("id", "root")
    of_src, of_dst = (label.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")) for c in ("src", "dst"))
    inner = cut(arcs.join(of_src, "src").join(of_dst, "dst").where("src_root = dst_root").select("src", "dst"))
    arcs.unpersist()
    level = label.where("id = root").select("id", "root", F.lit(0).alias("distance"), F.col("id").alias("rank"))
    seen = level = cut(level)
    distance = 0
    while True:
        distance += 1
        found = inner.join(level.select(F.col("id").alias("src"), "root", F.col("rank").alias("up")), "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        fresh = cut(found.groupBy(F.col("dst").alias("id"), "root").agg(F.min("up").alias("up")))
        if not fresh.take(1):
            return global_rank(seen, "root", "distance", "rank").select("id", F.col("rank").alias("new_id"))
        level = cut(global_rank(fresh, "up", "id").select("id", "root", F.lit(distance).alias("distance"), "rank"))
        seen = cut(seen.union(level)) if distance % 8 == 0 else seen.union(level)


def _on_driver(g: Graph) -> dict[int, list[int]]:
    """Ascending successors by node, for graphs of a checked size."""
    arcs = g.arcs.select("src", "dst")
    if arcs.limit(DRIVER_ARCS + 1).count() > DRIVER_ARCS:
        raise ValueError(f"a depth-first order is sequential: more than {DRIVER_ARCS} arcs are refused; use components() or topological_levels()")
    out: dict[int, list[int]] = {}
    for r in arcs.distinct().orderBy("src", "dst").toLocalIterator():
        out.setdefault(r[0], []).append(r[1])
    return out


def dfs_events(g: Graph, roots: Iterable[int] | None = None) -> Iterator[tuple]:
    """Events of a depth-first visit with ascending successors, as tuples.

    ("init", root), ("previsit", node, parent, root, depth), ("revisit", node, parent, on_stack),
    ("postvisit", node, parent, root, depth), ("done", root). Visits of several roots share what is known.
    """
    succ = _on_driver(g)
    state: dict[int, int] = {}  # 1: on the path, 2: left
    for root in roots if roots is not None else range(g.n):
        if root in state:
            continue
        yield ("init", root)
        state[root] = 1
        yield ("previsit", root, root, root, 0)
        path = [(root, root, iter(succ.get(root, ())))]
        while path:
            node, parent, rest = path[-1]
            for y in rest:
                if y in state:
                    yield ("revisit", y, node, state[y] == 1)
                    continue
                state[y] = 1
                yield ("previsit", y, node, root, len(path))
                path.append((y, node, iter(succ.get(y, ()))))
                break
            else:
                path.pop()
                state[node] = 2
                yield ("postvisit", node, parent, root, len(path))
        yield ("done", root)


def dfs_order(g: Graph) -> list[int]:
    return [e[1] for e in dfs_events(g) if e[0] == "previsit"]


def top_sort(g: Graph) -> list[int]:
    """Nodes by falling exit time of a depth-first visit: a topological order of an acyclic graph."""
    return [e[1] for e in dfs_events(g) if e[0] == "postvisit"][::-1]


def level_sizes(visit: DataFrame) -> DataFrame:
    """(distance, size, reached): with the running number of nodes reached; as many rows as levels."""
    return frontier_sizes(visit).withColumn("reached", F.sum("size").over(W.orderBy("distance").rowsBetween(W.unboundedPreceding, 0)))
