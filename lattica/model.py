"""The graph: a table of arcs and a number of nodes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``arcs(src, dst[, label])`` over the nodes 0..n-1.

    ``n`` travels with the arcs, because nodes without arcs never stand in them.
    """

    arcs: DataFrame
    n: int

    @property
    def labelled(self) -> bool:
        return "label" in self.arcs.columns

    @property
    def nodes(self) -> DataFrame:
        """(id) of all nodes: a generated range, no scan of the arcs."""
        return self.arcs.sparkSession.range(self.n)

    def with_arcs(self, arcs: DataFrame, n: int | None = None) -> Graph:
        return replace(self, arcs=arcs, n=self.n if n is None else n)

    def num_arcs(self) -> int:
        return self.arcs.count()

    def successors(self, node: int) -> DataFrame:
        """(dst) of one node, ascending. On a table sorted by src this prunes to a few row groups."""
        return self.arcs.where(F.col("src") == node).select("dst").orderBy("dst")

    def has_arc(self, src: int, dst: int) -> bool:
        return bool(self.arcs.where((F.col("src") == src) & (F.col("dst") == dst)).limit(1).take(1))

    def between(self, first: int, count: int) -> DataFrame:
        """Arcs of ``count`` nodes from ``first`` on."""
        return self.arcs.where(F.col("src").between(first, first + count - 1))

    def adjacency(self) -> DataFrame:
        """(id, successors) of every node; nodes without arcs have an empty list."""
        lists = self.arcs.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("successors"))
        return self.nodes.join(lists, F.col("id") == F.col("src"), "left").select("id", F.coalesce("successors", F.array().cast("array<bigint>")).alias("successors"))


def graph_of(arcs: DataFrame, n: int | None = None) -> Graph:
    """A graph of an arc table; without ``n`` it has 1 + the largest id in it."""
    if n is None:
        n = int(arcs.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0))).first()[0])
    return Graph(arcs, n)
