"""Graphs packed in numpy arrays: bit-parallel visits, visit orders and label rounds inside Python workers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from lattica.model import Graph

#: Arcs up to which a graph is packed (8 bytes an arc here, about 30 while it is used); they are counted first.
PACKED_ARCS = 20_000_000
#: Roots of one visit: 8 words of 64 bits a node.
BLOCK_ROOTS = 512
#: Arcs whose sources' words are gathered at once.
GATHER = 500_000


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of size[0] numbers, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def fits(g: Graph) -> bool:
    return g.n < 2**31 and g.arcs.limit(PACKED_ARCS + 1).count() <= PACKED_ARCS


def collected(g: Graph) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) of all arcs but loops, once each, on the driver: 8 bytes an arc."""
    found = g.arcs.where("src != dst").select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).distinct().toArrow()
    return found.column("src").to_numpy(), found.column("dst").to_numpy()


@dataclass
class Lists:
    """Lists of neighbours one after the other: those of node i from ``at[i]`` to ``at[i + 1]``, ascending."""

    at: np.ndarray
    to: np.ndarray

    @classmethod
    def of(cls, n: int, src: np.ndarray, dst: np.ndarray) -> Lists:
        order = np.lexsort((dst, src))
        return cls(np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[order])

    def of_nodes(self, nodes: np.ndarray) -> np.ndarray:
        return self.to[ranges(self.at[nodes], self.at[nodes + 1] - self.at[nodes])]


def ball_sizes(ahead: Lists, behind: Lists, n: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, distance, nodes at it) of the roots from ``first`` on: a bit a root in each node's words, one sweep for all of them.

    A level looks at the successors of nodes that got a bit in the last one, and ors the new bits of all their predecessors.
    """
    words = -(-count // 64)
    seen = np.zeros((n, words), np.uint64)
    own = np.arange(count)
    seen[first + own, own // 64] = np.uint64(1) << (own % 64).astype(np.uint64)
    fresh, active = np.zeros_like(seen), first + own
    fresh[active] = seen[active]
    out, d = [(own, 0, np.ones(count, np.int64))], 0
    while len(active):
        d += 1
        mark = np.zeros(n, bool)
        mark[ahead.of_nodes(active)] = True
        near = np.flatnonzero(mark)
        bits = np.empty((len(near), words), np.uint64)
        degree = behind.at[near + 1] - behind.at[near]
        ends = np.cumsum(degree)
        a = 0
        while a < len(near):  # of one node at least, however many predecessors it has
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GATHER, "right")))
            got = fresh[behind.of_nodes(near[a:b])]
            bits[a:b] = np.bitwise_or.reduceat(got, np.concatenate([[0], np.cumsum(degree[a : b - 1])]), axis=0)
            a = b
        fresh[active] = 0
        bits &= ~seen[near]
        some = bits.any(axis=1)
        active, bits = near[some], bits[some]
        seen[active] |= bits
        fresh[active] = bits
        here = np.zeros(words * 64, np.int64)
        for a in range(0, len(active), 20_000):
            here += np.unpackbits(bits[a : a + 20_000].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at = np.flatnonzero(here)
        out.append((at, d, here[at]))
    root = np.concatenate([x[0] for x in out]) + first
    return root, np.repeat([x[1] for x in out], [len(x[0]) for x in out]), np.concatenate([x[2] for x in out])


def visit_order(ahead: Lists, n: int) -> np.ndarray:
    """Nodes by a first-in first-out visit with ascending successors, restarted at the smallest node that is left; level by level."""
    seen, order, degree = np.zeros(n, bool), [], np.diff(ahead.at)
    for root in range(n):
        if seen[root]:
            continue
        level = np.array([root])
        seen[root] = True
        while len(level):
            order.append(level)
            found = ahead.of_nodes(level[degree[level] > 0])
            found = found[~seen[found]]
            _, at = np.unique(found, return_index=True)
            level = found[np.sort(at)]
            seen[level] = True
    return np.concatenate(order) if order else np.zeros(0, np.int64)


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def xxhash64(*values: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of columns: arrays are longs, single numbers are ints."""
    h = np.full(1, 42, np.uint64)
    for v in values:
        if isinstance(v, np.ndarray):
            h = h + P5 + np.uint64(8) ^ _turn(v.astype(np.int64).view(np.uint64) * P2, 31) * P1
            h = _turn(h, 27) * P1 + P4
        else:
            h = h + P5 + np.uint64(4) ^ np.full(1, v & 0xFFFFFFFF, np.uint64) * P1
            h = _turn(h, 23) * P2 + P3
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)
