"""Command line: ``python -m lattica COMMAND ...`` on arc tables in Parquet (src, dst) and text."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lattica.functions import predicates as P
from lattica.model import Graph, graph_of
from lattica.operators import components, llp, rank, stats, transform, visits
from lattica.sources import arcs as A
from lattica.sources import sequences


def _graph(spark: SparkSession, path: str, n: int | None) -> Graph:
    return graph_of(spark.read.parquet(path), n)


def _save(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, graph: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if graph:
            p.add_argument("graph")
            p.add_argument("--nodes", type=int)
        for x in paths:
            p.add_argument(x)
        return p

    p = command("from-arcs", "text", "out", graph=False)
    for flag, kind, default in (("--separator", str, "\t"), ("--comment", str, "#"), ("--skip", int, 0), ("--limit", int, None), ("--source", int, 0), ("--target", int, 1)):
        p.add_argument(flag, type=kind, default=default)
    p.add_argument("--labels", action="store_true")
    for name in ("to-arcs", "to-ascii", "transpose", "stats", "dcf", "codes", "perm-bfs"):
        command(name, "out")
    p = command("symmetrize", "out")
    p.add_argument("--no-loops", action="store_true")
    for name in ("permute", "map"):
        command(name, "mapping", "out")
    p = command("perm-rand", "out", graph=False)
    p.add_argument("n", type=int)
    p.add_argument("--seed", type=int, default=0)
    p = command("perm-comp", "out", graph=False)
    p.add_argument("perms", nargs="+")
    p = command("check-symm")
    p.add_argument("--simple", action="store_true")
    command("check-eq", "other")
    p = command("sccs", "out")
    p.add_argument("--renumber", action="store_true")
    p.add_argument("--sizes")
    p = command("pagerank", "out")
    p.add_argument("--alpha", type=float, default=0.85)
    p.add_argument("--mode", choices=[rank.STRONG, rank.WEAK, rank.PSEUDO], default=rank.STRONG)
    p.add_argument("--threshold", type=float, default=1e-6)
    p.add_argument("--max-iterations", type=int, default=1000)
    p = command("birank", "sources", "out")
    p.add_argument("--max-iterations", type=int, default=100)
    p.add_argument("--threshold", type=float, default=1e-6)
    p = command("llp", "out")
    p.add_argument("--gammas", nargs="*", default=[f"-{k}" for k in range(11)])
    p.add_argument("--seed", type=int, default=0)
    p = command("seq", "src", "out", graph=False)
    p.add_argument("--from", dest="source", default=sequences.ASCII)
    p.add_argument("--to", dest="target", default=sequences.JSON)
    p.add_argument("--kind", default="long")
    p.add_argument("--precision", type=int)
    return top


def run(spark: SparkSession, args: list[str]) -> int:
    """Exit status: 1 if a check finds a difference."""
    a = parser().parse_args(args)
    g = _graph(spark, a.graph, a.nodes) if hasattr(a, "graph") else None
    read = spark.read.parquet
    match a.command:
        case "from-arcs":
            found, names = A.read_arcs(spark, a.text, a.separator, a.comment, a.skip, a.limit, a.source, a.target, a.labels)
            _save(found.arcs, a.out)
            if names is not None:
                _save(names, f"{a.out}.nodes")
        case "to-arcs":
            A.to_arc_lines(g).write.text(a.out)
        case "to-ascii":
            A.to_adjacency_lines(g).select("value").write.text(a.out)
        case "transpose":
            _save(transform.sort_arcs(transform.transpose(g)).arcs, a.out)
        case "symmetrize":
            _save(transform.sort_arcs(transform.symmetrize(g, not a.no_loops)).arcs, a.out)
        case "permute":
            _save(transform.sort_arcs(transform.permute(g, read(a.mapping))).arcs, a.out)
        case "map":
            _save(transform.sort_arcs(transform.map_nodes(g, read(a.mapping))).arcs, a.out)
        case "stats":
            _save(stats.summary(g), a.out)
        case "dcf":
            _save(stats.cumulative_degrees(g), a.out)
        case "codes":
            _save(stats.code_sizes(g), a.out)
        case "perm-bfs":
            _save(visits.bfs_permutation(g), a.out)
        case "perm-rand":
            _save(transform.random_permutation(spark, a.n, a.seed), a.out)
        case "perm-comp":
            _save(transform.compose(*map(read, a.perms)), a.out)
        case "check-symm":
            return int(not transform.is_symmetric(g, a.simple))
        case "check-eq":
            found = transform.first_difference(g, _graph(spark, a.other, a.nodes))
            print(found or "equal")
            return int(found is not None)
        case "sccs":
            found = components.strong_components(g)
            found = components.renumber_by_size(found) if a.renumber else found
            _save(found, a.out)
            if a.sizes:
                _save(stats.component_sizes(found), a.sizes)
        case "pagerank":
            _save(rank.pagerank(g, a.alpha, a.mode, stop=P.l1_norm(a.threshold) | P.max_iterations(a.max_iterations)).ranks, a.out)
        case "birank":
            _save(rank.birank(g, int(a.sources), stop=P.l1_norm(a.threshold) | P.max_iterations(a.max_iterations)).ranks, a.out)
        case "llp":
            _save(llp.layered_order(g, llp.parse_gammas(a.gammas), a.seed), a.out)
        case "seq":
            sequences.write_sequence(sequences.read_sequence(spark, a.src, a.source, a.kind), a.out, a.target, a.precision, a.kind)
    return 0


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.appName("lattica").getOrCreate()
    sys.exit(run(session, sys.argv[1:]))
