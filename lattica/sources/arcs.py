"""Arcs from lists and from text; text, names and number sequences as sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.model import Graph, graph_of
from lattica.plans.loop import cut


def from_arcs(spark: SparkSession, arcs: Iterable[tuple], n: int | None = None, strict: bool = False) -> Graph:
    """A graph of (src, dst) or (src, dst, label) tuples. ``strict`` refuses repeated arcs."""
    rows = [tuple(a) for a in arcs]
    if strict and len({r[:2] for r in rows}) != len(rows):
        raise ValueError("an arc stands twice")
    if any(len(r) > 2 for r in rows):
        df = spark.createDataFrame(rows, ["src", "dst", "label"]).withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")})
    else:
        df = spark.createDataFrame(rows, "src long, dst long")
    if n is None:
        n = 1 + max((max(r[0], r[1]) for r in rows), default=-1)
    return Graph(df, n)


def read_arcs(spark: SparkSession, path: str, separator: str = "\t", comment: str = "#", skip: int = 0, limit: int | None = None, source: int = 0, target: int = 1, labels: bool = False) -> tuple[Graph, DataFrame | None]:
    """(graph, names): arcs of a text file, one a line, repeated ones once.

    The first ``skip`` lines do not count, nor do comments and lines of too few columns (``short_lines`` tells how
    many these are); at most ``limit`` arcs are read. Columns that are no whole number are an error. With ``labels`` columns are names,
    numbered in the order they come up (the source before the target); names is (id, name) then, else None.

    Order in the text matters only for skip, limit and labels; else lines are read in parallel and never ordered.
    """
    lines = spark.read.text(path)
    ordered = skip or limit is not None or labels
    if ordered:
        # the file order of lines within a split is their id's; splits come in file order
        lines = cut(lines.withColumn("line", F.monotonically_increasing_id()))
        if skip:
            gone = lines.orderBy("line").limit(skip).select("line")
            lines = lines.join(F.broadcast(gone), "line", "left_anti")
    lines = lines.where(~F.startswith(F.trim("value"), F.lit(comment)) & (F.trim("value") != ""))
    parts = F.split("value", _literal(separator))
    rows = lines.withColumn("parts", parts).where(F.size("parts") > max(source, target))
    rows = rows.withColumns({"a": F.trim(F.element_at("parts", source + 1)), "b": F.trim(F.element_at("parts", target + 1))})
    if limit is not None:
        rows = rows.orderBy("line").limit(limit)
    if labels:
        return _named(rows)
    bad = rows.where(~F.col("a").rlike(r"^\d+$") | ~F.col("b").rlike(r"^\d+$")).select("value").take(1)
    if bad:
        raise ValueError(f"not a pair of node ids: {bad[0][0]!r}")
    return graph_of(rows.select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst")).distinct()), None


def _literal(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def short_lines(spark: SparkSession, path: str, separator: str = "\t", comment: str = "#", source: int = 0, target: int = 1) -> int:
    """Lines that read_arcs leaves out for having too few columns."""
    lines = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit(comment)) & (F.trim("value") != ""))
    return lines.where(F.size(F.split("value", _literal(separator))) <= max(source, target)).count()


def _named(rows: DataFrame) -> tuple[Graph, DataFrame]:
    """Graph and names of rows (line, a, b) of name pairs."""
    from lattica.operators.transform import global_rank

    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("name")), F.struct(F.lit(1).alias("side"), F.col("b").alias("name")))
    first = rows.select("line", F.explode(sides).alias("x")).groupBy("x.name").agg(F.min(F.struct("line", "x.side")).alias("at"))
    names = cut(global_rank(first.select("name", "at.line", "at.side"), "line", "side").select(F.col("rank").alias("id"), "name"))
    arcs = rows.select("a", "b").join(names.select(F.col("name").alias("a"), F.col("id").alias("src")), "a").join(names.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b")
    return Graph(arcs.select("src", "dst").distinct(), names.count()), names


def from_names(pairs: DataFrame) -> tuple[Graph, DataFrame]:
    """Graph and names of (line, a, b): names are numbered in the order they come up, a before b."""
    return _named(pairs)


def to_arc_lines(g: Graph, separator: str = "\t", names: DataFrame | None = None) -> DataFrame:
    """(value): an arc a line, by node; with ``names(id, name)`` of all nodes as names."""
    arcs = g.arcs.select("src", "dst")
    if names is None:
        return arcs.repartitionByRange("src").sortWithinPartitions("src", "dst").select(F.concat_ws(separator, "src", "dst").alias("value"))
    if names.count() < g.n:
        raise ValueError(f"names of {g.n} nodes are needed")
    arcs = arcs.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    return arcs.repartitionByRange("src").sortWithinPartitions("src", "dst").select(F.concat_ws(separator, "a", "b").alias("value"))


def to_adjacency_lines(g: Graph) -> DataFrame:
    """(id, value): ``node TAB successors`` separated by blanks, a line for every node."""
    lists = g.adjacency().select("id", F.concat(F.col("id").cast("string"), F.lit("\t"), F.array_join(F.transform("successors", lambda x: x.cast("string")), " ")).alias("value"))
    return lists.repartitionByRange("id").sortWithinPartitions("id")


def from_adjacency_lines(lines: DataFrame) -> Graph:
    """Graph of lines ``node TAB successors``."""
    parts = F.split("value", "\t")
    rows = lines.select(F.get(parts, F.lit(0)).cast("long").alias("src"), F.filter(F.split(F.get(parts, F.lit(1)), " "), lambda x: x != "").alias("succ"))
    n = rows.agg(F.coalesce(F.max("src") + 1, F.lit(0))).first()[0]
    return Graph(rows.select("src", F.explode("succ").alias("dst")).withColumn("dst", F.col("dst").cast("long")), n)
