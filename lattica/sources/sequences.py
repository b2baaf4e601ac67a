"""Sequences of numbers, one a node, as text, JSON or big-endian binary files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.loop import cut

ASCII, JSON, JAVA = "ascii", "json", "java"
_BINARY = {"long": (">i8", "int64"), "double": (">f8", "float64"), "float": (">f4", "float32")}


def read_sequence(spark: SparkSession, path: str, form: str = ASCII, kind: str = "long") -> DataFrame:
    """(id, value) of a file; kind is long, double or float (Java only).

    Blank lines of text do not count; a line that is no number is an error that names it. A binary file must hold whole
    numbers of its width.
    """
    if form == ASCII:
        lines = cut(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()))
        lines = lines.where(F.trim("value") != "")
        value = F.expr(f"try_cast(trim(value) as {'bigint' if kind == 'long' else 'double'})")
        bad = lines.where(value.isNull()).orderBy("line").select("value").take(1)
        if bad:
            raise ValueError(f"not a number: {bad[0][0]!r}")
        from lattica.operators.transform import global_rank

        return global_rank(lines.select("line", value.alias("v")), "line").select(F.col("rank").alias("id"), F.col("v").alias("value"))
    if form == JSON:
        kind_sql = "array<bigint>" if kind == "long" else "array<double>"
        return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind_sql)).alias("id", "value")).withColumn("id", F.col("id").cast("long"))
    if form == JAVA:
        wire, dtype = _BINARY[kind]
        width = np.dtype(wire).itemsize
        files = spark.read.format("binaryFile").load(path).select("content", "length")
        if files.where(F.col("length") % width != 0).take(1):
            raise ValueError(f"the file's size is no multiple of {width}")

        def decode(batches):
            for b in batches:
                for raw in b.column("content").to_pylist():
                    x = np.frombuffer(raw, wire).astype(dtype)
                    for at in range(0, len(x), 1 << 20):
                        part = x[at : at + (1 << 20)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], ["id", "value"])

        return files.select("content").mapInArrow(decode, f"id long, value {'bigint' if kind == 'long' else kind}")
    raise ValueError(f"unknown form {form}")


def sequence_lines(values: DataFrame, precision: int | None = None) -> DataFrame:
    """(value): the numbers as text lines in the order of their ids."""
    text = F.col("value").cast("string") if precision is None else F.format_string(f"%.{precision}f", "value")
    return values.repartitionByRange("id").sortWithinPartitions("id").select(text.alias("value"))


def write_sequence(values: DataFrame, path: str, form: str = ASCII, precision: int | None = None, kind: str = "long") -> None:
    """Write (id, value) of ids 0..n-1 as a folder of part files in order (ascii, java) or as one JSON array."""
    if form == ASCII:
        sequence_lines(values, precision).write.text(path)
    elif form == JSON:
        # one array is one value: the sink for sequences that fit in a task, like the form itself
        ordered = values.groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "value"))).alias("x"))
        ordered.select(F.to_json(F.transform("x", lambda y: y["value"])).alias("value")).write.text(path)
    elif form == JAVA:
        wire = _BINARY[kind][0]

        def encode(batches):
            for b in batches:
                x = b.column("value").to_numpy(zero_copy_only=False).astype(wire)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["content"])

        blocks = values.repartitionByRange("id").sortWithinPartitions("id").select("value").mapInArrow(encode, "content binary")
        blocks.write.parquet(path)
    else:
        raise ValueError(f"unknown form {form}")


def java_bytes(values: DataFrame, kind: str = "long") -> bytes:
    """The big-endian bytes of a sequence that the caller knows to fit on the driver."""
    rows = values.orderBy("id").select("value").toPandas()["value"].to_numpy()
    return rows.astype(_BINARY[kind][0]).tobytes()
