"""Helpers that the operators of this subpackage share: shared-folder tables, Arrow batches, hashing."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import _text
from lattica.plans.loop import cut as materialize
from lattica.plans.loop import forget

__all__ = ["arrow_map", "forget", "materialize", "maybe_in", "release", "surely_in", "table"]

#: Rows and bytes per Arrow batch: a Python worker's memory stays bounded whatever the texts' lengths.
BATCH_ROWS = 2000
BATCH_BYTES = 2 << 20
#: A side of at most so many rows of a few fixed-width columns may be broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _limit_batches(spark: SparkSession) -> None:
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def release() -> None:
    """Give memory back to the system, tables of powers too: idle Python workers stay alive and would hold it through later stages."""
    _text.drop_powers()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with one state a task: ``make()`` returns the function that each batch goes through.

    The function may have a ``finish`` attribute, called once after the last batch. Spark reads the limits of
    a batch from the session when the plan runs, so they are lowered there; lower ones of the caller stay.
    """
    _limit_batches(df.sparkSession)

    def run(batches):
        step = make()
        for batch in batches:
            yield from step(batch)
        finish = getattr(step, "finish", None)
        if finish is not None:
            yield from finish()
        del step, finish
        release()

    return df.mapInArrow(run, schema)


#: Keys that one chunk of a key filter is meant for, and its bits: about 21 a key, three of them set.
FILTER_KEYS = 50_000
FILTER_BITS = 20


def _filter_chunk(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << FILTER_BITS, np.uint8)
    h = table.column("_bits").to_numpy()
    for i in range(3):
        bits[(h >> (i * FILTER_BITS)) & ((1 << FILTER_BITS) - 1)] = 1
    words = np.packbits(bits, bitorder="little").view(np.int64)
    return pa.table({"_chunk": table.column("_chunk")[:1], "_words": pa.array([words], pa.list_(pa.int64()))})


def maybe_in(rows: DataFrame, keys: DataFrame, *cols: str, chunk_keys: int = FILTER_KEYS) -> DataFrame:
    """``rows`` with ``_maybe``: true for all whose ``cols`` stand in ``keys`` (written already), and for about 1 of 400 others.

    Neither side is shuffled whole: a filter of 3 bytes a key is built in chunks, and they are broadcast. An exact
    join follows where it matters; it then shuffles about as many rows as have a partner. Nulls are equal to one another.
    """
    chunks = max(1, math.ceil(keys.count() / chunk_keys))
    where, bits = F.pmod(F.xxhash64(*cols), F.lit(chunks)).cast("int"), F.xxhash64(F.lit(chunks), *cols)
    words = keys.select(where.alias("_chunk"), bits.alias("_bits")).groupBy("_chunk").applyInArrow(_filter_chunk, "_chunk int, _words array<long>")
    joined = rows.withColumns({"_at": where, "_bits": bits}).join(F.broadcast(words), F.col("_at") == F.col("_chunk"), "left")
    found = F.col("_words").isNotNull()
    for i in range(3):
        place = F.shiftright("_bits", i * FILTER_BITS).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        word = F.get("_words", F.shiftright(place, 6).cast("int"))
        found = found & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return joined.withColumn("_maybe", found).select(*rows.columns, "_maybe")


def surely_in(rows: DataFrame, keys: DataFrame, every: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``_in``, a written table to forget later): true if their ``cols`` stand in ``keys``, false if not, null if only a join can tell.

    ``every`` holds the keys of all rows. Those that a filter lets through wrongly make a second one, so that null is left
    for these and for as small a part of ``keys``. No row is shuffled; ``keys`` and ``every`` are written already.
    """
    through = maybe_in(every.select(*cols), keys, *cols).where("_maybe").select(*cols).distinct().alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    wrong = materialize(through.join(keys.select(*cols).alias("b"), same, "left_anti"), "wrong")
    first = maybe_in(rows, keys, *cols).withColumnRenamed("_maybe", "_first")
    found = F.when(~F.col("_first"), False).when(~F.col("_maybe"), True)
    return maybe_in(first, wrong, *cols).withColumn("_in", found).select(*rows.columns, "_in"), wrong
