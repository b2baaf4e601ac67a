"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation once for every turn it grew by. Each conversation gets a rolling hash of
its turn prefixes: the running sum of hashes that each cover a turn's place, role and text. A conversation
whose whole hash is a proper prefix of another's is a snapshot of it and goes by anti-join; of equal
conversations the smallest id stays. Only the maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rendering of one turn: fixed format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, items): each conversation's turns in the order that hashes and rendering share.

    Turns stand in order of ``turn`` (nulls first), then of role and text, so ties have one order and equal turns
    none that matters. Null roles and texts count as empty.
    """
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(item)).alias("items"))


def turn_prefixes(convs: DataFrame) -> DataFrame:
    """(conv_id, place, total, h1, h2): after each turn the hash of all turns so far. Only hashes leave the conversations."""
    hashes = F.transform("items", lambda x: F.struct(F.xxhash64(x["role"], x["text"], F.lit(1)).alias("a"), F.xxhash64(x["text"], x["role"], F.lit(2)).alias("b")))
    small = convs.select("conv_id", F.col("n_turns").alias("total"), F.posexplode(hashes).alias("pos", "x")).select("conv_id", "total", (F.col("pos") + 1).alias("place"), "x.a", "x.b")
    so_far = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)

    def rolled(c: str, seed: int):
        # sums of 40-bit parts cannot overflow in a conversation of under 8 million turns
        h = F.xxhash64(F.col(c), F.col("place"), F.lit(seed))
        return F.sum(F.shiftrightunsigned(h, 24)).over(so_far)

    return small.select("conv_id", "place", "total", rolled("a", 11).alias("h1"), rolled("b", 12).alias("h2"))


def maximal(convs: DataFrame) -> DataFrame:
    """(conv_id) of the conversations that are no snapshot of a longer one, equal ones once (smallest id; a null id only if alone)."""
    prefixes = turn_prefixes(convs)
    whole = prefixes.where("place = total").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("place < total").select("place", "h1", "h2").distinct()
    return whole.join(proper, ["place", "h1", "h2"], "left_anti").select("conv_id")


def render(convs: DataFrame, keep: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the conversations in ``keep``."""
    kept = convs.join(keep.withColumnRenamed("conv_id", "_keep"), F.col("conv_id").eqNullSafe(F.col("_keep")), "left_semi")
    line = F.transform("items", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE + "\n")))
    return kept.select("conv_id", "n_turns", F.array_join(line, "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Collapse, then render: (conv_id, n_turns, rendered), one row for each maximal conversation.

    Rows with one conv_id are one conversation (a null id is one, too); rows of one turn number stand by role and
    text, repeated rows stay. A long text or conversation is one row of the result, whatever its size. Other columns
    are ignored; an empty table gives no rows.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    convs = conversations(turns)
    return render(convs, maximal(convs))


SQL = f"""
WITH line AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM line GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, n_turns, rendered FROM whole GROUP BY n_turns, rendered)
SELECT conv_id, n_turns, rendered FROM one a
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.n_turns > a.n_turns AND starts_with(b.rendered, a.rendered))
"""
