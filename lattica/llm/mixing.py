"""Mixing sources to target weights by iterative proportional fitting (raking), in DataFrame operations only.

Token counts are summed into cells (source, language, topic). Cell weights are then raked: scaled to each
margin's target shares in turn until all margins agree within a tolerance. A document is drawn with a
probability in proportion to its cell's weight, calibrated so that the expected tokens meet a budget and
no probability exceeds 1. The draw is a hash of the document's id and a seed: the same rows give the same
sample, whatever the partitions and retries.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm._common import materialize

#: Rakes between two looks at the margins' error; plans are cut there.
ROUNDS_PER_CUT = 5
#: Cells that may be raked in one partition, without any exchange; more stay dealt out.
SMALL_CELLS = 200_000
#: Stands for a null value of a margin.
NONE = "(none)"

Targets = Mapping[str, Mapping[str, float] | float]


def word_count(text: str = "text") -> Column:
    """Tokens of a text, by white space: what a document weighs."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))


def topic_of(text: str = "text") -> Column:
    """A document's form, standing in for a topic where the table names none: note, table, list or prose."""
    t = F.coalesce(text, F.lit(""))
    lines = F.length(t) - F.length(F.translate(t, "\n", "")) + 1
    bars = F.length(t) - F.length(F.translate(t, "|", ""))
    return (
        F.when(F.length(t) < 400, "note").when(bars * 40 > F.length(t), "table").when(lines * 80 > F.length(t), "list").otherwise("prose")
    )


def target_table(cells: DataFrame, margin: str, targets: Mapping[str, float] | float) -> DataFrame:
    """(margin, share) for every value the cells have; shares sum to 1 over these.

    A mapping gives shares by value; values it does not name keep their own share of what it leaves. A
    number t in [0, 1] flattens: shares in proportion to the values' own tokens to the power t. Where the named
    shares leave nothing for any value that the cells have, every share is 0 and nothing is drawn.
    """
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("own")).where("own > 0")
    if isinstance(targets, Mapping):
        named = [(str(k), float(v)) for k, v in targets.items()]
        left = max(0.0, 1.0 - sum(v for _, v in named))
        given = F.create_map(*[F.lit(x) for pair in named for x in pair])[F.col(margin)] if named else F.lit(None).cast("double")
        rest = own.withColumn("named", given)
        free = rest.where("named is null").agg(F.sum("own")).first()[0]
        raw = rest.select(margin, F.coalesce("named", F.try_divide(F.lit(left) * F.col("own"), F.lit(float(free or 0)))).alias("share"))
    else:
        raw = own.select(margin, F.pow("own", F.lit(float(targets))).alias("share"))
    total = raw.agg(F.sum("share")).first()[0]
    return raw.select(margin, F.coalesce(F.try_divide("share", F.lit(float(total or 0))), F.lit(0.0)).alias(f"{margin}_share"))


def rake(cells: DataFrame, margins: list[str], tolerance: float = 1e-6, max_rounds: int = 60, small: bool = False) -> DataFrame:
    """The cells with a ``weight`` (share of all tokens) whose sums over each margin meet ``<margin>_share``.

    Cells without tokens get none. Where targets contradict each other the last rake's margin holds and the
    others are as near as the rounds brought them; a warning says so.
    """
    all_tokens = cells.agg(F.sum("tokens")).first()[0]
    cells = cells.withColumn("weight", F.coalesce(F.try_divide("tokens", F.lit(float(all_tokens or 0))), F.lit(0.0)))
    for done in range(0, max_rounds, ROUNDS_PER_CUT):
        for _ in range(ROUNDS_PER_CUT):
            for m in margins:
                now = F.sum("weight").over(W.partitionBy(m))
                cells = cells.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"{m}_share"), now), F.lit(0.0)))
        cells = materialize(cells, "rake")
        cells = cells.coalesce(1) if small else cells
        worst = 0.0
        for m in margins:
            error = cells.groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"{m}_share")).alias("e")).agg(F.max("e")).first()[0]
            worst = max(worst, error or 0.0)
        if worst <= tolerance:
            return cells
    warnings.warn(f"margins are met to {worst:.3g} only after {max_rounds} rounds", stacklevel=2)
    return cells


def _calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """With ``prob``: min(1, c * weight / tokens), c so that expected tokens meet the budget (all tokens at most).

    The factor rises: cells that it fills count whole, and it is set anew by what is left for the others, until no
    further cell fills. Every step is one sum over the cells, wherever they lie.
    """
    weighed = F.col("weight") > 0
    c = 0.0
    while True:
        full = F.lit(c) * F.col("weight") >= F.col("tokens")
        sums = cells.where(weighed).agg(F.sum(F.when(full, F.col("tokens"))).alias("t"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not sums["w"] or budget <= (sums["t"] or 0):
            break
        new = (budget - (sums["t"] or 0)) / sums["w"]
        if new <= c * (1 + 1e-12):
            break
        c = new
    prob = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(c) * F.col("weight"), F.col("tokens")), F.lit(0.0)))
    return cells.withColumn("prob", prob)


def mixture(docs: DataFrame, targets: Targets, topic: Column | None = None, budget_share: float = 0.5, tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with their margins and tokens, cells with weights and probabilities)."""
    margins = ["source", "lang", "topic"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text("source").alias("source"), text("lang").alias("lang"),
        F.coalesce((topic if topic is not None else topic_of()).cast("string"), F.lit(NONE)).alias("topic"), (tokens if tokens is not None else word_count()).cast("long").alias("tokens"),
    )
    rows = materialize(rows, "weighed")
    cells = rows.groupBy(*margins).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    cells = materialize(cells, "cells")
    small = cells.count() <= SMALL_CELLS
    for m in margins:
        shares = target_table(cells, m, targets.get(m, {}))  # at most a row a cell
        cells = cells.join(F.broadcast(shares) if small else shares, m, "left").fillna(0.0, [f"{m}_share"])
    cells = rake(cells.coalesce(1) if small else cells, margins, small=small)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    return rows, _calibrated(cells, budget_share * total)


def sample(docs: DataFrame, targets: Targets, topic: Column | None = None, budget_share: float = 0.5, seed: int = 1, tokens: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, prob, uniform of the documents drawn.

    ``weight`` is the raked share of the document's cell per token, ``prob`` the probability it was drawn
    with; ``uniform < prob`` holds. Null margins are a value of their own. Documents without tokens have
    probability 0. Rows that repeat a doc_id are drawn together, as are ties of the hash. Long texts count by all
    their words. Other columns are ignored. An empty table gives no rows.
    """
    rows, cells = mixture(docs, targets, topic, budget_share, tokens)
    keys = ["source", "lang", "topic"]
    rates = cells.select(*keys, (F.col("weight") / F.greatest("tokens", F.lit(1))).alias("weight"), "prob")
    small = cells.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS
    rates = F.broadcast(materialize(rates, "rates")) if small else rates
    uniform = F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = rows.join(rates, keys).withColumn("uniform", uniform).where("uniform < prob")
    return drawn.select("doc_id", *keys, "tokens", "weight", "prob", "uniform")


def keep_sampled(docs: DataFrame, targets: Targets, topic: Column | None = None, budget_share: float = 0.5, seed: int = 1, tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their own columns, whatever their names: the text is not shuffled.

    Nulls, empty and long texts, repeated rows, ties of the draw and empty tables are as for ``sample``.
    """
    topic = topic if topic is not None else topic_of()
    _, cells = mixture(docs, targets, topic, budget_share, tokens)
    rates = materialize(cells.select("source", "lang", "topic", "prob"), "rates")
    rates = F.broadcast(rates) if rates.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS else rates
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    uniform = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(seed)), 11) / F.lit(float(1 << 53))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text("source").alias("source"), text("lang").alias("lang"),
        F.coalesce(topic.cast("string"), F.lit(NONE)).alias("topic"), uniform.alias("uniform"),
    )
    return rows.join(rates, ["source", "lang", "topic"]).where("uniform < prob").select("row.*")
