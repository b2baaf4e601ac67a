"""Quality rules: surface counts, and divergence from language references.

A document's character-class histogram and its common-word histogram are compared with those of its
language by Jensen-Shannon distance (base 2, so 0 to 1). References are counts over *all* documents of
the language. Common words stand in a histogram by classes of about equal share, from the commonest on; the
last class is every other word. The limit of the word distance follows from the language's reference: a share of
the distance that a text without any common word has, and what a text of so few words may stray by chance. Minimum lengths
guard both comparisons: a shorter text has no stable histogram and is left to the base rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import _text
from lattica.llm._common import arrow_map, materialize

U = np.uint64
#: Words are counted by hash into so many bins; the fullest bins of a language are its common words.
WORD_BINS = 4096

#: Character classes by the leading byte of a code point; -1: continuation bytes, not counted.
CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "other", "latin", "beyond")
_CLASS = np.full(256, 6, np.int8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[[ord(c) for c in ".,;:'\"!?-()"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[0x80:0xC0], _CLASS[0xC0:0xC6], _CLASS[0xC6:] = -1, 7, 8
SYMBOL = _CLASS == 5
LEADS = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Rules:
    """Thresholds. Distances above the two limits reject; the guards say from which length on they count.

    The squared word distance may reach ``word_share`` squared of what a text without common words has, and
    ``word_noise`` times the expected square of a random sample of the language that long.
    """

    min_words: int = 20
    repeat_percent: int = 30
    max_char_distance: float = 0.25
    word_share: float = 0.6
    word_noise: float = 2.0
    guard_chars: int = 200
    guard_words: int = 30
    common_words: int = 256
    word_classes: int = 8


def class_counts(w: _text.Words) -> np.ndarray:
    """Documents x classes: code points of each class."""
    n = len(w.counts)
    kind = _CLASS[w.data]
    doc = np.repeat(np.arange(n), np.diff(w.offsets))
    ok = kind >= 0
    return np.bincount(doc[ok] * len(CLASSES) + kind[ok], minlength=n * len(CLASSES)).reshape(n, -1)


def repeated_words(w: _text.Words, k: int = 8) -> np.ndarray:
    """Words of each document that lie in a window of k words found twice or more in it."""
    grams, bounds, at = w.grams(k)
    cover = np.zeros(len(w.start) + 1, np.int64)
    if len(grams):
        doc = np.repeat(np.arange(len(w.counts), dtype=np.uint64), np.diff(bounds))
        own = _text.mix(grams + doc * U(0x9E3779B97F4A7C15))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + k, -1)
    return _text.sums_by_bounds(np.cumsum(cover)[:-1] > 0, w.bounds)


def duplicate_lines(w: _text.Words) -> np.ndarray:
    """Lines of each document that hold a word and equal an earlier line of it."""
    n = len(w.counts)
    breaks = np.flatnonzero(w.data == 10)
    start = np.concatenate([w.offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, w.offsets[1:]])
    start, end = np.sort(start), np.sort(end)
    some = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[some], end[some]
    if not len(start):
        return np.zeros(n, np.int64)
    doc = np.searchsorted(w.offsets, start, "right") - 1
    own = _text.mix(w.span_hash(start, end) + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    again = np.concatenate([[False], own[order][1:] == own[order][:-1]])
    return np.bincount(doc[order[again]], minlength=n)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of the rows of two arrays of distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.clip(parts.sum(axis=-1) / 2, 0, 1))


def _folded(w: _text.Words) -> _text.Words:
    return _text.Words(_text.LOWER[w.data], w.offsets)


def _lang_codes(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("lang").cast(pa.string()).to_pylist()


def references(docs: DataFrame, rules: Rules) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """lang -> (class shares, class of each word bin, shares of the word classes), from all documents."""

    def make():
        total: dict[str, np.ndarray] = {}

        def step(batch):
            data, offsets = _text.text_buffers(batch.column("text"))
            langs = _lang_codes(batch)
            for a, b in _text.runs(offsets):
                w = _text.Words(data, offsets[a : b + 1])
                chars = class_counts(w)
                bins = (_folded(w).hash % U(WORD_BINS)).astype(np.int64)
                names = sorted({x for x in langs[a:b] if x is not None})
                code = np.array([names.index(x) if x is not None else -1 for x in langs[a:b]])
                of_word = np.repeat(code, w.counts)
                for i, name in enumerate(names):
                    have = total.setdefault(name, np.zeros(len(CLASSES) + WORD_BINS, np.int64))
                    have[: len(CLASSES)] += chars[code == i].sum(axis=0)
                    have[len(CLASSES) :] += np.bincount(bins[of_word == i], minlength=WORD_BINS)
            return iter(())

        def finish():
            for name, have in total.items():
                at = np.flatnonzero(have)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(have[at])], ["lang", "bin", "n"])

        step.finish = finish
        return step

    counts = arrow_map(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), make, "lang string, bin int, n long")
    sums = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    by_lang = sums.withColumn("char", F.col("bin") < len(CLASSES)).groupBy("lang", "char").agg(
        F.sum("n").alias("total"), F.slice(F.sort_array(F.collect_list(F.struct("n", "bin")), asc=False), 1, rules.common_words).alias("top")
    )
    found: dict = {}
    for row in by_lang.collect():  # one short row a language and kind
        found.setdefault(row["lang"], {})[row["char"]] = row
    out = {}
    for lang, rows in found.items():
        if True not in rows or False not in rows:
            continue
        chars = np.zeros(len(CLASSES))
        for x in rows[True]["top"]:
            chars[x["bin"]] = x["n"]
        top = rows[False]["top"]
        shares = np.array([x["n"] for x in top], float) / rows[False]["total"]
        # the k-th class of common words ends where k / word_classes of their share is reached
        kind = np.minimum((np.cumsum(shares) - shares / 2) * rules.word_classes // max(shares.sum(), 1e-12), rules.word_classes - 1).astype(np.int64)
        place = np.full(WORD_BINS, rules.word_classes, np.int64)
        place[[x["bin"] - len(CLASSES) for x in top]] = kind
        out[lang] = (chars / chars.sum(), place, np.append(np.bincount(kind, weights=shares, minlength=rules.word_classes), max(0.0, 1 - shares.sum())))
    return out


def word_limit(shares: np.ndarray, n_words: np.ndarray, rules: Rules) -> np.ndarray:
    """Largest word distance of a text of so many words, for a language of these class shares."""
    none = np.zeros(len(shares))
    none[-1] = 1.0
    far = js_distance(none, shares)
    chance = (np.count_nonzero(shares) - 1) / (8 * np.log(2) * np.maximum(n_words, 1))
    return np.sqrt((rules.word_share * far) ** 2 + rules.word_noise * chance)


def _distances(w: _text.Words, chars: np.ndarray, langs: list, refs: dict, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(character distance, word distance, its limit) of each document: against its language's reference, or the nearest one."""
    n = len(w.counts)
    total = np.maximum(chars.sum(axis=1, keepdims=True), 1)
    bins = (_folded(w).hash % U(WORD_BINS)).astype(np.int64)
    doc = np.repeat(np.arange(n), w.counts)
    best, limit = np.full((2, n), np.inf), np.ones(n)
    for name, (classes, place, shares) in refs.items():
        mine = np.array([x == name or x not in refs for x in langs])
        if not mine.any():
            continue
        use = mine[doc]
        hist = np.bincount(doc[use] * len(shares) + place[bins[use]], minlength=n * len(shares)).reshape(n, -1)
        far = js_distance(hist / np.maximum(w.counts, 1)[:, None], shares[None])
        nearer = mine & (far < best[1])
        limit = np.where(nearer, word_limit(shares, w.counts, rules), limit)
        best[1] = np.where(nearer, far, best[1])
        best[0] = np.where(mine, np.minimum(best[0], js_distance(chars / total, classes[None])), best[0])
    best[~np.isfinite(best)] = 0.0
    return best[0], best[1], limit


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = ("doc_id", *COUNTS, "char_distance", "word_distance", "base_failed", "kept")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", char_distance double, word_distance double, base_failed boolean, kept boolean"


def _judged(given: DataFrame, rules: Rules, refs: dict) -> DataFrame:
    """SCHEMA of each row of ``given(doc_id, _text, _lang)``, with its ``_row`` if there is one."""

    def make():
        def step(batch):
            data, offsets = _text.text_buffers(batch.column("_text"))
            langs = batch.column("_lang").to_pylist()
            parts = []
            for a, b in _text.runs(offsets):
                w = _text.Words(data, offsets[a : b + 1])
                solid = w.solid & LEADS[w.data]
                chars = class_counts(w)
                far = _distances(w, chars, langs[a:b], refs, rules)
                parts.append((w.counts, _text.sums_by_bounds(solid, w.offsets), chars[:, 5], duplicate_lines(w), repeated_words(w), *far, chars.sum(axis=1)))
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(9)]
            n_words, repeat = cols[0].astype(np.int64), cols[4].astype(np.int64)
            failed = (n_words < rules.min_words) | (100 * repeat > rules.repeat_percent * n_words)
            odd = (cols[5] > rules.max_char_distance) & (cols[8] >= rules.guard_chars)
            odd |= (cols[6] > cols[7]) & (n_words >= rules.guard_words)
            arrays = [batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in cols[:5]), pa.array(cols[5].astype(float)), pa.array(cols[6].astype(float)), pa.array(failed), pa.array(~failed & ~odd)]
            rest = [c for c in batch.schema.names if c == "_row"]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(c) for c in rest], [*RESULT, *rest])

        return step

    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    if "_row" in given.columns:
        schema = schema.add(given.schema["_row"])
    return arrow_map(given, make, schema)


def _given(docs: DataFrame) -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang")]


def judge(docs: DataFrame, rules: Rules = Rules(), refs: dict | None = None) -> DataFrame:
    """Counts, distances and verdict of every row of ``docs(doc_id, text, lang)``.

    Null text counts as empty: no words, so ``base_failed``. A null or unknown lang takes the nearest
    reference; where no language has a reference the distances are 0. Each row is judged on its own, so
    ties, repeated rows and an empty table need no care; equal shares among the common words go by bin. Long texts are
    judged whole, in runs of bounded bytes but for a single longer text. Other columns are ignored.
    """
    return _judged(docs.select(*_given(docs)), rules, references(docs, rules) if refs is None else refs)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs`` as they are, whatever their names.

    Nulls, long and empty texts, repeated rows and an empty table are as for ``judge``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return _judged(docs.select(*_given(docs), row), rules, references(docs, rules)).where("kept").select("_row.*")
