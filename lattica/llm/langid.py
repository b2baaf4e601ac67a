"""Language identification by error-correcting output codes.

Every language has a binary codeword. For each bit a naive-Bayes classifier over hashed character n-grams
tells the languages whose bit is 1 from those whose bit is 0; its weights are log-odds of n-gram counts
over *all* learning documents. A text's margin for a bit is the mean log-odds of its n-grams. Decoding
takes the codeword of the least weighted hinge loss, each bit weighted by how well it separates the
learning languages; a small lead over the second codeword flags the text as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import _text
from lattica.llm._common import arrow_map

U = np.uint64
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    bins: int = 1 << 14
    sizes: tuple[int, ...] = (1, 2, 3)
    #: Added to every count.
    smoothing: float = 0.5
    #: Lead in weighted loss, as a share of the largest loss, under which a text is ambiguous.
    ambiguous: float = 0.1


#: Bytes that are no letters count as one gap; A-Z fold to a-z. Bytes of longer code points stay.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def gram_bins(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each n-gram, document of each): byte n-grams with a letter first, within documents."""
    x = _FOLD[data[offsets[0] : offsets[-1]]]
    n = len(x)
    ends = np.repeat(offsets[1:] - offsets[0], np.diff(offsets))
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    place = np.arange(n)
    code = np.zeros(n, np.uint32)
    bins, docs = [], []
    for size in range(1, max(s.sizes) + 1):
        code[: n - size + 1] = code[: n - size + 1] * np.uint32(257) + x[size - 1 :]
        if size in s.sizes:
            ok = (place + size <= ends) & (x != 32)
            h = (code[ok] + np.uint32(size)) * np.uint32(2654435761)
            bins.append((h >> np.uint32(8)) % np.uint32(s.bins))
            docs.append(doc[ok])
    return np.concatenate(bins), np.concatenate(docs)


def language_counts(docs: DataFrame, s: Settings) -> dict[str, np.ndarray]:
    """lang -> n-gram counts by bin, over all documents of a non-null lang."""

    def make():
        total: dict[str, np.ndarray] = {}

        def step(batch):
            data, offsets = _text.text_buffers(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for a, b in _text.runs(offsets, _text.RUN_BYTES):
                bins, doc = gram_bins(data, offsets[a : b + 1], s)
                names = sorted(set(langs[a:b]))
                code = np.array([names.index(x) for x in langs[a:b]])[doc]
                counts = np.bincount(code * s.bins + bins.astype(np.int64), minlength=len(names) * s.bins).reshape(len(names), -1)
                for name, c in zip(names, counts, strict=True):
                    total[name] = total[name] + c if name in total else c
            return iter(())

        def finish():
            for name, c in total.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bin", "n"])

        step.finish = finish
        return step

    given = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sums = arrow_map(given, make, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("ns")).collect()  # a row of at most s.bins numbers a language
    out = {}
    for r in rows:
        c = np.zeros(s.bins)
        c[r["bins"]] = r["ns"]
        out[r["lang"]] = c
    return out


def codewords(k: int) -> np.ndarray:
    """k distinct codewords of 0/1 bits, far apart: all splits of the languages in two, or for many languages a fixed random choice."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        cols = [[int(i == 0 or i in ones) for i in range(k)] for r in range(k - 1) for ones in combinations(range(1, k), r)]
        return np.array(cols, np.int8).T
    rng, best, length = np.random.default_rng(7), None, int(np.ceil(12 * np.log2(k)))
    for _ in range(200):
        m = rng.integers(0, 2, (k, length), dtype=np.int8)
        apart = min((m[i] != m[j]).sum() for i, j in combinations(range(k), 2))
        split = (m.sum(axis=0) % k != 0).all()
        if split and (best is None or apart > best[0]):
            best = (apart, m)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, -1/1
    log_odds: np.ndarray  # bins x bits
    shift: np.ndarray  # margin in the middle between the two sides
    scale: np.ndarray  # half their distance
    weight: np.ndarray  # of each bit in the loss
    settings: Settings

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) of rows of mean log-odds."""
        z = np.clip((margins - self.shift) / self.scale, -2, 2)
        loss = (np.maximum(0, 1 - z[:, None, :] * self.code[None]) * self.weight).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        first = np.take_along_axis(loss, order[:, :1], 1)[:, 0]
        if loss.shape[1] == 1:
            return best, np.ones(len(best)), np.zeros(len(best), bool)
        lead = (np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - first) / (3 * self.weight.sum())
        share = np.exp(-4 * (loss - first[:, None]) / self.weight.sum())
        return best, 1 / share.sum(axis=1), lead < self.settings.ambiguous


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from all rows of ``docs(text, lang)`` with a lang."""
    counts = language_counts(docs, settings)
    langs = sorted(counts)
    code = codewords(len(langs)).astype(np.int8) * 2 - 1
    if not langs:
        return Model([], code.reshape(0, 1), np.zeros((settings.bins, 1)), np.zeros(1), np.ones(1), np.ones(1), settings)
    share = np.stack([counts[x] + settings.smoothing for x in langs])
    share /= share.sum(axis=1, keepdims=True)  # every language weighs the same
    odds = []
    for bit in code.T:
        up = share[bit > 0].mean(axis=0) if (bit > 0).any() else np.full(settings.bins, 1 / settings.bins)
        down = share[bit < 0].mean(axis=0) if (bit < 0).any() else np.full(settings.bins, 1 / settings.bins)
        odds.append(np.log(up / down))
    log_odds = np.stack(odds, axis=1)
    mean = share @ log_odds  # languages x bits: the margin a typical text of the language has
    up = np.where(code > 0, mean, np.inf).min(axis=0)
    down = np.where(code < 0, mean, -np.inf).max(axis=0)
    up, down = np.where(np.isfinite(up), up, down + 1), np.where(np.isfinite(down), down, up - 1)
    scale = np.maximum((up - down) / 2, 1e-6)
    return Model(langs, code, log_odds, (up + down) / 2, scale, scale / scale.sum(), settings)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row of ``docs(doc_id, text)``.

    Null texts and texts without a letter are ``und`` with score 0. Other columns are no inputs; an empty
    table gives no rows; a model without languages gives ``und``.
    """
    table = model.log_odds.astype(np.float32)

    def make():
        import regex

        letter = regex.compile(r"\p{L}")
        names = [*model.langs, UNDETERMINED]

        def step(batch):
            col = batch.column("text")
            data, offsets = _text.text_buffers(col)
            texts = col.to_pylist()
            best, score, doubt = np.full(len(batch), len(model.langs)), np.zeros(len(batch)), np.ones(len(batch), bool)
            for a, b in _text.runs(offsets, _text.RUN_BYTES):
                if not model.langs:
                    continue
                bins, doc = gram_bins(data, offsets[a : b + 1], model.settings)
                n = np.bincount(doc, minlength=b - a)
                rows = np.zeros((b - a, table.shape[1]))
                for j in range(table.shape[1]):
                    rows[:, j] = np.bincount(doc, weights=table[:, j][bins], minlength=b - a)
                i, sc, am = model.decode(rows / np.maximum(n, 1)[:, None])
                some = np.array([n[d] > 0 and texts[a + d] is not None and letter.search(texts[a + d]) is not None for d in range(b - a)])
                best[a:b], score[a:b], doubt[a:b] = np.where(some, i, len(model.langs)), np.where(some, sc, 0.0), np.where(some, am, True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([names[i] for i in best]), pa.array(score), pa.array(doubt)], ["doc_id", "lang_pred", "score", "ambiguous"])

        return step

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(given, make, "doc_id long, lang_pred string, score double, ambiguous boolean")
