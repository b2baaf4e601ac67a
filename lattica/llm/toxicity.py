"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart: one on the residue of toxic documents (what stands out in
them against ordinary ones), one on ordinary text. A window of text is compressed with each; a window that
the toxic dictionary explains comes out shorter with it. How the two lengths and the window's own length
speak for toxicity is calibrated on labelled documents that trained no dictionary: each cell of (length,
difference, toxic length) has a log-odds. A document's score is a logistic function of its windows' log-odds,
calibrated on labelled documents of that second half as well.

Windows are word runs, each padded with zero bytes: the padding always compresses, so that the coder never
falls back to storing a short window as it is. Distinct windows of a run of text are compressed once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import _text
from lattica.llm._common import arrow_map

U = np.uint64


@dataclass(frozen=True)
class Settings:
    #: Labelled documents of each class that a fit takes at most: whole texts, picked by the hash of their id.
    sample_per_class: int = 3000
    dictionary_bytes: int = 4096
    level: int = 3
    pad: int = 32
    #: A word belongs to the toxic residue if the lower bound of its odds ratio (toxic against ordinary documents) is over this.
    residue_odds: float = 3.0
    bound_sigmas: float = 2.6
    #: Windows that a task remembers before it starts anew; only speed depends on it.
    memory: int = 500_000


CELLS = (16, 16, 16)


def _cell(length: np.ndarray, toxic: np.ndarray, plain: np.ndarray, pad_floor: int) -> np.ndarray:
    a = np.clip(length - 1, 0, CELLS[0] - 1)
    b = np.clip(plain - toxic + 6, 0, CELLS[1] - 1)
    c = np.clip(toxic - pad_floor, 0, CELLS[2] - 1)
    return (a * CELLS[1] + b) * CELLS[2] + c


class Coder:
    """Both compressors, and the calibration cell of each window."""

    def __init__(self, toxic: bytes, plain: bytes, s: Settings):
        kind = zstandard.DICT_TYPE_RAWCONTENT
        make = lambda d: zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.toxic, self.plain, self.s = make(toxic), make(plain), s
        self.floor = len(self.toxic.compress(b"\0" * s.pad))
        self.known: dict[int, int] = {}

    def _lengths(self, coder, buffer: bytes, segments: np.ndarray) -> np.ndarray:
        out = coder.multi_compress_to_buffer(zstandard.BufferWithSegments(buffer, segments.tobytes()))
        return np.fromiter((len(x) for x in out), np.int64, len(segments))

    def compress(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Cells of the windows start:end."""
        n = end - start
        total = n + 2 + self.s.pad
        at = np.cumsum(total) - total
        buffer = np.zeros(int(total.sum()), np.uint8)
        shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        buffer[np.repeat(at + 1, n) + shift] = data[np.repeat(start, n) + shift]
        buffer[at] = buffer[at + 1 + n] = 32
        segments = np.stack([at, total], axis=1).astype("<u8")
        raw = buffer.tobytes()
        return _cell(n, self._lengths(self.toxic, raw, segments), self._lengths(self.plain, raw, segments), self.floor)

    def cells(self, w: _text.Words) -> np.ndarray:
        """Cell of each word window of a run."""
        if len(self.known) > self.s.memory:
            self.known.clear()
        if not len(w.start):
            return np.zeros(0, np.int64)
        order = np.argsort(w.hash)
        ordered = w.hash[order]
        first = np.ones(len(order), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
        keys, place = ordered[first].tolist(), order[first]
        found = np.array([self.known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self.compress(w.data, w.start[place[new]], w.end[place[new]])
            self.known.update(zip([keys[i] for i in new], found[new].tolist(), strict=True))
        out = np.empty(len(order), np.int64)
        out[order] = found[np.cumsum(first) - 1]
        return out


def features(odds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document: its windows' summed and mean evidence for toxicity. No window gives zeros."""
    n = np.diff(bounds)
    total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[bounds])
    per = np.maximum(n, 1)
    strong, clear = np.maximum(odds - 1, 0), odds > 2
    return np.stack([
        total(odds) / np.sqrt(per), total(strong) / per * 100, np.log1p(total(strong)), np.log1p(total(clear)), total(clear) / per * 100, total(odds) / per * 10, np.log1p(n) / 5,
    ], axis=1)


@dataclass
class Model:
    toxic: bytes
    plain: bytes
    odds: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    weight: np.ndarray  # bias last
    settings: Settings

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.spread @ self.weight[:-1] + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps on the ridge-penalised log-likelihood; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def residue(toxic: list[bytes], plain: list[bytes], s: Settings) -> set[bytes]:
    """Words that stand out in toxic documents, by the lower confidence bound of their odds ratio."""
    c1, c0 = Counter(), Counter()
    for texts, c in ((toxic, c1), (plain, c0)):
        for t in texts:
            c.update(set(t.split()))
    n1, n0 = len(toxic), len(plain)

    def bound(w: bytes) -> float:
        a, b, c, d = c1[w] + 0.5, n1 - c1[w] + 0.5, c0[w] + 0.5, n0 - c0[w] + 0.5
        return math.log(a * d / (b * c)) - s.bound_sigmas * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)

    return {w for w, k in c1.items() if k > 1 and bound(w) > math.log(s.residue_odds)}


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; too few samples serve as they are."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples))[-size:] or b"\x01" * 64


def fit_texts(rows: list[tuple[str, int]], s: Settings = Settings()) -> Model | None:
    """Model from (text, label) rows; None if a class is missing in either half."""
    halves: dict = {(h, y): [] for h in (0, 1) for y in (0, 1)}
    for text, label in rows:
        raw = (text or "").encode()
        halves[zlib.crc32(raw) & 1, int(label)].append(raw)
    if not all(halves.values()):
        return None
    lower = lambda t: t.lower()
    toxic, plain = [lower(t) for t in halves[0, 1]], [lower(t) for t in halves[0, 0]]
    odd = residue(toxic, plain, s)
    parts = [b" " + b" ".join(w for w in t.split() if w in odd) + b" " for t in toxic]
    rest = [b" " + b" ".join(w for w in t.split() if w not in odd) + b" " for t in plain]
    model = Model(_dictionary(parts, s.dictionary_bytes), _dictionary(rest, s.dictionary_bytes), np.zeros(math.prod(CELLS)), np.zeros(1), np.ones(1), np.zeros(2), s)
    coder, seen = Coder(model.toxic, model.plain, s), []
    counts = np.zeros((2, math.prod(CELLS)))
    for y in (0, 1):
        for t in halves[1, y]:
            data = np.frombuffer(t, np.uint8)
            w = _text.Words(data, np.array([0, len(data)]), lower=True)
            cells = coder.cells(w)
            here = np.bincount(cells, minlength=counts.shape[1]) / max(1, len(cells))
            counts[y] += here
            seen.append((y, cells))
    counts /= np.array([[len(halves[1, 0])], [len(halves[1, 1])]])
    small = 2e-5
    model.odds = np.clip(np.log((counts[1] + small) / (counts[0] + small)), -1.0, 5.0)
    x = np.concatenate([features(model.odds[c], np.array([0, len(c)])) for _, c in seen])
    y = np.array([k for k, _ in seen], float)
    model.center, model.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weight = _logistic((x - model.center) / model.spread, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """Learn from labelled documents: at most ``sample_per_class`` of each class, those of the smallest hash of doc_id."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(5))
    picked = [known.where(F.col("toxic") == y).orderBy(order).limit(s.sample_per_class) for y in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # at most 2 * sample_per_class rows
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id").select("text", "toxic").collect()
    return fit_texts([(r["text"], r["toxic"]) for r in rows], s)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, n_windows, n_toxic of every row of ``docs(doc_id, text)``.

    ``n_toxic`` counts the windows with clear evidence. Null and blank texts have no window and get the score
    of no evidence at all; without a model every score is 0. Other columns are no inputs; an empty table
    gives no rows.
    """

    def make():
        coder = Coder(model.toxic, model.plain, model.settings) if model else None

        def step(batch):
            data, offsets = _text.text_buffers(batch.column("text"))
            out, n, hits = np.zeros(len(batch)), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for a, b in _text.runs(offsets):
                if coder is None:
                    continue
                w = _text.Words(data, offsets[a : b + 1], lower=True)
                odds = model.odds[coder.cells(w)]
                out[a:b] = model.score(features(odds, w.bounds))
                n[a:b], hits[a:b] = w.counts, _text.sums_by_bounds(odds > 2, w.bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(n), pa.array(hits)], ["doc_id", "score", "n_windows", "n_toxic"])

        return step

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(given, make, "doc_id long, score double, n_windows long, n_toxic long")
