"""Improbable-feature digests.

Every window of WINDOW bytes of a text has an entropy. How often each entropy (in steps) occurs in the corpus
gives windows a rank: the rarer, the lower; the commonest of all and windows of almost no entropy are no
features. In every run of POPULARITY consecutive windows the leftmost one of lowest rank gets a vote;
windows of enough votes are the text's improbable features. Each feature sets BITS bits of a Bloom
filter of FILTER bytes; a filter that holds MAX_FEATURES features is closed and the next one chained. The
likeness of two digests is the mean, over the filters of the shorter one, of the best bit overlap with a
filter of the other, normalised between what chance gives and what is possible.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import _text
from lattica.llm._common import arrow_map

U = np.uint64
WINDOW = 32
POPULARITY = 32
MIN_VOTES = 12
STEPS = 256
FILTER = 256
BITS = 5
MAX_FEATURES = 160
#: Entropy steps under which a window is too plain to be a feature.
PLAIN = 40
#: Documents of a range of ids that one task deals with in turn.
RANGE_DOCS = 4000
MAX_RANGES = 4096
NULL_ID = -(2**63)

_COUNT = np.arange(WINDOW + 1)
#: n log2 n, scaled so that entropies are whole numbers.
_NLOGN = np.round(np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0) * 1024).astype(np.int32)
_GAIN = np.diff(_NLOGN)
_FULL = int(_NLOGN[WINDOW])


def entropy_steps(x: np.ndarray) -> np.ndarray:
    """Entropy of each window of WINDOW bytes of x, as a step of STEPS.

    From one window to the next a byte leaves and a byte comes; what that changes depends on how often each
    stands among the WINDOW - 1 bytes between.
    """
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, np.uint8)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        same = x[k:] == x[:-k]
        before[k:] += same
        after[:-k] += same
    head = np.bincount(x[:WINDOW], minlength=256)
    total = np.empty(n - WINDOW + 1, np.int32)
    total[0] = _NLOGN[head].sum()
    np.cumsum(_GAIN[before[WINDOW:]] - _GAIN[after[: n - WINDOW]], out=total[1:])
    total[1:] += total[0]
    return np.minimum((_FULL - total) * STEPS // _FULL, STEPS - 1).astype(np.uint8)


def step_counts(docs: DataFrame) -> np.ndarray:
    """How often each entropy step occurs, over all windows of all documents."""

    def make():
        counts = np.zeros(STEPS, np.int64)

        def step(batch):
            data, offsets = _text.text_buffers(batch.column("text"))
            for a, b in _text.runs(offsets, 1 << 18):
                # windows across two documents of a run are left out
                s = entropy_steps(data[offsets[a] : offsets[b]])
                if len(s):
                    ok = np.ones(len(s), bool)
                    for e in (offsets[a + 1 : b] - offsets[a]).tolist():
                        ok[max(0, e - WINDOW + 1) : e] = False
                    counts[:] += np.bincount(s[ok], minlength=STEPS)
            return iter(())

        def finish():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS, dtype=np.int32)), pa.array(counts)], ["step", "n"])

        step.finish = finish
        return step

    rows = arrow_map(docs.select(F.col("text").cast("string").alias("text")), make, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(STEPS, np.int64)
    for r in rows:
        out[r["step"]] = r["n"]
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each step, 1 for the rarest that occurs; 255 for plain steps and the commonest one."""
    order = np.lexsort((np.arange(STEPS), counts))
    rank = np.empty(STEPS, np.uint8)
    rank[order] = np.clip(np.arange(STEPS), 0, 253) + 1
    rank[:PLAIN] = 255
    if counts.any():
        rank[int(np.argmax(counts))] = 255
    return rank


def select(steps: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts of the improbable windows of a text, from its windows' entropy steps."""
    r = rank[steps]
    n = len(r)
    if n == 0:
        return np.zeros(0, np.int64)
    run = min(POPULARITY, n)
    best, width = (r.astype(np.int64) << 40) | np.arange(n), 1
    while width * 2 <= run:  # sliding minimum by doubling
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < run:
        best = np.minimum(best[: len(best) - (run - width)], best[run - width :])
    best = best[best < (255 << 40)] & ((1 << 40) - 1)
    votes = np.bincount(best, minlength=n)
    return np.flatnonzero(votes >= min(MIN_VOTES, max(1, run // 2)))


@dataclass
class Digest:
    filters: np.ndarray  # filters x FILTER bytes
    counts: list[int]

    def text(self) -> str:
        """``features per filter, joined by commas : base64 of the filters``."""
        return ",".join(map(str, self.counts)) + ":" + base64.b64encode(self.filters.tobytes()).decode()

    @staticmethod
    def parse(text: str) -> Digest:
        counts, _, body = text.partition(":")
        raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, FILTER)
        return Digest(raw, [int(c) for c in counts.split(",") if c])


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    """Digests of texts' UTF-8 bytes, in runs. A text without features is digested whole, as one feature."""
    out: list[Digest] = []
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    for a, b in _text.runs(ends, 1 << 18):
        x = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        steps = entropy_steps(x)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_text._BYTE[x] * _text._power(_text._P, len(x))[: len(x)], out=sums[1:])
        inverse = _text._power(_text._P_INV, len(x) + 1)
        for i in range(a, b):
            lo, hi = int(ends[i] - ends[a]), int(ends[i + 1] - ends[a])
            at = select(steps[lo : max(lo, hi - WINDOW + 1)], rank) + lo
            if len(at):
                h = _text.mix((sums[at + WINDOW] - sums[at]) * inverse[at])
                _, first = np.unique(h, return_index=True)
                h = h[np.sort(first)]
            else:
                h = np.frombuffer(hashlib.sha256(texts[i]).digest()[:8], np.uint64)
            n = -(-len(h) // MAX_FEATURES)
            which = np.arange(len(h)) // -(-len(h) // n)
            bits = np.zeros((n, FILTER * 8), np.uint8)
            for j in range(BITS):
                bits[which, ((h >> U(11 * j)) % U(FILTER * 8)).astype(np.int64)] = 1
            out.append(Digest(np.packbits(bits, axis=1), np.bincount(which, minlength=n).tolist()))
    return out


def likeness(a: Digest, b: Digest) -> float:
    """0 (as chance would have it) to 1 (equal)."""
    if a.counts == b.counts and np.array_equal(a.filters, b.filters):
        return 1.0
    if len(a.filters) > len(b.filters):
        a, b = b, a
    x, y = np.unpackbits(a.filters, axis=1).astype(np.float32), np.unpackbits(b.filters, axis=1).astype(np.float32)
    nx, ny = x.sum(axis=1), y.sum(axis=1)
    both = x @ y.T
    chance = nx[:, None] * ny[None] / (FILTER * 8)
    most = np.minimum(nx[:, None], ny[None])
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    best = score.max(axis=1)
    weight = np.array(a.counts, float)
    return float((best * weight).sum() / weight.sum())


def _edited(text: str, following: str) -> str:
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None, range_docs: int = RANGE_DOCS) -> DataFrame:
    """SCHEMA for every row of ``docs(doc_id, text)``: each text, its edited form, and the next document's likeness.

    The next document is the one of the next smaller doc_id (rows of one doc_id: by text; a null doc_id comes
    last), after the last the first. The edited text has its last floor(n / 2) code points replaced by as many
    from the start of the next document, or all it has. Null text is empty. Other columns are ignored; an
    empty table gives no rows.

    Rows are dealt by ranges of doc_id, once, and each range is read in order; the first row of every range also
    goes to the range before it.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("order_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rank = ranks_of(step_counts(rows)) if rank is None else rank
    ids = rows.select("order_id")
    n = ids.count()
    parts = max(1, min(MAX_RANGES, -(-n // range_docs)))
    cuts = sorted(set(ids.approxQuantile("order_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    cuts = [int(c) for c in cuts]

    bucket = _bucket_of(F.col("order_id"), cuts)
    order = F.struct("order_id", "text")
    small = rows.select("order_id", bucket.alias("bucket"))
    heads = {r["bucket"]: r["top"] for r in small.groupBy("bucket").agg(F.max("order_id").alias("top")).collect()}  # one id a range
    present = sorted(heads, reverse=True)
    # the document after a range's last one is the head of the next lower range that has rows; after the lowest, of the highest
    target = {}
    for i, b in enumerate(present):
        target.setdefault(heads[present[(i + 1) % len(present)]], []).append(b)
    spark = docs.sparkSession
    links = spark.createDataFrame([(k, b) for k, v in target.items() for b in v], "order_id long, bucket int")
    guests = rows.join(F.broadcast(links), "order_id").groupBy("bucket").agg(F.max(order).alias("o"))
    guests = guests.select("bucket", F.lit(True).alias("guest"), "o.order_id", "o.text")
    dealt = rows.select(bucket.alias("bucket"), F.lit(False).alias("guest"), "order_id", "text").unionByName(guests)
    dealt = dealt.repartition(max(len(present), 1), "bucket").sortWithinPartitions("bucket", "guest", F.col("order_id").desc(), F.col("text").desc())

    def make():
        held: list = []  # the last row: (bucket, order_id, text, digest), or none after a guest

        def step(batch):
            rows = [*held, *zip(*(batch.column(c).to_pylist() for c in ("bucket", "order_id", "text", "guest")), strict=True)]
            ready = held[0][3] if held and isinstance(held[0][3], Digest) else None
            texts, todo = [r[2] for r in rows], {}
            pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and rows[i][3] is not True]
            edited = {i: _edited(texts[i], texts[i + 1]) for i in pairs}
            for t in [*texts, *edited.values()]:
                todo.setdefault(t, len(todo))
            if ready is not None and len(rows) > 1 and texts[0] not in texts[1:] and texts[0] not in edited.values():
                del todo[texts[0]]
                todo = {t: k for k, t in enumerate(todo)}
            made = digests([t.encode() for t in todo], rank)
            of = lambda t: made[todo[t]] if t in todo else ready
            out = [[] for _ in range(7)]
            for i in pairs:
                own, other, following = of(texts[i]), of(edited[i]), of(texts[i + 1])
                me = rows[i][1] if rows[i][1] != NULL_ID else None
                row = (me, len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), own.text(), other.text(), likeness(own, other), likeness(own, following))
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            held[:] = [] if not rows or rows[-1][3] is True else [(rows[-1][0], rows[-1][1], texts[-1], of(texts[-1]))]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        return step

    return arrow_map(dealt, make, SCHEMA)


def _bucket_of(col, cuts: list[int]):
    """Index of the range of an id: the number of cuts below it."""
    if not cuts:
        return F.lit(0)
    inner = F.array(*[F.lit(c).cast("long") for c in cuts])
    return F.size(F.filter(inner, lambda c: c < col)).cast("int")
