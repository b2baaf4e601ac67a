"""Packing by power-of-two decomposition.

A document of n tokens (its end token included) is cut into pieces of ``max_len`` and then the binary
digits of the rest, longest first. Every piece is a sequence of its own and its length is a power of
two: no sequence crosses documents and none needs padding. Pieces of equal length share a ``bucket``
(the exponent), from which batches of one shape are drawn.

Tokenisation is by word: the tokenizer's normaliser and pre-tokeniser never look across white space, so
a word's ids do not depend on its neighbours, and each task keeps the ids of the words it has met.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import _text
from lattica.llm._common import arrow_map

#: Words of a task's memory; beyond that those met in one run only go, or all (only speed depends on it).
MEMORY = 200_000


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable letter: printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts as the tokenizer file gives them, by way of their words.

    Words that the short cut does not cover (special tokens, anything but letters, digits and marks in
    the plain planes that normalise to themselves) go through the full tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        steps = json.loads(self.full.pre_tokenizer.__getstate__())["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        self.letters = _byte_letters()
        self.reset()
        #: Texts of which NFC, lower-casing and white space are plain: printable ASCII and Latin-1 letters.
        self.plain = regex.compile("[!-;=-~À-ÿ]*+")
        #: Ids of what mostly follows the letters of a word.
        self.marks = {m: self.piece(m) if m else [] for m in ("", ".", ",")}

    def reset(self) -> None:
        #: Hashes of the known words, rising, and the place of each in ``ends``.
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        #: The ids of word p are ids[ends[p]:ends[p + 1]].
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        #: Whether each of the known words was met again after its first run.
        self.again = np.zeros(0, bool)

    def thin(self) -> None:
        """Forget the words that were not met again; all, if most were."""
        stay = np.flatnonzero(self.again)
        if 2 * len(stay) > MEMORY:
            return self.reset()
        start = self.ends[self.place[stay]]
        length = self.ends[self.place[stay] + 1] - start
        to = np.concatenate([[0], np.cumsum(length)])
        self.ids = self.ids[np.repeat(start - to[:-1], length) + np.arange(to[-1])]
        self.known, self.place, self.ends, self.again = self.known[stay], np.arange(len(stay)), to, np.zeros(len(stay), bool)

    def piece(self, text: str) -> list[int]:
        # printable ASCII stands for itself
        return [t.id for t in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(self.letters))]

    def ids_of(self, text: str) -> list[int]:
        """Ids of one word."""
        bare = text.rstrip(".,")
        if bare.isalpha() and (text.isascii() or self.plain.fullmatch(text)):
            marks = text[len(bare) :]
            return self.piece(bare.lower()) + (self.marks[marks] if marks in self.marks else self.piece(marks))
        if self.plain.fullmatch(text):
            return [i for p in self.split.findall(text.lower()) for i in self.piece(p)]
        return self.full.encode(text, add_special_tokens=False).ids

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Keep the ids of new words, given by rising hash."""
        ids = [self.ids_of(t) for t in texts]
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.place = np.insert(self.place, at, len(self.ends) - 1 + np.arange(len(ids)))
        self.again = np.insert(self.again, at, False)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids])])
        self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], np.uint32)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, bounds of each) for UTF-8 bytes of whole documents.

        Each distinct word of the run is looked up once, by its 64-bit hash.
        """
        if len(self.known) > MEMORY:
            self.thin()
        w = _text.Words(data, offsets)
        if not len(w.hash):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        order = np.argsort(w.hash)
        ordered = w.hash[order]
        first = np.ones(len(order), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
        keys, where = ordered[first], order[first]
        at = np.searchsorted(self.known, keys)
        fresh = np.ones(len(keys), bool)
        if len(self.known):
            fresh = self.known[np.minimum(at, len(self.known) - 1)] != keys
            self.again[at[~fresh]] = True
        new = np.flatnonzero(fresh)
        if len(new):
            raw = w.data.tobytes()
            spans = zip(w.start[where[new]].tolist(), w.end[where[new]].tolist(), strict=True)
            self.learn(keys[new], [raw[a:b].decode() for a, b in spans])
            at = np.searchsorted(self.known, keys)
        word = np.empty(len(order), np.int64)
        word[order] = self.place[at][np.cumsum(first) - 1]
        start = self.ends[word]
        length = self.ends[word + 1] - start
        to = np.concatenate([[0], np.cumsum(length)])
        return self.ids[np.repeat(start - to[:-1], length) + np.arange(to[-1])], to[w.bounds]


def binary_lengths(n: int, max_len: int = 4096) -> list[int]:
    """Piece lengths of n tokens: as many of max_len (a power of two) as fit, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(max_len.bit_length() - 1, -1, -1) if rest >> k & 1]


def _piece_table(counts: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of ``counts`` tokens."""
    lengths = [binary_lengths(int(n), max_len) for n in counts]
    doc = np.repeat(np.arange(len(counts)), [len(x) for x in lengths])
    length = np.array([n for x in lengths for n in x], np.int64)
    start = np.cumsum(length) - length - np.repeat(np.cumsum(counts) - counts, [len(x) for x in lengths])
    return doc, start, length


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_len: int = 4096, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, bucket, ids_crc32, doc_tokens[, ids], sequence_id, offset.

    Null and empty texts make one piece, the end token. Rows of one doc_id, or of none, are documents of
    their own. Texts of any length are cut whole. Every partition of ``docs`` gives its pieces by bucket, longest
    first, then doc_id and start; ``sequence_id`` follows that order, is unique and stays the same while the input's
    partitions do. Other columns are ignored; an empty table gives no rows.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def make():
        tok = WordTokenizer(tokenizer_path)

        def step(batch):
            data, offsets = _text.text_buffers(batch.column("text"))
            names = batch.column("doc_id")
            for a, b in _text.runs(offsets, 4 * _text.RUN_BYTES):
                ids, bounds = tok.encode(data, offsets[a : b + 1])
                ids = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4")
                counts = np.diff(bounds) + 1
                doc, start, length = _piece_table(counts, max_len)
                ends = np.concatenate([[0], np.cumsum(length)])
                raw = memoryview(ids).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), np.int64, len(doc))
                arrays = [names.take(pa.array(a + doc)), pa.array(start), pa.array(length), pa.array(np.log2(length).astype(np.int32)), pa.array(crc), pa.array(counts[doc])]
                cols = ["doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32))))
                    cols.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, cols)

        return step

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, bucket int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = arrow_map(given, make, schema).sortWithinPartitions(F.col("bucket").desc(), "doc_id", "start", "ids_crc32")
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
