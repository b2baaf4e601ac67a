"""Kernels against brute force, without Spark."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import _text, fingerprint, langid, ngram_join, packing, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet="ab \n\té😀\x0b#|", max_size=60), min_size=1, max_size=6)


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_shingles_and_counts(texts):
    data, offsets = _text.text_buffers(pa.array([*texts, None]))
    got = dict(_text.shingle_sets(data, offsets))
    assert [len(got[i]) for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    w = _text.Words(data, offsets)
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        assert w.counts[i] == len(words)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert quality.duplicate_lines(w)[i] == dup
        grams = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        cover = {p for j in range(len(words) - 7) if grams[tuple(words[j : j + 8])] > 1 for p in range(j, j + 8)}
        assert quality.repeated_words(w)[i] == len(cover)
        assert quality.class_counts(w)[i].sum() == len(t)


@pytest.mark.parametrize("n", [1, 2, 4, 6, 12, 26, 27, 60, 400])
def test_pigeonhole_finds_every_link(n):
    """Two sets over the threshold share a key in a band that both take; the probe's cheapest segments suffice."""
    bands, rng = ngram_join.Bands(75), np.random.default_rng(n)
    for trial in range(60):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        shared = set(bands.of(len(a))) & set(bands.of(len(b)))
        found = False
        for band in shared:
            x, y = (ngram_join.segment_keys(s, _text.mix(s), band, bands) for s in (a, b))
            m = bands.segments[band]
            need = int(bands.needed(np.array([len(a)]), np.array([band]))[0])
            if bands.deletes(band):
                found |= bool(np.intersect1d(x, y).size)
            else:
                # whatever `need` segments a chooses, one of them agrees
                found |= int((x[:m] != y[:m]).sum()) < need
        assert found, (n, trial)


def test_power_of_two_pieces():
    for n in [1, 2, 3, 4095, 4096, 4097, 12345]:
        parts = packing.binary_lengths(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 4096 for p in parts)


def test_word_tokenizer_equals_the_full_one():
    P = pytest.importorskip("public_tokenizers")
    tok = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    rng = random.Random(3)
    alphabet = "abcXYZ éÉßΣİ'.,!?12 ½\n\t\x1c日😀́<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["don't I'LL", "<|endoftext|>a", "", " ", "ǅ ﬁ"]
    data, offsets = _text.text_buffers(pa.array(texts))
    ids, bounds = tok.encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tok.full.encode(t, add_special_tokens=False).ids, t


def test_entropy_steps():
    x = np.random.default_rng(1).integers(97, 103, 500).astype(np.uint8)
    steps = fingerprint.entropy_steps(x)
    for i in range(0, len(steps), 17):
        total = sum(int(fingerprint._NLOGN[c]) for c in Counter(x[i : i + fingerprint.WINDOW].tolist()).values())
        assert steps[i] == min((fingerprint._FULL - total) * fingerprint.STEPS // fingerprint._FULL, fingerprint.STEPS - 1)


def test_fingerprints_follow_likeness():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k)).encode()
    a, b = text(400), text(400)
    half = a[: len(a) // 2] + b[: len(b) // 2]
    rank = fingerprint.ranks_of(np.bincount(fingerprint.entropy_steps(np.frombuffer(a + b, np.uint8)), minlength=fingerprint.STEPS))
    da, db, dh, empty, again = fingerprint.digests([a, b, half, b"", a], rank)
    assert fingerprint.likeness(da, again) == 1.0 and da.text() == again.text() == fingerprint.Digest.parse(da.text()).text()
    assert fingerprint.likeness(da, dh) > 0.25 > 0.15 > fingerprint.likeness(da, db) and 0 <= fingerprint.likeness(da, empty) <= 1


def test_codewords_are_distinct():
    for k in (1, 2, 3, 4, 5, 9):
        m = langid.codewords(k)
        assert len({tuple(r) for r in m.tolist()}) == k


def test_toxicity_learns_planted_words():
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["vilescum", "worthlessfool", "nastytrash"]

    def doc(toxic):
        w = [rng.choice(plain) for _ in range(120)]
        for _ in range(6 * toxic):
            w[rng.randrange(120)] = rng.choice(bad)
        return " ".join(w)

    rows = [(doc(i % 3 == 0), int(i % 3 == 0)) for i in range(400)]
    model = toxicity.fit_texts(rows[:300])
    coder = toxicity.Coder(model.toxic, model.plain, model.settings)
    right = 0
    for text, y in rows[300:]:
        data = np.frombuffer(text.encode(), np.uint8)
        w = _text.Words(data, np.array([0, len(data)]), lower=True)
        right += (model.score(toxicity.features(model.odds[coder.cells(w)], w.bounds))[0] >= 0.5) == bool(y)
    assert right >= 90
    assert toxicity.fit_texts([("a", 1)]) is None
    assert os.path.exists(__file__)


def test_words_met_again_stay_in_the_tokenizer_memory(monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(packing, "MEMORY", 100)
    tok = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    learned, learn = Counter(), tok.learn
    monkeypatch.setattr(tok, "learn", lambda hashes, texts: (learned.update(texts), learn(hashes, texts)))
    for run in range(30):
        words = [f"often{chr(97 + i)}" for i in range(20)] + [f"r{run}x{i},." for i in range(40)] + ["Über.", "çà,", "ªb.", "ä'b."]
        text = " ".join(words)
        data = np.frombuffer(text.encode(), np.uint8)
        ids, bounds = tok.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == tok.full.encode(text, add_special_tokens=False).ids and bounds.tolist() == [0, len(ids)]
    assert len(tok.known) < 200 and all(learned[f"often{chr(97 + i)}"] == 1 for i in range(20))


def test_release_drops_what_runs_have_left():
    from lattica.llm._common import release

    data, offsets = _text.text_buffers(pa.array(["a b " * 500_000]))
    assert len(_text.Words(data, offsets).hash) == 1_000_000 and sum(x.nbytes for x in _text._powers.values()) > 30_000_000
    release()
    assert not _text._powers
