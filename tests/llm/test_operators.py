"""Operators on Spark: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import _common, chat, fingerprint, langid, mixing, ngram_join, packing, pii, quality, toxicity, urls
from lattica.llm._common import maybe_in

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the river ran over the stones and the town slept under a pale moon while nobody counted the lamps along the quay tonight because rain had come"
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " again and", "en", "b"), (4, "", "en", "b"), (5, None, None, None), (None, "no id here, mail x@y.zz or +1 (555) 123-4567", "en", "a"),
    (6, "short one", "de", "b"), (7, "SHORT One", "de", "b"), (8, "word " * 3000 + "4111 1111 1111 1111", "en", "c"), (9, "   \n\t", "en", "c"), (10, "10.0.0.300 and 10.0.0.3, 4111111111111112", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("clash"), "key": F.lit(7), "tokens": F.lit(None).cast("int")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = [shingles(t) for t in rows]
    up = list(range(len(rows)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    return sets, [top(i) for i in range(len(rows))]


def test_ngram_join(docs, empty):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in ngram_join.ngram_components(docs).collect())
    texts = [t for _, t, _, _ in ROWS]
    sets, top = components(texts)
    low = {c: min((ROWS[i][0] for i in range(len(ROWS)) if top[i] == c and ROWS[i][0] is not None), default=None) for c in set(top)}
    want = sorted((ROWS[i][0] or -1, len(sets[i]), (low[top[i]] if sets[i] else ROWS[i][0]) or -1) for i in range(len(ROWS)))
    assert got == want
    assert ngram_join.ngram_components(empty).count() == 0
    kept = Counter(r["doc_id"] for r in ngram_join.keep_one(docs).select("doc_id").collect())
    assert set(kept) == {1, 4, 5, None, 6, 8, 9, 10}


def test_keep_one_counts_rows(spark):
    own = " ".join(f"own{i}" for i in range(30))
    alone = " ".join(f"alone{i}" for i in range(30))
    rows = [(1, BASE, "a"), (1, BASE, "b"), (5, BASE + " again", "a"), (5, own, "a"), (None, BASE, "a"), (None, alone, "a"), (None, alone, "a"), (7, "", "a"), (7, "", "a"), (8, None, "a")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = [(1, BASE, "a"), (5, own, "a"), (None, alone, "a"), (7, "", "a"), (7, "", "a"), (8, None, "a")]
    assert Counter(tuple(r) for r in kept) == Counter(want)


def test_quality(docs, empty):
    rows = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert rows[1]["n_words"] == len(BASE.split()) and not rows[1]["base_failed"]
    assert rows[5]["n_words"] == 0 and rows[5]["base_failed"] and rows[8]["base_failed"] and rows[8]["n_repeat_words"] >= 3000
    assert quality.judge(empty).count() == 0
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.select("doc_id").collect()} == {1, 2, 3}


def test_pii(docs, empty):
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    text = next(t for i, t, _, _ in ROWS if i is None)
    a, b = text.index("x@"), text.index("+1")
    assert rows[None]["spans"] == f"email:{a}:{a + 6},phone:{b}:{b + 17}"
    assert rows[None]["base_sha256"] == hashlib.sha256(rows[None]["spans"].encode()).hexdigest()
    assert (rows[8]["n_card"], rows[10]["n_ip"], rows[10]["n_card"], rows[5]["n_email"]) == (1, 1, 0, 0)
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    new = {r["doc_id"]: r for r in out.select("doc_id", "text", "n_chars").collect()}
    assert new[None]["text"] == "no id here, mail [EMAIL] or [PHONE]" and new[None]["n_chars"] == len(new[None]["text"]) and new[5]["text"] is None
    assert new[10]["text"] == "10.0.0.300 and [IP], 4111111111111112"


def test_bootstrap_finds_what_seeds_point_at(spark):
    rows = [(i, f"badge number: {1000 + i}@corp{i}.example.org filed by clerk {i % 3}") for i in range(20)] + [(100 + i, f"we saw badge number: QX-{7000 + i}-Z on the desk") for i in range(4)] + [(200, "the year was 123456 or so")]
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        at = rows[20 + i][1].index("QX")
        assert found[100 + i] == f"id:{at}:{at + 9}"
    assert found[200] == ""


def _found(spark, rows):
    return {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_left_contexts_are_whole_words(spark):
    cases = [("we saw badge number: QX-7000-Z", "saw badge number: "), ("el n\u00famero 12345678", "el n\u00famero "), ("my ssn-nr 12345678", "my ssn-nr "), ("fuzzy\ty2\n12345678", "fuzzy\ty0\n")]
    rows = pii.mentions(pii.base_spans(spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")), pii.Bootstrap())
    got = {r["doc_id"]: [m["left"] for m in r["mentions"]] for r in rows.collect()}
    assert got == {i: [left] for i, (_, left) in enumerate(cases)}


@pytest.mark.parametrize("label", ["n\u00famero", "ssn-nr", "lobby key"])
def test_bootstrap_contexts(spark, label):
    # 'key' alone is too common to be trusted; 'lobby key' is not
    rows = [(i, f"{label} {1000 + i}@corp{i}.example.org key fact") for i in range(20)] + [(100 + i, f"then {label} QX-{7000 + i}-Z here") for i in range(4)] + [(300, "key word " * 200)]
    found = _found(spark, rows)
    for i in range(4):
        at = rows[20 + i][1].index("QX")
        assert found[100 + i] == f"id:{at}:{at + 9}"


def test_every_run_of_a_token_is_a_candidate(spark):
    cases = [
        ("x id=12345678", ["12345678"]), ("ID:QX-7000-Z", ["QX-7000-Z"]), ("(ref,99887766)", ["99887766"]), ("acct#55667788", ["55667788"]), ("n\u00ba12345678", ["12345678"]),
        ("a:1234;--b-5678-", ["1234", "b-5678"]), ("Z" + "9" * 99, ["Z" + "9" * 99]), ("ab12 c:3 (45", []),
    ]
    rows = pii.mentions(pii.base_spans(spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")), pii.Bootstrap()).collect()
    for r in rows:
        text, want = cases[r["doc_id"]]
        assert [m["m"] for m in r["mentions"]] == want and all(text[m["start"] : m["end"]] == m["m"] for m in r["mentions"])
    assert {r["doc_id"]: r["mentions"][0]["left"] for r in rows if r["doc_id"] < 5} == {0: "x id=", 1: "id:", 2: "(ref,", 3: "acct#", 4: "n\u00ba"}


def test_bootstrap_finds_labels_glued_on(spark):
    rows = [(i, f"acct#u{1000 + i}@corp{i}.example.org stays") for i in range(20)] + [(100 + i, f"on acct#5566{7000 + i}, and acct#{'7' * 70}{i}") for i in range(4)]
    rows += [(300 + i, f"see:{1000 + i}@corp{i}.example.org") for i in range(4)] + [(400, "see:1234567 " + "see:nothing " * 50)]
    found = _found(spark, rows)
    for i in range(4):
        assert found[100 + i] == "id:8:16,id:27:98"
    # 'see:' stands before other things too often
    assert found[400] == ""
    totals = pii.context_totals(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("see:",), ("acct#",)], "pattern string"), spark.createDataFrame([], "pattern string"))
    assert {r["pattern"]: r["total"] for r in totals.collect()} == {"see:": 55, "acct#": 28}


def test_mixing(spark, docs, empty):
    rows = [(i, "w " * (5 + i % 7), "en" if i % 4 else "de", f"s{i % 3}") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.2, "s1": 0.3, "s2": 0.5}, "lang": {"en": 0.6, "de": 0.4}}
    _, cells = mixing.mixture(table, targets, topic=F.lit("t"), budget_share=0.5)
    cells = cells.toPandas()
    for margin in ("source", "lang"):
        for value, share in targets[margin].items():
            assert abs(cells[cells[margin] == value].weight.sum() - share) < 1e-4
    assert abs((cells.prob * cells.tokens).sum() / cells.tokens.sum() - 0.5) < 1e-6 and cells.prob.max() <= 1
    drawn = mixing.sample(table, targets, topic=F.lit("t"), budget_share=0.5)
    assert abs(drawn.agg(F.sum("tokens")).first()[0] / cells.tokens.sum() - 0.5) < 0.05
    assert mixing.sample(docs, targets).count() >= 0 and mixing.sample(empty, targets).count() == 0
    assert mixing.keep_sampled(docs, {}).columns == docs.columns


def test_packing(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    by = {}
    for r in got:
        ids = b"".join(i.to_bytes(4, "little") for i in r["ids"])
        assert len(r["ids"]) == r["length"] and zlib.crc32(ids) == r["ids_crc32"] and r["length"] & (r["length"] - 1) == 0
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for i, t, _, _ in ROWS:
        want = full.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by[i, len(want)])
        assert sum((p for _, p in pieces), [])[: len(want)] == want or i == 2
    assert len({r["sequence_id"] for r in got}) == len(got) and packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0


def test_fingerprints(docs, empty):
    got = fingerprint.fingerprints(docs, range_docs=3).toPandas()
    order = sorted(ROWS, key=lambda r: (r[0] if r[0] is not None else -(2**63), r[1] or ""), reverse=True)
    want = []
    for k, (i, t, _, _) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        c = len(t) // 2
        want.append((i or -1, len(t), hashlib.sha256((t[: len(t) - c] + n[:c]).encode()).hexdigest()))
    assert sorted(want) == sorted(zip(got.doc_id.fillna(-1).astype(int), got.n_chars, got.edited_sha256, strict=True))
    assert got[got.doc_id.isin([1, 2])].fingerprint.nunique() == 1 and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert fingerprint.fingerprints(empty).count() == 0


def test_language_and_toxicity(spark, docs, empty):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert got[5]["lang_pred"] == got[9]["lang_pred"] == "und" and got[1]["lang_pred"] == "en" and 0 <= got[1]["score"] <= 1
    assert langid.identify(docs, langid.fit(empty)).where("lang_pred != 'und'").count() == 0 and langid.identify(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, None), (99, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert scored.count() == len(ROWS) and scored.where("score between 0 and 1").count() == len(ROWS) and toxicity.score(empty, None).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"), (4, 0, "user", "other"), (5, 0, "user", "other"), (6, None, None, None)]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("total", F.lit("x"))
    got = {r["conv_id"]: r["n_turns"] for r in chat.format_chats(t).collect()}
    assert got == {3: 3, 4: 1, 6: 1} and chat.format_chats(t.limit(0)).count() == 0


def test_urls(spark):
    pages = [(1, "http://A.example.ORG/es/1?x=http://z/es/"), (2, None), (3, "nonsense"), (4, "https://x.com/de/"), (5, "https://x.com/fr#top"), (6, "http://notexample.org/es/2"), (6, "http://example.org/en/12"), (7, "http://h?q=http://b.com/de/")]
    table = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in urls.judge(table, urls.rule_table(spark)).collect())
    assert got == sorted([
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "", "", "", "allow"), (3, "", "", "", "allow"), (4, "x.com", "/de/", "com/de/", "block"),
        (5, "x.com", "/fr", "", "allow"), (6, "notexample.org", "/es/2", "org/", "allow"), (6, "example.org", "/en/12", "example.org/en/1", "block"), (7, "h", "", "", "allow"),
    ])
    assert urls.judge(table.limit(0), urls.rule_table(spark)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage but the draw is followed in plain Python; the draw is compared by what it keeps."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as cp

    rows = [(i, t, lang or "en", s or "a", len(t or "")) for i, t, lang, s in ROWS if i is not None]
    rows += [(100 + i, " ".join(f"{w}{i}" for w in BASE.split()) + f" mail{i}@example.org", "en", "a", 0) for i in range(30)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    d, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for name, stage in cp.STAGES[:4]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = {r["doc_id"]: r["text"] for r in d.collect()}
        if name == "quality_rules":
            kept = {i: t for i, t, *_ in rows if len((t or "").split()) >= 20 and i != 8}
        elif name == "near_duplicates":
            ids = sorted(kept)
            _, top = components([kept[i] for i in ids])
            kept = {i: kept[i] for k, i in enumerate(ids) if min(j for j, c in zip(ids, top, strict=True) if c == top[k]) == i}
        elif name == "personal_data":
            kept = {i: re.sub(r"mail\d+@example\.org", "[EMAIL]", t) for i, t in kept.items()}
        else:
            assert set(got.items()) <= set(kept.items()) and got
            continue
        assert got == kept, name
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_join_against_brute_force(spark):
    # one passage that many sets share, near copies in a chain, sets on both sides of the threshold
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([*passage, *(f"u{d}x{i}" for i in range(4 + d % 30))]) for d in range(150)]
    texts += [" ".join(f"c{i}" if i >= d else f"d{i}" for i in range(60)) for d in range(12)]
    texts += [" ".join(f"s{(d // 3)}w{i}" for i in range(3 + d % 3)) for d in range(30)] + [texts[0], texts[151], "one two", "One two", "", None]
    _, want = components(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low = {top: min(i for i, t in enumerate(want) if t == top) for top in set(want)}
    for sizes in ({}, {"part_tokens": 500, "hot_local": 3, "hot_sets": 5}):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(rows, **sizes).collect()}
        assert got == {i: low[t] for i, t in enumerate(want)}


def test_chat_ties_have_one_order(spark):
    pairs = [(2 * k, 0, "user", f"a{k}") for k in range(12)] + [(2 * k + 1, 0, "user", t) for k in range(12) for t in (f"a{k}", f"b{k}")]
    got = {r["conv_id"] for r in chat.format_chats(spark.createDataFrame(pairs, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {2 * k + 1 for k in range(12)}


def test_clashing_columns_come_back_as_they_are(spark, docs):
    named = docs.withColumns({c: F.lit(v) for c, v in {"n_words": -7, "kept": "mine", "_text": 1, "_lang": 2, "_row": 3, "_s": 4, "_k": 5, "row": 6, "marks": 7, "prob": 8, "topic": 9}.items()})
    for out in (quality.keep_good(named), mixing.keep_sampled(named, {}, budget_share=1.0), pii.redact(named), ngram_join.keep_one(named)):
        assert out.columns == named.columns
        assert {(r["n_words"], r["kept"], r["_s"], r["marks"]) for r in out.select("n_words", "kept", "_s", "marks").collect()} == {(-7, "mine", 4, 7)}


def test_secrets_by_context(spark):
    rows = [(i, f'plain words here token = "{hashlib.sha256(str(i).encode()).hexdigest()[:40]}" and more') for i in range(6)] + [(10, 'then token = "hunter" too'), (11, "a token of love"), (12, '"quoted words" said she')]
    found = _found(spark, rows)
    assert all(found[i].startswith("id:") for i in range(6)) and found[11] == ""


def test_sieve_changes_no_result(spark, monkeypatch):
    rows = [(i, f'plain words and {1000 + i} more, token = "{hashlib.sha256(str(i).encode()).hexdigest()[:40]}" and {2000 + i} too') for i in range(8)]
    rows += [(100 + i, "salt and pepper and oil and bread and so on") for i in range(200)] + [(None, None), (300, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for sieve in (1, 64, 10**9):
        monkeypatch.setattr(pii, "SIEVE", sieve)
        found.append(sorted((str(r["doc_id"]), r["spans"]) for r in pii.find(df).collect()))
    assert found[0] == found[1] == found[2] and sum("id:" in s for _, s in found[0]) == 8
    monkeypatch.setattr(pii, "SIEVE", 1)
    useful = spark.createDataFrame([("and", 16), ('"', 8)], "pattern string, n long")
    assert [r[0] for r in pii.sieved(df, useful, pii.Bootstrap()).collect()] == ['"']


def test_key_filter_loses_nothing(spark, tmp_path):
    spark.range(0, 30000, 3).union(spark.sql("select cast(null as bigint)")).write.parquet(str(tmp_path / "keys"))
    keys, rows = spark.read.parquet(str(tmp_path / "keys")), spark.range(40000).union(spark.sql("select cast(null as bigint)"))
    for chunk_keys in (1000, 50_000):
        out = maybe_in(rows, keys, "id", chunk_keys=chunk_keys)
        assert out.count() == 40001
        got = {r["id"] for r in out.where("_maybe").collect()}
        assert got >= {*range(0, 30000, 3), None} and len(got) < 10001 + 300
    assert maybe_in(rows, keys.limit(0), "id").where("_maybe").count() == 0


def test_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    """However many sets are wanted: what reads their texts again has no exchange below the Python worker."""
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.range(5000).selectExpr("id as doc_id", "concat('a b c d e f g h ', id) as text").write.parquet(str(tmp_path / "docs"))
    spark.range(0, 5000, 2).selectExpr("id as doc_id").write.parquet(str(tmp_path / "wanted"))
    found = ngram_join._token_sets(spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "wanted")), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = plan[: plan.find("Initial Plan")] if "Initial Plan" in plan else plan
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
    assert 2500 <= found.count() < 2600


def test_sets_of_a_common_passage_do_not_meet(spark, monkeypatch):
    """Sets that share a passage, but have no partner, are ruled out before shards meet, of which there are as many as squares."""
    met = []
    whole = ngram_join._meetings
    monkeypatch.setattr(ngram_join, "_meetings", lambda sets, part: met.append(sets.count()) or whole(sets, part))
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([*passage, *(f"u{d}x{i}" for i in range(30))]) for d in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(rows, part_tokens=500, hot_local=3, hot_sets=5).collect()}
    assert got == {i: i for i in range(300)} and met and sum(met) == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = status.size()
    again = _common.materialize(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 10).alias("k")).count())
    assert again.count() == 10 and status.size() <= before + 1  # the count's own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_rows_that_no_group_rules_are_not_shuffled(spark, tmp_path):
    """However many rows go: the rows themselves reach no exchange but those that the key filter lets through."""
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(20))) for i in range(40)] + [(100 + i, " ".join(f"v{i}x{j}" for j in range(20))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    out = ngram_join.keep_one(spark.read.parquet(str(tmp_path / "docs")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(0, 40, 2), *range(100, 140)]
    assert plan.startswith("Union") and "_words" in plan


def test_sure_filter_tells_all_but_a_few(spark, tmp_path):
    spark.range(0, 60000).selectExpr("id", "if(id = 7, null, id) as k").write.parquet(str(tmp_path / "every"))
    every = spark.read.parquet(str(tmp_path / "every"))
    every.where("id % 3 > 0").write.parquet(str(tmp_path / "keys"))
    out, _ = _common.surely_in(every, spark.read.parquet(str(tmp_path / "keys")), every, "k")
    got = {r["id"]: r["_in"] for r in out.collect()}
    assert len(got) == 60000 and all(v is None or v == (i % 3 > 0) for i, v in got.items())
    assert sum(v is None for v in got.values()) < 300


def test_copies_are_neither_indexed_nor_shuffled(spark, tmp_path, monkeypatch):
    """Of each text one row is indexed, and rows that go are dropped where they are, but for a few."""
    rows = [(1000 * c + i if c else None if i == 3 else i, " ".join(f"w{i}x{j}" for j in range(20))) for c in range(9) for i in range(30)] + [(5, None), (None, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, indexed, asked = spark.read.parquet(str(tmp_path / "docs")), [], []
    groups, maybe = ngram_join.candidate_groups, ngram_join.maybe_in
    monkeypatch.setattr(ngram_join, "candidate_groups", lambda d, *a, **b: indexed.append(d.where("length(trim(text)) > 0").count()) or groups(d, *a, **b))
    monkeypatch.setattr(ngram_join, "maybe_in", lambda r, *a, **b: (asked.append(r.count()) if "row" in r.columns else None) or maybe(r, *a, **b))
    kept = ngram_join.keep_one(docs)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*(i for i in range(30) if i != 3), 1003, 5, None])
    assert 30 <= indexed[0] < 40 and 32 <= asked[-1] < 42


def test_groups_of_a_large_bundle_travel_packed():
    ids = np.arange(1, 7, dtype=np.int64)
    groups = pa.array([[{"gid": 100 + g, "probe": True} for g in range(50)]] * 6, pa.list_(pa.struct([("gid", pa.int64()), ("probe", pa.bool_())])))
    tokens = pa.array([[10 * i + j for j in range(10)] for i in range(6)], pa.list_(pa.int64()))
    table = pa.table({"part": pa.array([9] * 6, pa.int64()), "parts": pa.array([2] * 6, pa.int64()), "set_id": pa.array(ids), "component": pa.array(ids), "tokens": tokens, "groups": groups})
    out = ngram_join._own_part(table, 75)
    held = [r for r in out.to_pylist() if r["kind"] == ngram_join.HELD]
    assert len(held) == 6 and all(np.frombuffer(r["gids"], np.int64).tolist() == list(range(100, 150)) for r in held)


def test_split_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(int(p), int(c), np.unique(rng.integers(0, 60, 12)).astype(np.int64).tobytes()) for p in range(4) for c in rng.integers(0, 40, 6)]
    by: dict = {}
    for p, c, gids in rows:
        for g in np.frombuffer(gids, np.int64).tolist():
            by.setdefault(g, []).append((p, c))
    want = sorted((p, g) for g, x in by.items() if len({c for _, c in x}) > 1 for p in {p for p, _ in x})
    got = ngram_join._split_groups(spark.createDataFrame(rows, "part long, component long, gids binary"), 300)
    assert sorted((r["part"], r["src"]) for r in got.collect()) == want
