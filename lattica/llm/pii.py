"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame operations only.

Base spans come from four fixed patterns with checks. They and runs of a secret's shape (SECRET: long hexadecimal
strings) seed the bootstrap: their left contexts (one, two and three words) are lexical patterns. Candidate
instances are identifier-shaped runs of a token (enough digits), and, whatever they are made of, runs that stand
where a value stands: after a quotation mark, or after ``=`` or ``:``. What precedes a run in its own token
belongs to its left context. Pattern and instance scores are computed in turn over the pattern-instance graph: a
pattern is worth the share of its occurrences, counted over the whole corpus, that extract scored instances; an
instance is worth the noisy-or of its patterns. Patterns of enough distinct instances and confidence then
mark what no base pattern knows. A seed by shape alone is no finding: it is one where a confident pattern extracts it.

Matches are found in one pass a kind: they are wrapped in a sentinel, split there, and placed by the
lengths of what stands before. Possessive quantifiers keep matching linear and free of recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm._common import BROADCAST_ROWS, materialize

#: Base kinds in the order of the output; fixed patterns.
EMAIL, IP, CARD, PHONE = "email", "ip", "card", "phone"
PATTERNS = {
    EMAIL: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
HINT = {EMAIL: "@", IP: ".", CARD: None, PHONE: "+"}
FOUND = "id"
#: Seeds of this kind are known by shape: hexadecimal runs of 32 characters or more with a digit and a letter.
SEED = "secret"
SECRET = "^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"

SENTINEL, STAND_IN = "\ue000", "\ue001"
SPACE = r"\x20\x09-\x0D"
#: Characters of an identifier; it starts and ends with a letter or digit. A token may hold several runs of them.
BODY = "A-Za-z0-9@._/+-"
#: The start of a run that stands inside a token, up to its first letter or digit.
INNER = rf"(?:(?<=[^{SPACE}{BODY}])[@._/+-]*+|(?<![{BODY}])[@._/+-]++)[A-Za-z0-9]"
BLOCK = 512
#: Characters before a span that its left context is read from; words that do not lie in them whole are no context.
LEFT = 256
#: Words of the longest context.
WORDS = 3
#: Mentions of a text up to which their contexts are counted in it; in texts of more, contexts are not ruled out early.
COUNTED_MENTIONS = 50
#: Patterns that may stand in a plan as literals; they are counted first.
LITERAL_PATTERNS = 10_000
#: One text in so many is counted first: what is too frequent there already is not counted over the corpus.
SIEVE = 64


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    #: Distinct scored instances, and confidence, that a pattern needs.
    min_support: int = 3
    min_confidence: float = 0.5
    #: Score from which an instance counts as found.
    min_score: float = 0.5
    #: Digits of a candidate run; characters of one that stands where a value stands.
    min_digits: int = 4
    min_value_chars: int = 4


def located(text: Column, pattern: str) -> Column:
    """Text pieces: odd ones (from 0) match, even ones stand between."""
    return F.split(F.regexp_replace(text, pattern, f"{SENTINEL}$0{SENTINEL}"), SENTINEL)


def placed(parts: str) -> Column:
    """array<struct<start, end, m>> of the odd pieces, in code points. Blocks keep appending cheap for any number of matches."""
    t = "array<struct<start:int,end:int,m:string>>"
    inner = (
        f"aggregate(b, named_struct('pos', o, 'odd', false, 'out', cast(array() as {t})), "
        "(a, p) -> named_struct('pos', a.pos + char_length(p), 'odd', not a.odd, 'out', "
        "if(a.odd, array_append(a.out, named_struct('start', a.pos, 'end', a.pos + char_length(p), 'm', p)), a.out)), a -> a.out)"
    )
    blocks = f"transform(sequence(0, (size({parts}) - 1) div {BLOCK}), i -> slice({parts}, cast(i as int) * {BLOCK} + 1, {BLOCK}))"
    offsets = (
        f"aggregate({blocks}, named_struct('pos', 0, 'out', cast(array() as array<int>)), "
        "(a, b) -> named_struct('pos', a.pos + aggregate(b, 0, (s, p) -> s + char_length(p)), 'out', array_append(a.out, a.pos)), a -> a.out)"
    )
    return F.expr(f"if(size({parts}) > 1, flatten(zip_with({blocks}, {offsets}, (b, o) -> {inner})), cast(array() as {t}))")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, value(i)).otherwise(F.pmod(value(i) * 2, F.lit(10)) + F.floor(value(i) * 2 / 10).cast("int"))
    return F.aggregate(places, F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == IP:
        short = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255))
    if kind == CARD:
        d = _digits(m)
        return F.length(d).between(13, 19) & _luhn(d)
    if kind == PHONE:
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: valid(kind, x["m"])


def _labelled(label: str, text: bool):
    def span(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(label).alias("kind"), *([x["m"].alias("m")] if text else []))

    return span


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with a column for each base kind: array<struct<start, end, m>>, by start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_t", F.when(F.contains(text, F.lit(SENTINEL)), F.translate(text, SENTINEL, STAND_IN)).otherwise(text))
    for kind, pattern in PATTERNS.items():
        hint = F.contains(F.col("_t"), F.lit(HINT[kind])) if HINT[kind] else F.lit(True)
        rows = rows.withColumn(f"_{kind}", F.when(hint, located(F.col("_t"), pattern)).otherwise(F.array(F.lit(""))))
    for kind in PATTERNS:
        rows = rows.withColumn(kind, placed(f"_{kind}"))
    for kind in PATTERNS:
        rows = rows.withColumn(kind, F.filter(kind, _checked(kind)))
    return rows.drop(*[f"_{k}" for k in PATTERNS])


def _before(start: Column) -> Column:
    near = F.substring(F.col("_t"), F.greatest(start - LEFT, F.lit(0)) + 1, F.least(start, F.lit(LEFT)))
    # a word that begins before the window is left out; so is one that may
    return F.when(start > LEFT, F.regexp_replace(near, f"^[^{SPACE}]+", "")).otherwise(near)


def _context(before: Column) -> Column:
    """The last words before a place, what stands before it in its own token being one of them."""
    # the pattern is a Python literal: in SQL text Spark would take its backslashes for escapes
    words = F.regexp_extract(before, f"(?:[^{SPACE}]+[{SPACE}]+){{0,{WORDS - 1}}}[^{SPACE}]+[{SPACE}]*$", 0)
    return F.regexp_replace(F.lower(words), "[0-9]", "0")


def mentions(rows: DataFrame, boot: Bootstrap) -> DataFrame:
    """Adds ``mentions``: array<struct<start, end, kind, m, left, loose>> of base spans, seeds by shape and candidate runs."""
    digits = rf"(?=(?:[A-Za-z@._/+-]*+[0-9]){{{max(boot.min_digits, 1)}}})"
    value = rf"(?<=[\"'=:])|(?<=[=:][{SPACE}])"
    run = rf"(?<![{BODY}])(?:{digits}|(?:{value})(?=[{BODY}]{{{max(boot.min_value_chars, 1)}}}))[{BODY}]++"
    rows = rows.withColumn("_tok", F.when(F.col("_t").rlike("[0-9\"'=:]"), located(F.col("_t"), run)).otherwise(F.array(F.lit(""))))
    rows = rows.withColumn("_tok", placed("_tok"))
    base = F.concat(*[F.transform(k, _labelled(k, True)) for k in PATTERNS])
    rows = rows.withColumn("_base", base)
    cut = F.expr(
        "transform(_tok, x -> named_struct('start', x.start + char_length(regexp_extract(x.m, '^[@._/+-]*', 0)), 'm', regexp_replace(x.m, '^[@._/+-]+|(?<![@._/+-])[@._/+-]+$', '')))"
    )
    rows = rows.withColumn("_cand", F.filter(cut, lambda x: x["m"] != ""))
    free = F.expr(
        "transform(filter(_cand, x -> not exists(_base, b -> b.start < x.start + char_length(x.m) and x.start < b.end)), "
        f"x -> named_struct('start', x.start, 'end', x.start + char_length(x.m), 'kind', if(x.m rlike '{SECRET}', '{SEED}', cast(null as string)), 'm', x.m))"
    )
    rows = rows.withColumn("_all", F.concat("_base", free))

    def with_left(x: Column) -> Column:
        before = _before(x["start"])
        # inside a token, but where no run starts: context_totals does not see such a place in the text
        loose = before.rlike(f"[^{SPACE}]$") & ~F.concat(before, F.substring(F.col("_t"), x["start"] + 1, F.lit(1))).rlike(f"{INNER}$")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["m"].alias("m"), _context(before).alias("left"), loose.alias("loose"))

    rows = rows.withColumn("mentions", F.transform("_all", with_left))
    rows = rows.withColumn("_w", F.when(F.size("mentions").between(1, COUNTED_MENTIONS), _words(_fold(F.col("_t")))))
    return rows.withColumn("mentions", _with_counts()).drop("_tok", "_cand", "_base", "_all", "_w")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def _fold(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[0-9]", "0")


def _with_counts() -> Column:
    """The mentions with ``here``: how often the context of one, two, ... words stands among the words _w of the text."""
    w = F.col("_w")

    def count(words: Column, k: int) -> Column:
        def same(y: Column, i: Column) -> Column:
            own = F.try_element_at(words, F.lit(-1))
            ok = F.startswith(y, own) & ((y == own) | F.substring(y, F.lit(1), F.length(own) + 1).rlike(f"{INNER}$"))
            for j in range(1, k):
                ok = ok & (F.get(w, i - j) == F.try_element_at(words, F.lit(-1 - j)))
            return F.when(ok, 1)

        return F.size(F.array_compact(F.transform(w, same)))

    def counted(x: Column) -> Column:
        words = _words(x["left"])
        here = F.when(w.isNotNull(), F.array(*[count(words, k) for k in range(1, WORDS + 1)])).otherwise(F.array(*[F.lit(0)] * WORDS))
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "kind", "m", "left", "loose")], here.alias("here"))

    return F.transform("mentions", counted)


def _patterns(left: Column) -> Column:
    """Lexical patterns of a left context: its last word, its last two, and so on."""
    words = F.filter(F.split(left, f"[{SPACE}]+"), lambda w: w != "")
    return F.array_compact(F.array(*[F.when(F.size(words) >= k, F.concat_ws(" ", *[F.try_element_at(words, F.lit(-i)) for i in range(k, 0, -1)])) for k in range(1, WORDS + 1)]))


def context_totals(docs: DataFrame, patterns: DataFrame, loose: DataFrame | None = None) -> DataFrame:
    """(pattern, total): how often each context of ``patterns(pattern)`` stands in ``docs``, over all of them.

    Contexts are runs of up to WORDS words, and what stands in a token before a run of it with the words before
    that token; ``loose(pattern)`` are those of mentions that start elsewhere in a token.
    """
    if loose is None:
        loose = patterns.select("pattern").limit(0)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(_words(_fold(text)).alias("w"))
    runs = lambda i: [f"if({i} >= {k - 1}, concat_ws(' ', {', '.join(f'w[{i} - {j}]' for j in range(k - 1, -1, -1))}), null)" for k in range(1, WORDS + 1)]
    few_patterns = patterns.limit(LITERAL_PATTERNS + 1).count() <= LITERAL_PATTERNS

    def counted(found: DataFrame) -> DataFrame:
        """(pattern, n): a text's patterns leave it once each, with their number."""
        # no filter on sizes: it would be pushed down, and the arrays built once more for it
        found = found.select(F.explode(F.transform(F.array_distinct("p"), lambda x: F.struct(x.alias("pattern"), F.size(F.filter("p", lambda y: y == x)).alias("n")))).alias("x"))
        return found.select("x.pattern", F.col("x.n").cast("long").alias("n"))

    if few_patterns:
        # places are looked up by the patterns' last words, then by the patterns, and only what is one leaves the text
        known = [r[0] for r in patterns.collect()]
        last = sorted({p.rsplit(" ", 1)[-1] for p in known})
        at = F.filter(F.transform("w", lambda x, i: F.when(x.isin(last), i)), lambda i: i.isNotNull())
        rows = words.select("w", at.alias("at")).select(F.flatten(F.expr(f"transform(at, i -> array({', '.join(runs('i'))}))")).alias("p"))
        rows = counted(rows.select(F.filter("p", lambda x: x.isin(known)).alias("p")))
    else:
        rows = words.select(F.explode(F.array_compact(F.flatten(F.expr(f"transform(w, (x, i) -> array({', '.join(runs('i'))}))")))).alias("pattern"))
    # few tokens hold an inner run: they are taken out with the words before them, and only they are cut up
    clean = F.when(F.contains(text, F.lit(SENTINEL)), F.translate(text, SENTINEL, STAND_IN)).otherwise(text)
    few = docs.select(_words(clean).alias("w"))
    places = F.filter(F.transform("w", lambda x, i: F.when(x.rlike(INNER), i)), lambda i: i.isNotNull())
    before = [f"if(i >= {j}, w[i - {j}], null)" for j in range(WORDS - 1, 0, -1)]
    few = few.select("w", places.alias("at")).select(F.explode(F.expr(f"transform(at, i -> named_struct('a', array_compact(array({', '.join(before)})), 'b', w[i]))")).alias("x")).select("x.a", "x.b")
    if few_patterns:
        # only prefixes that some pattern ends with are looked at
        ends = F.expr(f"sequence(1, greatest(1, least(char_length(b) - 1, {min(LEFT, max(map(len, last), default=1))})))")
        prefix = lambda e: F.substring(F.col("b"), F.lit(1), e)
        found = F.filter(ends, lambda e: _fold(prefix(e)).isin(last) & prefix(e + 1).rlike(f"{INNER}$"))
        few = few.select("a", "b", found.alias("ends")).select(F.transform("a", _fold).alias("a"), F.transform("ends", lambda e: _fold(prefix(e))).alias("bs"))
        contexts = F.flatten(F.transform("bs", lambda b: _patterns(F.concat_ws(" ", F.col("a"), b))))
        few = counted(few.select(F.filter(contexts, lambda x: x.isin(known)).alias("p")))
    else:
        few = few.withColumn("_in", located(F.col("b"), INNER)).withColumn("_in", placed("_in")).select("a", "b", F.explode("_in.end").alias("end")).where(F.col("end") - 1 <= LEFT)
        few = few.select(F.transform("a", _fold).alias("a"), _fold(F.expr("substring(b, 1, end - 1)")).alias("b"))
        few = few.select(F.explode(_patterns(F.concat_ws(" ", "a", "b"))).alias("pattern"))
    if few_patterns:
        rows = rows.union(few).union(loose.where(F.col("pattern").isin(known)).withColumn("n", F.lit(1).cast("long")))
        return rows.groupBy("pattern").agg(F.sum("n").alias("total"))
    rows = rows.union(few).union(loose)
    if patterns.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(patterns), "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).join(patterns, "pattern", "left_semi")


def sieved(docs: DataFrame, useful: DataFrame, boot: Bootstrap) -> DataFrame:
    """The patterns of ``useful(pattern, n)`` that may still be confident; the others never are, so no result changes.

    A pattern's hits are at most its ``n`` mentions, and its total is at least what some of the texts hold. Words that
    are frequent everywhere fall out here, and the count over all texts is left with patterns rarely seen elsewhere.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SIEVE)) == 0)
    floor = materialize(context_totals(some, useful.select("pattern")), "floor")
    frequent = F.coalesce(F.col("total"), F.lit(0)) * boot.min_confidence > F.col("n")
    return useful.join(floor, "pattern", "left").where(~frequent).select("pattern")


def bootstrap(docs: DataFrame, found: DataFrame, boot: Bootstrap) -> DataFrame:
    """(doc_id, key, extra): further spans, array<struct<start, end, kind, m>>, of the texts that have any.

    ``found``: written rows of doc_id, key and mentions.
    """
    none = found.select("doc_id", "key", F.expr("cast(array() as array<struct<start:int,end:int,kind:string,m:string>>)").alias("extra")).limit(0)
    at = found.where(F.size("mentions") > 0).select("doc_id", "key", F.explode("mentions").alias("x")).select("doc_id", "key", "x.*")
    near = at.withColumn("x", F.explode(F.arrays_zip(_patterns(F.col("left")).alias("pattern"), F.col("here").alias("here")))).withColumns({"pattern": F.col("x.pattern"), "here": F.col("x.here")}).where("pattern is not null")
    # hits are at most the mentions; occurrences at least those in the texts that mention something there
    bound = near.groupBy("pattern", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max("here").alias("here")).groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("here").alias("here"))
    bound = bound.where(F.col("n") >= boot.min_confidence * F.col("here")).select("pattern")
    edges = near.groupBy("pattern", F.xxhash64("m").alias("inst")).agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")).join(bound, "pattern")
    edges = materialize(edges, "edges")
    open_ = F.col("kind").isNull() | (F.col("kind") == SEED)  # no base span
    support = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), F.sum(open_.cast("long")).alias("open"), F.sum("n").alias("n"))
    useful = support.where((F.col("instances") >= boot.min_support) & (F.col("open") > 0)).select("pattern", "n")
    useful = materialize(useful, "contexts")
    if not useful.take(1):
        return none
    useful = materialize(sieved(docs, useful, boot), "sieved")
    if not useful.take(1):
        return none
    totals = materialize(context_totals(docs, useful, at.where("loose").select(F.explode(_patterns(F.col("left"))).alias("pattern"))), "totals")
    edges = materialize(edges.join(totals, "pattern"), "graph")
    seeds = edges.where("kind is not null").select("inst").distinct().withColumn("score", F.lit(1.0))
    scores, patterns = seeds, None
    for _ in range(boot.rounds):
        scored = edges.join(scores, "inst", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        patterns = scored.groupBy("pattern").agg(
            F.sum(F.col("n") * F.col("score")).alias("hits"), F.first("total").alias("total"), F.sum(F.when(F.col("score") >= boot.min_score, 1).otherwise(0)).alias("support")
        ).where(F.col("support") >= boot.min_support)
        patterns = patterns.withColumn("confidence", F.least(F.lit(1.0), F.col("hits") / F.col("total"))).where(F.col("confidence") >= boot.min_confidence)
        patterns = materialize(patterns.select("pattern", "confidence"), "patterns")
        if not patterns.take(1):
            return none
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))
        fresh = edges.where("kind is null").join(patterns, "pattern").groupBy("inst").agg((1 - doubt).alias("score"))
        scores = materialize(seeds.union(fresh.join(seeds, "inst", "left_anti")), "scores")
    good = scores.where(F.col("score") >= boot.min_score).select("inst")
    hits = at.where(open_).withColumn("pattern", F.explode(_patterns(F.col("left")))).withColumn("inst", F.xxhash64("m"))
    hits = hits.join(patterns.select("pattern"), "pattern", "left_semi").join(good, "inst", "left_semi")
    span = F.struct("start", "end", F.lit(FOUND).alias("kind"), "m")
    return materialize(hits.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(span)).alias("extra")), "extra")


def _joined(kinds: list[Column]) -> Column:
    return F.array_join(F.concat(*kinds), ",")


def _written(spans: str, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def find(docs: DataFrame, boot: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id (spans the bootstrap found) and the span arrays, for every row of ``docs(doc_id, text)``.

    Null text is empty and holds nothing. Equal texts under one doc_id get equal spans, so repeated rows
    need no care; a null doc_id is a value like any other. Other columns are ignored; an empty table gives
    no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = mentions(base_spans(given), boot).withColumn("key", F.xxhash64("_t"))
    found = materialize(rows.select("doc_id", "key", *PATTERNS, "mentions"), "found")
    extra = bootstrap(given, found, boot)
    found = found.drop("mentions")
    side = extra.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "extra")
    side = F.broadcast(side) if side.limit(10_001).count() <= 10_000 else side
    rows = found.join(side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").drop("_d", "_k")
    rows = rows.withColumn("extra", F.coalesce("extra", F.expr("cast(array() as array<struct<start:int,end:int,kind:string,m:string>>)")))
    base = [_written(k, k) for k in PATTERNS]
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined([*base, _written("extra", FOUND)]).alias("spans"), F.size("extra").cast("long").alias("n_id"), "key", *PATTERNS, "extra",
    )


def redact(docs: DataFrame, boot: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with every span, base or found, replaced by its kind in brackets; overlapping spans go as one.

    ``n_chars``, where there is one, follows the new text. Null texts stay null. Rows of one doc_id are told apart by
    their texts; the other columns stay as they are, whatever their names; an empty table gives no rows.
    """
    spans = find(docs, boot)
    marks = [F.transform(k, _labelled(k.upper(), False)) for k in PATTERNS]
    marks.append(F.transform("extra", _labelled(FOUND.upper(), False)))
    spans = spans.select("doc_id", "key", F.array_sort(F.concat(*marks)).alias("marks")).where(F.size("marks") > 0)
    spans = materialize(spans.dropDuplicates(["doc_id", "key"]), "marks").withColumnRenamed("doc_id", "of")
    # at most so many rows of a few spans each: broadcast only where their bytes are bounded, too
    few = spans.limit(BROADCAST_ROWS // 10 + 1).agg(F.count(F.lit(1)), F.max(F.size("marks"))).first()
    side = F.broadcast(spans) if few[0] <= BROADCAST_ROWS // 10 and (few[1] or 0) <= 100 else spans
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = F.when(F.contains(text, F.lit(SENTINEL)), F.translate(text, SENTINEL, STAND_IN)).otherwise(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("me"), F.xxhash64(clean).alias("hash"))
    joined = rows.join(side, F.col("me").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("key")), "left").withColumn("text", F.col("row.text").cast("string"))
    built = F.expr(
        "aggregate(marks, named_struct('at', 0, 'out', ''), (a, x) -> if(x.end <= a.at, a, named_struct('at', x.end, 'out', "
        "concat(a.out, if(x.start < a.at, '', concat(substring(text, a.at + 1, x.start - a.at), '[', x.kind, ']'))))), "
        "a -> concat(a.out, substring(text, a.at + 1, char_length(text))))"
    )
    joined = joined.withColumn("new", F.when(F.col("marks").isNull(), F.col("text")).otherwise(built))
    kind = {f.name: f.dataType for f in docs.schema}
    out = {"text": F.col("new"), "n_chars": F.char_length("new")}
    return joined.select(*[out[c].cast(kind[c]).alias(c) if c in out else F.col("row")[c].alias(c) for c in docs.columns])
