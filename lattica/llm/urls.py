"""URL filters by host-suffix and path-prefix expressions.

Every distinct URL is expanded into the expressions a rule could be written as: each suffix of its host's
labels, joined with each prefix of its path of a length that some rule has. Expressions meet rules in an
equi-join on a short hash prefix; full digests then confirm the match, and the longest rule that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest that the join meets on (32 bits); the rest confirms.
PREFIX_HEX = 8
BROADCAST_RULES = 100_000

#: (verdict, host, path prefix): fixed values of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages(page_id, url)``.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule (host and
    path together) wins, then the longer host, then ``block`` over ``allow``. Where none fits, ``rule`` is
    null and ``default`` is the verdict. Null and malformed URLs have an empty host and path. Repeated rows
    stay repeated; other columns are ignored; an empty table gives no rows.
    """
    rules = rules.select(
        "verdict", F.concat("host", "path").alias("rule"), F.length(F.concat("host", "path")).alias("long"), F.length("host").alias("host_long"), F.length("path").alias("path_long")
    ).where("rule is not null")
    rules = rules.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    lengths = sorted(r[0] for r in rules.select("path_long").distinct().collect())  # at most the longest rule's length
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    given = pages.select("page_id", "url")
    places = given.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    expressions = places.where("host != ''").select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    expressions = expressions.select("host", "path", F.explode("prefixes").alias("prefix"), "suffix").withColumn("digest", F.sha2(F.concat("suffix", "prefix"), 256))
    expressions = expressions.select("host", "path", "digest", F.substring("digest", 1, PREFIX_HEX).alias("short"))
    met = expressions.alias("e").join(rules.alias("r"), F.col("e.short") == F.col("r.short")).where("e.digest = r.digest")
    rank = F.struct("long", "host_long", F.col("r.verdict").alias("verdict"), "rule")
    best = met.select("host", "path", rank.alias("best")).groupBy("host", "path").agg(F.max("best").alias("best"))
    out = given.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return out.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def sql(rules=RULES, default: str = "allow") -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH rules(verdict, host, path) AS (VALUES {values}),
given AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/[^?#]*)?', 1, 's') AS path,
    row_number() OVER () AS row_id
  FROM pages),
fits AS (
  SELECT g.row_id, r.verdict, r.host || r.path AS rule,
    row_number() OVER (PARTITION BY g.row_id ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC, r.verdict DESC) AS k
  FROM given g JOIN rules r ON (g.host = r.host OR ends_with(g.host, '.' || r.host)) AND starts_with(g.path, r.path))
SELECT g.page_id, g.host, g.path, f.rule, coalesce(f.verdict, '{default}') AS verdict
FROM given g LEFT JOIN fits f ON g.row_id = f.row_id AND f.k = 1
"""
