"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host with a path (fits the host and its subdomains where the path begins so) or a pattern (``||`` before a host part, ``*`` for
anything, ``^`` for a separator or the end, ``@@`` for an exception). Each becomes a regular expression over host and path, and is filed under
that of its literal tokens (runs of letters and digits that the expression needs as a whole) which is rarest among the URLs'. The distinct URLs'
tokens fetch their candidate rules by an equi-join, and only those are run.

Of the fitting host rules the longest decides; else the patterns: an exception allows, a match blocks, otherwise the URL is allowed.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated URLs are judged once;
a null page_id is kept; rules without a literal token are tried on every URL; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized, table

# Fixed values.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
PATTERNS = ("||ads-track.", "||cheap-pills.", "||adult-*.example", "||casino^", "/banner/*/click^", "/wp-login.php", "@@||help.adult-x.")
TOKEN = "[A-Za-z0-9]+"
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|$)"


def host_rule(host: str, path: str, verdict: str) -> tuple:
    """(rule, kind, verdict, expression, literal tokens)"""
    expression = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return f"{host}{path}", "host", verdict, expression, literal(f".{host}{path}", True)


def pattern_rule(pattern: str) -> tuple:
    verdict, rest = ("allow", pattern[2:]) if pattern.startswith("@@") else ("block", pattern)
    anchored, rest = rest.startswith("||"), rest.removeprefix("||")
    body = "".join({"*": ".*", "^": SEPARATOR}.get(c, re.escape(c)) for c in rest)
    expression = rf"^(?:[^/]*\.)?{body}" if anchored else body
    return pattern, "pattern", verdict, expression, literal(("." if anchored else "*") + rest)


def literal(pattern: str, whole_end: bool = False) -> list[str]:
    """The tokens that stand whole in every URL that fits: with a literal that isn't a letter or digit, or a separator, on both sides."""
    ended = pattern if whole_end and not pattern[-1].isalnum() else f"{pattern}*"
    bounded = lambda m: pattern[m.start() - 1 : m.start()] not in ("", "*") and ended[m.end() : m.end() + 1] not in ("", "*")
    return [m[0] for m in re.finditer(TOKEN, pattern) if bounded(m)]


def split(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda k: F.coalesce(F.regexp_extract("url", shape, k), F.lit(""))
    return pages.select("page_id", "url", F.translate(part(1), upper, lower).alias("host"), part(2).alias("path"))


def index(tokens: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """token, rule, kind, verdict, expression: each rule under its rarest token, or under "" if it has none. ``tokens`` holds a row for each
    distinct token of each URL."""
    spark = tokens.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r[4]})] or [("",)], "token string")
    often = tokens.join(sized(wanted), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    schema = "rule string, kind string, verdict string, expression string, tokens array<string>"
    own = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))
    exploded = spark.createDataFrame([tuple(r) for r in rules], schema).withColumn("token", F.explode(own))
    weighed = exploded.join(often, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = weighed.groupBy("rule", "kind", "verdict", "expression").agg(F.min(F.struct("n", "token")).alias("rarest"))
    return rarest.select("rarest.token", "rule", "kind", "verdict", "expression")


def judged(pages: DataFrame, host_rules: Sequence[tuple] = HOST_RULES, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rules = [*(host_rule(*r) for r in host_rules), *map(pattern_rule, patterns)]
    subject = F.concat("host", "path")
    # Verdicts come back by two hashes of the URL, not by the URL.
    parts = split(pages).withColumns({"a": F.xxhash64(subject), "b": F.xxhash64(F.lit(1), subject)})
    urls = cut(parts.select("a", "b", subject.alias("subject")).distinct())
    found = F.array_union(F.array_distinct(F.regexp_extract_all("subject", F.lit(TOKEN), 0)), F.array(F.lit("")))
    tokens = urls.select("a", "b", "subject", F.explode(found).alias("token"))
    by_token = sized(cut(index(tokens, rules)))  # as many rows as rules
    fitting = tokens.join(by_token, "token").filter(F.regexp_like("subject", F.col("expression")))
    of = lambda kind: F.col("kind") == kind
    verdicts = fitting.groupBy(F.col("a").alias("of_a"), F.col("b").alias("of_b")).agg(
        F.max(F.when(of("host"), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("longest"),
        F.max(of("pattern") & (F.col("verdict") == "block")).alias("blocked"),
        F.max(of("pattern") & (F.col("verdict") == "allow")).alias("excepted"),
    )
    by_pattern = F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("excepted", F.lit(False)), "block").otherwise("allow")
    verdict = F.coalesce("longest.verdict", by_pattern).alias("verdict")
    verdicts = sized(cut(verdicts.select("of_a", "of_b", F.col("longest.rule").alias("rule"), verdict)))
    joined = parts.join(verdicts, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
f AS (SELECT *, (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') AS r1,
  (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') AS r2,
  (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') AS r3,
  (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') AS r4, host || path AS s FROM p)
SELECT page_id, host, path, CASE WHEN r2 THEN 'example.net/en/' WHEN r3 THEN 'example.com/de/' WHEN r4 THEN 'org/fr/' WHEN r1 THEN 'net/' END AS rule,
  CASE WHEN r2 THEN 'allow' WHEN r3 THEN 'block' WHEN r4 THEN 'allow' WHEN r1 THEN 'block'
       WHEN regexp_matches(s, '^([^/]*\.)?help\.adult-x\.') THEN 'allow'
       WHEN regexp_matches(s, '^([^/]*\.)?(ads-track\.|cheap-pills\.|adult-.*\.example|casino([^A-Za-z0-9_.%-]|$))')
         OR regexp_matches(s, '/banner/.*/click([^A-Za-z0-9_.%-]|$)') OR contains(s, '/wp-login.php') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
