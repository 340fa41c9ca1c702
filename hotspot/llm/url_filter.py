"""URL rules indexed by their rarest literal token.

A rule is a host pattern and a path prefix; ``*`` stands for any run of signs. Its literal
tokens are the host labels and path words that every fitting URL contains whole. Counted
over all URLs, the rarest of them is the rule's index key: a URL's own tokens fetch the
rules to try, and the regular expressions of those only are run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``host`` fits itself and all subdomains, ``path`` is a prefix; ``tier`` 0 outranks 1."""

    verdict: str
    host: str
    path: str = "/"
    tier: int = 0

    @property
    def text(self) -> str:
        return self.host + self.path


#: The method's own patterns, tried where no rule of the caller fits; no pattern either: allow.
PATTERNS = (
    Rule("block", "spam-farm.*", "", 1),
    Rule("block", "*", "*/wp-login.php", 1),
    Rule("block", "*", "*/casino/", 1),
    Rule("block", "*", "*/viagra/", 1),
    Rule("block", "doubleclick.net", "", 1),
)


def _glob(text: str, gap: str) -> str:
    return gap.join(re.escape(x) for x in text.split("*"))


def rule_pattern(rule: Rule) -> str:
    """Regular expression on ``host?path`` of a URL (neither part can hold a question mark)."""
    host = "[^?]*" if rule.host == "*" else r"(?:[^?]*\.)?" + _glob(rule.host, "[^?]*")
    return rf"(?s)^{host}\?{_glob(rule.path, '.*')}"


def rule_tokens(rule: Rule) -> list[str]:
    """Tokens in every URL that fits: whole host labels (``h:``) and whole path words (``p:``), next to no ``*``."""
    host = [f"h:{x}" for x in rule.host.lower().split(".") if x and "*" not in x]
    words = re.findall(r"(?:^|(?<=[^0-9A-Za-z*]))[0-9A-Za-z]+(?=[^0-9A-Za-z*])", rule.path)
    return sorted(set(host + [f"p:{x}" for x in words])) or ["*"]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(at > 0, F.translate(host, upper, lower)).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; ``*`` fetches the rules without a literal token."""
    tag = lambda prefix, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(prefix), w))
    return F.array_distinct(F.concat(F.array(F.lit("*")), tag("h:", F.split(host, r"\.")), tag("p:", F.split(path, "[^0-9A-Za-z]+"))))


def judge_urls(urls: DataFrame, rules: Iterable[Rule], patterns: Iterable[Rule] = PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict, pattern)`` for every row of ``urls``.

    The longest fitting rule (then the first by its text) gives ``rule`` and ``verdict``; else the
    longest fitting pattern gives ``pattern`` and ``verdict``; else the verdict is ``allow``. A null
    URL or one without ``://`` has empty host and path and fits no rule. Repeated rows and rows
    without an id are judged each for itself. An empty table gives an empty result; other columns
    are ignored. Rules are the caller's list, held by the driver; the join of tokens to rules is a
    plain one, so Spark broadcasts the rules only while they are small. URLs without a candidate
    take no part in it, and a URL's candidates meet in one row by its own key.
    """
    spark = urls.sparkSession
    out = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    key = F.concat_ws("?", "host", "path")
    out = out.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    listed = [*rules, *patterns]
    if not listed:
        return out.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    rows = [(n, r.verdict, r.text, r.tier, len(r.text), rule_pattern(r), rule_tokens(r)) for n, r in enumerate(listed)]
    table = spark.createDataFrame(rows, "n int, verdict string, rule string, tier int, length int, regex string, tokens array<string>")
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    # equal (host, path) pairs are judged once
    distinct = out.where("host <> '' or path <> ''").select("host", "path").distinct()
    tokens = distinct.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    seen = tokens.join(wanted, "token", "left_semi").groupBy("token").count()
    by_token = table.select("n", F.explode("tokens").alias("token")).join(seen, "token", "left")
    index = by_token.groupBy("n").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = table.drop("tokens").join(index, "n")
    tried = tokens.join(index, "token").where(F.rlike(key, F.col("regex")))
    rank = F.struct(F.col("tier").alias("tier"), (-F.col("length")).alias("length"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    best = tried.groupBy("host", "path").agg(F.min(rank).alias("best"))
    # AQE splits the pairs that hold many rows: the other side has one row for each
    judged = out.join(best, ["host", "path"], "left")
    own = F.col("best.tier") == 0
    return judged.select("page_id", "host", "path", F.when(own, F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.when(~own, F.col("best.rule")).alias("pattern"))


#: The rules of the registered query.
RULES = (
    Rule("allow", "org"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

ORACLE_SQL = r"""
WITH a AS (
  SELECT page_id, strpos(url, '://') AS i, url FROM pages),
b AS (
  SELECT page_id,
         CASE WHEN i > 0 THEN translate(regexp_extract(substr(url, i + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN i > 0 THEN regexp_extract(substr(url, i + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM a),
r(verdict, h, p, tier) AS (VALUES
  ('allow', 'org', '/', 0), ('block', 'example.org', '/es/', 0), ('block', 'example.org', '/en/1', 0),
  ('allow', 'com', '/fr/', 0), ('block', 'com', '/de/', 0), ('block', 'doubleclick.net', '', 1)),
q(verdict, re, rule) AS (VALUES
  ('block', '^(.*[.])?spam-farm[.][^?]*[?]', 'spam-farm.*'), ('block', '/wp-login[.]php', '**/wp-login.php'),
  ('block', '/casino/', '**/casino/'), ('block', '/viagra/', '**/viagra/')),
m AS (
  SELECT host, path, verdict, h || p AS rule, tier FROM (SELECT DISTINCT host, path FROM b) u, r
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) AND (host <> '' OR path <> '')
  UNION ALL
  SELECT host, path, verdict, rule, 1 FROM (SELECT DISTINCT host, path FROM b) u, q
  WHERE regexp_matches(CASE WHEN re LIKE '^%' THEN host || '?' || path ELSE path END, re)),
best AS (
  SELECT host, path, verdict, rule, tier FROM m
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY tier, length(rule) DESC, rule) = 1)
SELECT page_id, b.host, b.path, CASE WHEN tier = 0 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict,
       CASE WHEN tier = 1 THEN rule END AS pattern
FROM b LEFT JOIN best ON b.host = best.host AND b.path = best.path
"""
