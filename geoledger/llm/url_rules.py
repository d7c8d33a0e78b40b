"""URL filters: pattern rules looked up by their rarest literal token.

Only built-in SQL functions. A rule is a regular expression over
``host || path`` with the literal tokens every match must hold. The rule is
filed under the one of its tokens that is rarest in the URLs at hand; a URL
fetches the rules filed under its own tokens, and only those expressions run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "rule_id int, rule string, pattern string, tokens array<string>, verdict string, tier int, weight int"


@dataclass(frozen=True)
class Rule:
    """``tokens`` must occur in every URL the pattern matches; an empty tuple makes the rule a candidate for all URLs."""

    rule: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    tier: int = 1  # 0 is decided first
    weight: int = 0  # within a tier the heaviest match wins, then the smaller rule text


def host_path_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the URL's path starts with ``path``; the longest wins."""
    tokens = [t for t in re.split("[^a-z0-9]+", host) if t]
    tokens += [t for t in re.split("[^a-z0-9]+", path.lower())[1:-1] if t]  # whole tokens: neither end of a prefix is
    return Rule(host + path, f"^(?:[^/]*[.])?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(tokens)), verdict, 0, len(host + path))


def host_word_rule(word: str) -> Rule:
    """Blocks hosts with a label of this text, hyphens included."""
    return Rule(word, f"^(?:[^/]*[.])?{re.escape(word)}[.]", tuple(t for t in re.split("[^a-z0-9]+", word) if t), "block")


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(i, r.rule, r.pattern, list(r.tokens), r.verdict, r.tier, r.weight) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def url_host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Every row with ``host``, ``path``, ``rule`` (null if none matched) and ``verdict``; columns of these names are replaced.

    Works once per distinct (host, path): those are split into tokens, the
    tokens fetch candidate rules by an equi-join, the candidates' expressions
    run, and the best match per (host, path) is found by a combined
    aggregation. So a crowded host costs its distinct paths only. The rule
    table is joined like any other; the planner copies it to all tasks only
    while it is below the session's broadcast size. A null URL or one without
    ``://`` has empty host and path. Repeated rows each keep their result.
    """
    placed = pages.withColumns({"host": url_host(url), "path": url_path(url)}).drop("rule", "verdict")
    sites = placed.select("host", "path").distinct()
    words = F.array_distinct(F.split(F.lower(F.concat("host", F.lit("/"), "path")), "[^a-z0-9]+"))
    tokens = sites.select("host", "path", F.explode(words).alias("token"))  # an empty token is always among them or added
    literal = rules.select("rule_id", F.explode_outer("tokens").alias("token"))
    wanted = literal.select("token").distinct()
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(wanted, "token")
    filed = (
        literal.join(counts, "token", "left")
        .groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select("rule_id", F.coalesce("rarest.token", F.lit("")).alias("token"))
    )
    index = filed.join(rules.select("rule_id", "rule", "pattern", "verdict", "tier", "weight"), "rule_id")
    looked_up = tokens.where("token <> ''").unionByName(sites.withColumn("token", F.lit("")))
    best = (
        looked_up.join(index, "token")
        .where(F.expr("concat(host, path) rlike pattern"))
        .groupBy("host", "path")
        .agg(F.min(F.struct(F.col("tier"), (-F.col("weight")).alias("w"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return placed.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(
        *[c for c in placed.columns], "rule", "verdict"
    )
