"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule is ``host/path`` text (``example.net/en/``: the host, all its subdomains, and
paths that start so) or a pattern of its own with the literal tokens it needs.  Tokens
are host labels (``h:net``) and path segments (``p:en``).  The URL corpus is counted once
for the tokens that rules use; every rule is filed under its rarest one.  Distinct
(host, path) pairs are split into tokens, a join on tokens fetches candidate rules, and
only those run their regular expressions.  A rule without a token is filed under a token
that every URL has.

The index is broadcast only when the rules number at most ``BROADCAST_RULES``; otherwise
Spark joins by shuffle.  Pairs are distinct before the join, so a host with a third of
all pages is judged once per path.

Defined results: a null url, or one without ``://``, has an empty host and path and fits
no rule; the longest fitting rule wins, then the first in text order; without a fitting
rule the verdict is ``default``; repeated rows are kept; extra columns pass through and
give way to result columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import lower_ascii

BROADCAST_RULES = 100_000
EVERY = "*"
RESULTS = ("host", "path", "rule", "verdict", "method_rule")


@dataclass(frozen=True)
class Rule:
    """``listed`` rules are reported by name; others only give a verdict."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = True


def listed_rule(text: str, verdict: str) -> Rule:
    """A ``host/path`` rule."""
    host, slash, path = text.partition("/")
    quoted = "".join(f"\\{c}" if not (c.isalnum() or c in "/_") else c for c in host + slash + path)
    tokens = [f"h:{label}" for label in host.split(".") if label]
    tokens += [f"p:{part}" for part in (slash + path).split("/")[1:-1] if part]  # whole segments only
    return Rule(text, verdict, f"^([^/]*\\.)?{quoted}", tuple(tokens))


def pattern_rule(name: str, verdict: str, pattern: str, *tokens: str) -> Rule:
    """A regular expression over ``host + path`` that needs all of the literal tokens."""
    return Rule(name, verdict, pattern, tokens, listed=False)


#: Rules of the method for URLs that no listed rule fits.
GENERAL = (
    pattern_rule("spam-farm", "block", r"^([^/]*\.)?spam-farm\.", "h:spam-farm"),
    pattern_rule("casino", "block", r"^([^/]*\.)?casino\.", "h:casino"),
    *[pattern_rule("adserver", "block", rf"^([^/]*\.)?{name}\.", f"h:{name}") for name in ("ads", "adserver", "doubleclick")],
    *[pattern_rule("login page", "block", rf"^[^/]*/([^?]*/)?{name}(\.[a-z]+)?$", f"s:{name}") for name in ("login", "signin", "logout")],
)


def url_parts(url: Column | str) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def url_tokens(host: Column, path: Column) -> Column:
    """Literal tokens: ``h:`` labels of the host, ``p:`` segments of the path, and ``s:`` the last segment up to its first dot."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    stem = F.array(F.concat(F.lit("s:"), F.substring_index(F.substring_index(path, "/", -1), ".", 1)))
    return F.array_distinct(F.concat(F.array(F.lit(EVERY)), labels, parts, stem))


def rule_index(pairs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(token, name, verdict, pattern, listed)``: every rule under its rarest token in the pairs' URLs."""
    spark = pairs.sparkSession
    shape = "id int, name string, verdict string, pattern string, listed boolean, tokens array<string>"
    known = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, r.listed, list(r.tokens) or [EVERY]) for i, r in enumerate(rules)], shape)
    needs = known.select("id", F.explode("tokens").alias("token"))
    asked = needs.select("token").distinct()
    asked = F.broadcast(asked) if len(rules) <= BROADCAST_RULES else asked
    seen = pairs.select(F.explode("tokens").alias("token")).join(asked, "token").groupBy("token").count()
    rarest = (
        needs.join(seen, "token", "left")
        .groupBy("id")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0).cast("bigint")).alias("n"), "token"))["token"].alias("token"))
    )
    return known.drop("tokens").join(rarest, "id").drop("id")


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with ``host``, ``path``, the listed ``rule`` that wins, ``method_rule`` and the ``verdict``."""
    rows = pages.drop(*RESULTS)
    host, path = url_parts(F.col(f"`{url}`"))
    parted = rows.withColumn("host", host).withColumn("path", path)
    pairs = parted.select("host", "path").distinct().withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    index = rule_index(pairs, rules)
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    candidates = pairs.select("host", "path", F.explode("tokens").alias("token")).join(index, "token")
    fitting = candidates.where(F.expr("rlike(concat(host, path), pattern)"))
    rank = F.struct((~F.col("listed")).alias("general"), (-F.length("name")).alias("n"), "name", "verdict")
    best = fitting.groupBy("host", "path").agg(F.min(rank).alias("b"))
    best = best.select(
        "host",
        "path",
        F.when(~F.col("b.general"), F.col("b.name")).alias("rule"),
        F.when(F.col("b.general"), F.col("b.name")).alias("method_rule"),
        F.col("b.verdict").alias("verdict"),
    )
    return parted.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(
        *[f"`{c}`" for c in rows.columns], *RESULTS
    )
