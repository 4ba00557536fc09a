"""URL filter: rules indexed by their rarest literal token, regular expressions run last.

A rule is a regular expression over ``host + path`` plus the literal tokens every match holds.
Token frequencies are counted over the whole input; each rule is filed under its rarest token.
A URL's distinct tokens fetch their rules, and only those expressions run on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule sets up to this many rules are sent to every task; larger ones are joined by shuffle.
BROADCAST_RULES = 20_000
TOKENS = "[^0-9a-z]+"


@dataclass(frozen=True)
class Rule:
    """``tokens``: literals between separators that each matching URL has; ``rank``: the
    rule of the highest rank wins, then ``name`` in order."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains, and paths that start with ``path``."""
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    # the last part of a path may go on in the URL, so only closed parts are sure tokens
    closed = re.split(TOKENS, path.lower())[:-1]
    tokens = tuple(dict.fromkeys(t for t in [*re.split(TOKENS, host), *closed] if t))
    return Rule(host + path, verdict, pattern, tokens, 1_000_000 + len(host + path), True)


def word_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A rule of the method itself: a pattern over host and path, after all listed ones."""
    return Rule(pattern, verdict, pattern, tokens, len(pattern), False)


LISTED = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
#: Gambling, advert and adult hosts, whole tokens only.
WORDS = (
    word_rule("block", r"(?:^|[.-])casino[.-]", "casino"),
    word_rule("block", r"(?:^|[.-])free-bets[.-]", "free", "bets"),
    word_rule("block", r"(?:^|[.-])ads-track[.-]", "ads", "track"),
    word_rule("block", r"(?:^|[.-])porn[.-]", "porn"),
    word_rule("block", r"(?:^|[.-])xxx-\w+[.-]", "xxx"),
    word_rule("block", r"^(?:[^/]*\.)?doubleclick\.", "doubleclick"),
    word_rule("block", r"/wp-login\.php$", "wp", "login", "php"),
)


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased."""
    raw = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(raw, upper, lower), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(tokens: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Each rule under its rarest literal token, by the number of URLs that hold it;
    a rule without a literal is filed under the empty token, which every URL has."""
    spark = tokens.sparkSession
    rows = [(n, r.name, r.verdict, r.pattern, list(r.tokens) or [""], r.rank, r.listed) for n, r in enumerate(rules)]
    schema = "rule_no int, name string, rule_verdict string, pattern string, literals array<string>, rank int, listed boolean"
    table = spark.createDataFrame(rows, schema)
    literals = table.select("rule_no", F.explode("literals").alias("token"))
    count = tokens.join(F.broadcast(literals.select("token").distinct()) if len(rows) <= BROADCAST_RULES else literals.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n_urls"))
    filed = literals.join(count, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n_urls", F.lit(0)), "token"))["token"].alias("token"))
    return filed.join(table.drop("literals"), "rule_no")


def filter_urls(pages: DataFrame, rules: Iterable[Rule] = (*LISTED, *WORDS), default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict`` per row.

    Listed rules come before the method's own; of several the one of the highest rank
    (the longest) wins. ``rule`` names a listed rule or is null. A null URL or one without
    ``://`` has an empty host and path and gets the default. Repeated rows get a row each,
    other columns are not looked at, an empty table gives an empty result.
    """
    rules = list(rules)
    seen = pages.select(F.col(id_col).alias(id_col), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    # verdicts depend on host and path alone: each distinct pair is judged once
    spots = seen.groupBy("host", "path").agg(F.count("*").alias("n"))
    tokens = spots.select("host", "path", "n", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(F.concat("host", "path")), TOKENS)))).alias("token"))
    index = rule_index(tokens, rules)
    small = len(rules) <= BROADCAST_RULES
    fetched = tokens.join(F.broadcast(index) if small else index, "token")
    fits = fetched.where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("listed", "rank", F.negate("rule_no").alias("first"), "name", "rule_verdict")).alias("best"))
    return (
        seen.join(best, ["host", "path"], "left")
        .select(
            id_col,
            "host",
            "path",
            F.when(F.col("best.listed"), F.col("best.name")).alias("rule"),
            F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        )
    )
