"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over host and path (host lower-cased, the two strings joined). Its literal
tokens are the runs of letters and digits that any url it matches must hold whole; the rule is filed under
the one that the fewest urls hold. A url's own tokens fetch the rules filed under them, and only those run
their expressions. A rule without a whole literal token is tried on every url.

Null urls, and urls without "://", have an empty host and path, fetch no list rule and get the default
verdict. Repeated rows are judged once and given back as often as they came. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small

#: What separates the tokens of a url.
SEPARATOR = "[^a-z0-9]+"


class UrlRule(NamedTuple):
    """name: what to report. pattern: a regular expression that Java and RE2 read alike. rank: the largest
    that matches wins; rules of rank 0 decide only where no other matches. tokens: its literal tokens."""

    name: str
    pattern: str
    action: str
    rank: int
    tokens: tuple[str, ...]


def host_rule(host: str, path: str, action: str) -> UrlRule:
    """Fits the host, its subdomains, and paths that start with path. The longest rule wins."""
    name = host + path
    tokens = re.split(SEPARATOR, name.lower())
    if path and not re.search(SEPARATOR + "$", path.lower()):
        tokens.pop()  # the path may go on within this token
    return UrlRule(name, r"^(?:[^/]*\.)?" + re.escape(name) + ("" if path else "(?:/|$)"), action, len(name), tuple(t for t in tokens if t))


def word_rule(word: str, action: str = "block") -> UrlRule:
    """Fits urls in whose host or path the word stands between separators; '-' joins parts of a word."""
    return UrlRule(f"word:{word}", r"(?i)(?:^|[^a-z0-9])" + re.escape(word) + r"(?:[^a-z0-9]|$)", action, 0, tuple(t for t in re.split(SEPARATOR, word) if t))


#: The named rules of the contract: host, path, action.
LISTED = (host_rule("com", "/", "allow"), host_rule("example.com", "/en/", "block"), host_rule("www.example.com", "/en/", "allow"), host_rule("net", "/es/", "block"), host_rule("net", "/fr/", "block"))
#: Version of the method's own rules below; a change of any gets a new one.
VERSION = "2"
#: Words that mark a site as unwanted wherever no listed rule speaks: gambling, adult content, drugs, loans, piracy.
WORDS = (
    "bets", "betting", "bingo", "casino", "free-bets", "jackpot", "lottery", "poker", "roulette", "slots",
    "adult", "adult-x", "camgirls", "escort", "escorts", "hentai", "milf", "nude", "nudes", "porn", "porno", "sex", "sexy", "xxx",
    "cialis", "pills", "viagra", "cheap-meds", "cash-advance", "payday", "payday-loan", "payday-loans",
    "crack", "cracked", "keygen", "nulled", "torrent", "torrents", "warez", "forex-signals", "replica-watches",
)
#: Endings of downloads, which hold no text.
DOWNLOADS = ("apk", "bin", "deb", "dmg", "exe", "iso", "jar", "msi", "rar", "rpm", "tar", "torrent", "zip")
#: Shapes of hosts that are rarely sites for readers. Only the last but one holds a literal token.
SHAPES = (
    UrlRule("shape:address", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/|$)", "block", 0, ()),
    UrlRule("shape:login", r"^[^/]*@", "block", 0, ()),
    UrlRule("shape:digits", r"^[^/]*[0-9]{8}", "block", 0, ()),
    UrlRule("shape:punycode", r"(?i)^(?:[^/]*[^a-z0-9/])?xn--", "block", 0, ("xn",)),
    UrlRule("shape:hyphens", r"^(?:[^/-]*-){4}", "block", 0, ()),
)
#: The rules of the method's own verdict.
OWN = (*map(word_rule, WORDS), *(UrlRule(f"download:{x}", rf"(?i)\.{x}$", "block", 0, (x,)) for x in DOWNLOADS), *SHAPES)


def rules_frame(spark: SparkSession, rules: Iterable[UrlRule]) -> DataFrame:
    """rule_id, name, pattern, action, rank, tokens. Long lists come as a table with these columns."""
    rows = [F.struct(F.lit(i).cast("long").alias("rule_id"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.action).alias("action"), F.lit(r.rank).cast("long").alias("rank"), F.array(*map(F.lit, r.tokens)).cast("array<string>").alias("tokens")) for i, r in enumerate(rules)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: str) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """From the host's end up to ? # or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def file_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """rule_id, token: each rule under the literal token that the fewest urls hold; '' if it has none.

    tokens: one row per url and token. Only tokens that occur in rules are counted, over all urls.
    """
    of = rules.select("rule_id", F.explode_outer("tokens").alias("token")).fillna("", ["token"])
    seen = tokens.join(small(of.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    return of.join(seen, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (of rank over 0, else null), verdict.

    The largest rank wins; equal ranks go to the larger rule_id. Where only rules of rank 0 match, one that
    blocks suffices. Rules are broadcast only below a counted bound, else they are joined by token.
    """
    urls = pages.select(F.col(id_col).alias("_id"), host_of(url_col).alias("_host"), path_of(url_col).alias("_path"))
    parts = F.array_union(F.array(F.lit("")), F.split(F.lower(F.concat("_host", "_path")), SEPARATOR))
    tokens = urls.select("_id", "_host", "_path", F.posexplode(parts).alias("_pos", "token"))
    filed = file_rules(rules, tokens.select("token")).join(rules, "rule_id").select("token", "rule_id", "pattern", "rank", "action")
    near = tokens.join(small(materialise(filed, "filed-rules")), "token", "left")
    fits = F.expr("concat(_host, _path) RLIKE pattern")
    best = near.groupBy("_id", "_host", "_path").agg(
        F.count(F.when(F.col("_pos") == 0, 1)).alias("_hits"),
        F.count_distinct(F.when(F.col("_pos") == 0, F.coalesce("rule_id", F.lit(-1)))).alias("_per"),
        F.max(F.when(fits & (F.col("rank") > 0), F.col("rank") * (1 << 31) + F.col("rule_id"))).alias("_won"),
        F.max(F.when(fits & (F.col("rank") == 0), F.col("action") == "block")).alias("_blocked"),
    )
    named = rules.select((F.col("rank") * (1 << 31) + F.col("rule_id")).alias("_won"), F.col("name").alias("rule"), "action")
    out = best.join(small(named), "_won", "left").withColumn("_again", F.explode(F.sequence(F.lit(1), (F.col("_hits") / F.col("_per")).cast("int"))))
    own = F.when(F.coalesce("_blocked", F.lit(False)), "block").otherwise(default)
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("action", own).alias("verdict"))
