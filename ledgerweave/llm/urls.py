"""URL verdicts from pattern rules indexed by their rarest literal token.

A rule is ``host/path``: it fits that host and its subdomains if the path starts as the
rule's does; ``*`` stands for anything.  Tokens are runs of letters and digits.  Each rule
is filed under that token of its own which fewest URLs hold (those next to a ``*``, or at
the end of a path that may go on, are no whole tokens).  The tokens of a URL fetch the rules
filed under them, and only those run their regular expression.  Rules without a whole token
are filed under the empty one, which every URL has.

The rule list is the caller's and small; its index goes to every task.  All of the work on
URLs is DataFrame functions.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules whose index may be broadcast; a longer list is refused.
MAX_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` for what ``pattern`` fits; rules of a smaller ``tier`` go first, then longer ones."""

    verdict: str
    pattern: str
    tier: int = 0

    @property
    def regex(self) -> str:
        escaped = ".*".join(re.sub(r"([^\w/])", r"\\\1", part, flags=re.ASCII) for part in self.pattern.split("*"))
        return rf"(?s)^(?:[^/]*\.)?{escaped}"

    @property
    def tokens(self) -> list[str]:
        found = re.finditer(r"[a-z0-9]+", lowered := self.pattern.translate(_LOWER))
        whole = [m for m in found if m.end() < len(lowered) and "*" not in lowered[max(0, m.start() - 1) : m.end() + 1]]
        return [m.group() for m in whole] or [""]


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host(url: str) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_union(F.split(_lower(target), "[^a-z0-9]+"), F.array(F.lit("")))


#: A rule as it goes to Spark; all rules are one literal, so that a long list makes no long plan.
_FILED = "array<struct<tier:int,shorter:int,pattern:string,verdict:string,regex:string,tokens:array<string>>>"


def _table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    made = [
        {"tier": r.tier, "shorter": -len(r.pattern), "pattern": r.pattern, "verdict": r.verdict, "regex": r.regex, "tokens": r.tokens}
        for r in rules
    ]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(made)), _FILED)))


def _index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(token, hit, regex)``, a row per rule, under the token that fewest URLs hold."""
    listed = _table(urls.sparkSession, rules).select("regex", F.struct("tier", "shorter", "pattern", "verdict").alias("hit"), F.explode("tokens").alias("token"))
    wanted = listed.select("token").distinct()
    held = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    # Both sides are bounded by the rules.
    counted = listed.join(F.broadcast(held), "token", "left")
    return counted.groupBy("hit", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest")).select("rarest.token", "hit", "regex")


def verdicts(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``(key, host, path, tier, pattern, verdict)``, one row per row of ``pages``.

    ``tier`` and ``pattern`` are those of the rule that decides, null where ``default`` does.  A null URL and
    one without ``://`` have an empty host and path, which only rules of ``*`` fit.  Repeated rows are judged
    each; of rules that fit, the smaller tier goes first, then the longer pattern, then the smaller one.
    An empty table gives no rows; other columns are left behind.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    alike = pages.groupBy(F.col(key).alias("_key"), F.col(url).alias("_url")).agg(F.count("*").alias("_n"))
    parts = alike.withColumn("host", host("_url")).withColumn("path", path("_url"))
    urls = parts.withColumn("tokens", _tokens(F.concat("host", "path")))
    if not rules:
        hit = urls.select("_key", "_n", "host", "path", F.lit(None).cast("struct<tier:int,pattern:string,verdict:string>").alias("hit"))
    else:
        at_hand = urls.select("_key", "_url", "_n", "host", "path", F.explode("tokens").alias("token"))
        fetched = at_hand.join(F.broadcast(_index(urls, rules)), "token", "left")
        fits = F.when(F.expr("concat(host, path) rlike regex"), F.col("hit"))
        hit = fetched.groupBy("_key", "_url", "_n", "host", "path").agg(F.min(fits).alias("hit"))
    return hit.select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("hit.tier").alias("tier"),
        F.col("hit.pattern").alias("pattern"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_copy"),
    ).drop("_copy")
