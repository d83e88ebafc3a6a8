r"""URL filters: host-suffix and path-prefix expressions joined to rules by hash.

A URL's host is what stands after the first ``://`` up to ``/``, ``?``, ``#``
or the end, A-Z lower-cased; its path goes on up to ``?``, ``#`` or the end.
A rule (host, path, action) fits its host and all subdomains where the path
starts with the rule's path; the longest rule wins, on equal length the one
with the longer host, then ``block``.

Each distinct (host, path) is expanded into its host suffixes (of as many labels as
some rule has), which meet the rules' hosts, and from there into the path prefixes of
the lengths that the host has rules for, which meet the rules.  Both meet by an equi-join on the
first 32 bits of a SHA-256 and are confirmed by the full digest.  Hosts with a third of all pages
are collapsed by the distinct step before the shuffle.

Null URLs and URLs without ``://`` have an empty host and path, which no rule
fits.  Repeated rows each get the result of their URL; an empty table gives
an empty result; further columns of ``pages`` stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Columns that ``judge`` adds.
ADDED = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    # (?s): any line end in a URL is an ordinary character
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the rule that won) and ``verdict``.

    ``rules`` has text columns ``host``, ``path`` and ``action`` (allow or
    block); rows with a null in any of them are no rules.  ``default`` is the
    verdict without a rule.  Columns of ``pages`` with the names of added
    columns are replaced.
    """
    rules = rules.dropna(subset=["host", "path", "action"])
    rules = rules.select(
        F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("action").alias("action")
    ).distinct()
    # The path lengths that each host has rules for, so that only those prefixes are made.
    hosts = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    hosts = hosts.select(F.col("rule_host").alias("suffix"), "lengths", F.sha2("rule_host", 256).alias("host_digest"))
    rules = rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0]  # labels, one number
    pages = pages.drop(*ADDED).withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if most is None:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    expanded = keys.select("host", "path", F.explode(suffixes).alias("part")).withColumn("full", F.sha2("part", 256))
    at_host = expanded.join(hosts, _short("full") == _short("host_digest")).where(F.col("full") == F.col("host_digest"))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    prefixes = at_host.select("host", "path", "suffix", F.explode(fitting).alias("n"))
    prefixes = prefixes.withColumn("full", _digest(F.col("suffix"), F.expr("substring(path, 1, n)")))
    met = prefixes.join(rules, _short("full") == _short("digest")).where(F.col("full") == F.col("digest"))
    won = met.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("chars"),
                F.length("rule_host").alias("host_chars"),
                (F.col("action") == "block").alias("blocks"),
                F.concat("rule_host", "rule_path").alias("rule"),
                "action",
            )
        ).alias("best")
    )
    host, path, rule, action = fresh(pages, "won_host", "won_path", "won_rule", "won_action")
    decided = won.select(F.col("host").alias(host), F.col("path").alias(path), F.col("best.rule").alias(rule), F.col("best.action").alias(action))
    joined = pages.join(decided, (F.col("host") == F.col(host)) & (F.col("path") == F.col(path)), "left")
    joined = joined.withColumns({"rule": F.col(rule), "verdict": F.coalesce(F.col(action), F.lit(default))})
    return joined.drop(host, path, rule, action)


def _short(digest: str) -> Column:
    """The prefix of a digest that joins are on."""
    return F.substring(digest, 1, 8)
