"""URL filters by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes are counted for each site, a host without user and port. The counts climb from site to registered
domain to suffix to all sites. At each level a beta-binomial prior is fitted by moments to the children's rates, and a child's posterior mean
is its counts shrunk into the posterior mean of its parent. A site is blocked if the lower bound of its posterior bad
rate is at least a threshold. Rules of (host, path) come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberstack.llm.scratch import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels under which countries register names, as in co.uk.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, else null. A rule fits its host and all subdomains if the path starts with its path."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def site_of(host: Column) -> Column:
    """The name that has the reputation: ``host`` without a user, a port and dots at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")


def is_address(site: Column) -> Column:
    """Whether a site is an address of numbers, or one in brackets, and so has no labels."""
    return site.rlike(r"^[0-9]+(\.[0-9]+){3}\z") | site.startswith("[")


def _has_two_label_suffix(site: Column, two_label_suffixes: Sequence[str]) -> Column:
    ruled = site.rlike(rf"(^|\.)({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}\z")
    return ruled | F.substring_index(site, ".", -2).isin(*two_label_suffixes) if two_label_suffixes else ruled


def registered_domain(site: Column, two_label_suffixes: Sequence[str] = ()) -> Column:
    """The suffix and one label before it; an address whole."""
    last2, last3 = F.substring_index(site, ".", -2), F.substring_index(site, ".", -3)
    return F.when(is_address(site), site).when(_has_two_label_suffix(site, two_label_suffixes), last3).otherwise(last2)


def suffix_of(site: Column, two_label_suffixes: Sequence[str] = ()) -> Column:
    """The last label, or the last two where a label of SECOND_LABELS precedes a country's, or where they are one of
    ``two_label_suffixes``; of every address ``[address]``."""
    last1, last2 = F.substring_index(site, ".", -1), F.substring_index(site, ".", -2)
    return F.when(is_address(site), F.lit("[address]")).when(_has_two_label_suffix(site, two_label_suffixes), last2).otherwise(last1)


def _shrunk(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Counts of ``children(child, parent, n, bad)`` shrunk into ``parents(parent, mean)``.

    The concentration of the beta prior is fitted by moments over each parent's children: with rates r of weights n, the
    between-child variance v over the binomial part gives m(1-m)/v - 1, kept within 1 and 1000.
    """
    p = parents.select(F.col(parent).alias("p_key"), F.col("mean").alias("p_mean"))
    rows = children.join(p, F.col(parent) == F.col("p_key"))
    m, rate = F.col("p_mean"), F.col("bad") / F.greatest(F.col("n"), F.lit(1))
    fit = rows.groupBy("p_key").agg(
        F.max("p_mean").alias("m"), F.sum("n").alias("total"), F.count("*").alias("k"),
        F.sum(F.col("n") * (rate - m) * (rate - m)).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    spread = F.col("m") * (1 - F.col("m"))
    between = (F.col("ss") - F.col("k") * spread) / F.greatest(F.col("total") - F.col("nn") / F.greatest(F.col("total"), F.lit(1)), F.lit(1.0))
    strength = F.least(F.greatest(F.coalesce(spread / F.when(between > 0, between) - 1, F.lit(1000.0)), F.lit(1.0)), F.lit(1000.0))
    fit = fit.select(F.col("p_key").alias("f_key"), strength.alias("strength"))
    out = rows.join(fit, F.col("p_key") == F.col("f_key"))
    a, b = F.col("strength") * m + F.col("bad"), F.col("strength") * (1 - m) + F.col("n") - F.col("bad")
    return out.select(child, parent, "n", "bad", a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"))


def reputations(counts: DataFrame, two_label_suffixes: Sequence[str] = (), z: float = 1.645) -> DataFrame:
    """``counts(host, n, bad)``, one row for a site, to ``(host, n, bad, alpha, beta, mean, lower)``.

    ``lower`` is the one-sided lower bound of the posterior bad rate, from the normal approximation of the log odds:
    mean log(a/b), variance 1/a + 1/b. Each level is written once, as a row for a host, domain or suffix, and read by the next.
    """
    hosts = counts.withColumns({"domain": registered_domain(F.col("host"), two_label_suffixes), "suffix": suffix_of(F.col("host"), two_label_suffixes)}).withColumn("root", F.lit("all"))
    add = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = saved(hosts.groupBy("domain", "suffix", "root").agg(*add))
    suffixes = saved(domains.groupBy("suffix", "root").agg(*add))
    root = suffixes.groupBy("root").agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("mean"))
    suffixes = saved(_shrunk(suffixes, root, "suffix", "root"))
    domains = saved(_shrunk(domains.select("domain", "suffix", "n", "bad"), suffixes, "domain", "suffix"))
    hosts = _shrunk(hosts.select("host", "domain", "n", "bad"), domains, "host", "domain")
    odds = F.log(F.col("alpha") / F.col("beta")) - z * F.sqrt(1 / F.col("alpha") + 1 / F.col("beta"))
    return hosts.select("host", "n", "bad", "alpha", "beta", "mean", (1 / (1 + F.exp(-odds))).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, two_label_suffixes: Sequence[str] = ()) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_rate, lower)``, one row for each row of ``pages(page_id, url)``.

    ``outcomes(page_id, bad)`` holds labelled pages, ``bad`` 0 or 1; nulls in it count for nothing, repeated ones each
    count. A site without outcomes has its domain's prior. Null urls, or ones without ``://``, have an empty host and
    path: the empty host is a site like others. No page gives no row, no outcome the prior of 0.5; urls may be of any length. Verdict: the rule's, else ``block`` if ``lower >= threshold``, else
    ``allow``. Sites are counted before they are joined; Spark broadcasts the site table only if it is small, and
    splits skewed hosts otherwise. Other columns are ignored.
    """
    host, path = F.col("host"), F.col("path")
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("site", site_of(host))
    labelled = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("o_n"), F.sum("bad").alias("o_bad")).withColumnRenamed("page_id", "o_id")
    seen = judged.select("page_id", "site").join(labelled, F.col("page_id") == F.col("o_id"), "left")
    counts = seen.groupBy(F.col("site").alias("host")).agg(F.sum(F.coalesce("o_n", F.lit(0))).alias("n"), F.sum(F.coalesce("o_bad", F.lit(0))).alias("bad"))
    known = reputations(saved(counts), two_label_suffixes).select(F.col("host").alias("k_site"), F.col("mean").alias("bad_rate"), "lower")
    out = judged.join(known, F.col("site") == F.col("k_site"), "left").withColumn("rule", rule_of(host, path, rules))
    ruled = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for v, r in rules]) if rules else F.lit(None).cast("string")
    verdict = F.coalesce(ruled, F.when(F.col("lower") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_rate", "lower")
