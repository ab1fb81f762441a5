"""URL filter: allow and block rules, then empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host. A host's rate of good pages is shrunk towards the rate of its registered
domain, that one's towards its public suffix, and that one's towards the rate of all labelled pages. How far, is fitted to
the data: at each level the concentration of a beta-binomial is estimated by the method of moments over the units of the
level. A host is blocked when the upper bound of its posterior rate lies under a threshold, so a host without labels is
blocked only on the evidence of its domain or suffix.

Everything is DataFrame expressions. Pages meet the table of distinct hosts in one equi-join; a host with a third of all
pages is pre-aggregated by Spark's partial aggregation and split by its skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helix.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels; all others have one.
SECOND_LEVEL = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What follows the first "://", up to "/", "?", "#" or the end, with A-Z in lower case; empty for null or without "://"."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def with_suffix_and_domain(hosts: DataFrame, second_level: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """host -> host, suffix, domain. The suffix is the last label (two for those in second_level), the domain one label more; a host
    with no label more is its own domain. A port is no part of either."""
    labels = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    two = F.array_join(F.slice(F.col("_l"), F.greatest(F.size("_l") - 1, F.lit(1)), 2), ".")
    n = F.when(two.isin(*second_level), 2).otherwise(1)
    tail = lambda k: F.array_join(F.slice(F.col("_l"), F.greatest(F.size("_l") - k + 1, F.lit(1)), F.lit(3)), ".")
    return hosts.withColumn("_l", labels).withColumn("_n", n).withColumn("suffix", tail(F.col("_n"))).withColumn("domain", tail(F.col("_n") + 1)).drop("_l", "_n")


def _shrunk(units: DataFrame, floor: float, ceiling: float) -> DataFrame:
    """units (n, k, up: the rate of the level above) -> the same with kappa, the level's concentration.

    With rho the correlation within a unit, the squares of k - n * up sum to n * up * (1 - up) * (1 + (n - 1) * rho) in expectation;
    kappa = 1 / rho - 1, held between floor and ceiling (the ceiling where units differ no more than by chance)."""
    pq = F.col("up") * (1 - F.col("up"))
    fit = units.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("up"), F.lit(2.0))).alias("_s"), F.sum(F.col("n") * pq).alias("_b"), F.sum(F.col("n") * (F.col("n") - 1) * pq).alias("_c")
    )
    rho = (F.col("_s") - F.col("_b")) / F.col("_c")
    kappa = F.when(F.coalesce(F.col("_c"), F.lit(0.0)) <= 0, ceiling).when(rho <= 0, ceiling).otherwise(F.least(F.greatest(1 / rho - 1, F.lit(floor)), F.lit(ceiling)))
    return units.join(fit.select(kappa.alias("kappa")), how="cross")  # one row


def host_reputation(labelled: DataFrame, hosts: DataFrame, *, z: float = 1.645, floor: float = 1.0, ceiling: float = 1000.0, second_level: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """labelled (host, good: boolean; a null one doesn't count) and hosts (distinct host) -> per host its counts n and k, the posterior's mean and
    its lower and upper bound, z standard deviations away. Without any label every mean is 0.5 and the bounds are those of the prior."""
    counts = labelled.filter("good IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.count_if("good").alias("k"))
    known = with_suffix_and_domain(hosts, second_level).join(counts, "host", "left").fillna(0, ["n", "k"])
    known = written(known, "hosts")  # each level reads it
    mean = ((F.col("k") + F.col("kappa") * F.col("up")) / (F.col("n") + F.col("kappa"))).alias("rate")
    total = known.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("up"))
    suffixes = _shrunk(known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(total, how="cross"), floor, ceiling)
    above = suffixes.select("suffix", mean.alias("up"))
    domains = _shrunk(known.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(above, "suffix"), floor, ceiling)
    above = domains.select("domain", "suffix", mean.alias("up"))
    fitted = _shrunk(known.join(above, ["domain", "suffix"]), floor, ceiling)
    a, b = F.col("k") + F.col("kappa") * F.col("up"), F.col("n") - F.col("k") + F.col("kappa") * (1 - F.col("up"))
    half = z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return fitted.select("host", "suffix", "domain", "n", "k", (a / (a + b)).alias("rate"), (a / (a + b) - half).alias("lower"), (a / (a + b) + half).alias("upper"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host -> its rules, the longest first: those of the host itself and of the domains it lies under. rules: verdict, rule_host, rule_path.
    Each host has as many suffixes as labels, and meets the rules in an equi-join."""
    under = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.lit(10_000)), "."))).alias("rule_host"))
    text = F.concat("rule_host", "rule_path")
    rule = F.struct((-F.length(text)).alias("rank"), text.alias("rule"), F.col("rule_path").alias("path"), F.col("verdict"))
    return under.join(rules, "rule_host").groupBy("host").agg(F.array_sort(F.collect_set(rule)).alias("rules"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], *, threshold: float = 0.5, page_id: str = "page_id", url: str = "url", **options) -> DataFrame:
    """pages (page_id, url; others are left alone) -> page_id, host, path, rule, verdict, rate, upper: a row for each row.

    outcomes: page_id, good (boolean); several rows for a page count as good only if all are good, and null ids or outcomes as none. Repeated
    page rows each count. rules: ("allow" or "block", "host/path"); a rule fits its host and all subdomains if the path starts with the
    rule's; the longest wins, then block. Else a host is blocked if its upper bound lies under the threshold (see host_reputation).
    Null urls and those without "://" have an empty host and path, and share the reputation of the empty host.
    """
    spark = pages.sparkSession
    located = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    hosts = located.select("host").distinct()
    good = outcomes.groupBy("page_id").agg(F.min("good").alias("good")).filter("page_id IS NOT NULL")
    reputation = host_reputation(located.join(good, "page_id").select("host", "good"), hosts, **options)
    split = [(verdict, *rule.partition("/")[::2]) for verdict, rule in rules]
    table = spark.createDataFrame([(v, h, f"/{p}") for v, h, p in split], "verdict string, rule_host string, rule_path string")
    known = reputation.join(rules_by_host(hosts, table), "host", "left").select("host", "rate", "upper", "rules")
    best = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))[0]
    return (
        located.join(known, "host", "left")
        .withColumn("_r", F.when(F.size(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))) > 0, best))
        .select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), F.when(F.col("upper") < threshold, "block").otherwise("allow")).alias("verdict"), "rate", "upper")
    )
