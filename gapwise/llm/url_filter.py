"""URL filter: rules first, then host reputation by empirical Bayes, all in DataFrame operations.

Labelled outcomes of pages are binomial counts per host.  A beta prior shrinks
each host toward its registered domain, the domain toward its suffix, and the
suffix toward the global rate; the strength of each prior is a moment estimate
from the spread of the level below.  A page is allowed where the lower bound of
its host's posterior reaches the required rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict): fits the host and its subdomains where the path begins with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LEAST_RATE = 0.5  #: required of the lower bound
DEVIATIONS = 1.645  #: posterior standard deviations below the mean: a one-sided 95 % bound
MOST_STRENGTH = 1000.0


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and where ``://`` is missing."""
    found = F.coalesce(url.contains("://"), F.lit(False))
    before = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(before) + 4, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    blank = F.lit("")
    return F.when(found, ascii_lower(host)).otherwise(blank), F.when(found, path).otherwise(blank)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path joined) and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels."""
    return F.substring_index(host, ".", -2)


def strength(groups: DataFrame) -> DataFrame:
    """One row, ``strength``: the prior weight that the spread of (n, good) implies.

    Moments of binary outcomes between and within groups, from 1 to
    MOST_STRENGTH, the latter where the groups show no spread.
    """
    n, k = F.col("n").cast("double"), F.col("good").cast("double")
    s = groups.agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"),
                   F.sum(k * k / n).alias("kk"))
    s = s.withColumn("between", F.greatest(F.lit(0.0), F.col("kk") - F.col("k") * F.col("k") / F.col("n"))
                     / F.nullif(F.col("g") - 1, F.lit(0)))
    s = s.withColumn("within", F.greatest(F.lit(0.0), F.col("k") - F.col("kk")) / F.nullif(F.col("n") - F.col("g"), F.lit(0.0)))
    s = s.withColumn("typical", (F.col("n") - F.col("nn") / F.col("n")) / F.nullif(F.col("g") - 1, F.lit(0)))
    rho = (F.col("between") - F.col("within")) / F.nullif(
        F.col("between") + (F.col("typical") - 1) * F.col("within"), F.lit(0.0))
    found = F.when(rho > 0, F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(1.0), (1 - rho) / rho)))
    return s.select(F.coalesce(found, F.lit(MOST_STRENGTH)).alias("strength"))


def reputations(outcomes: DataFrame) -> tuple[dict[str, DataFrame], float, float]:
    """Posterior rates of (host, good): tables for host, domain and suffix, the global rate, the host strength."""
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    all_ = suffixes.agg(F.sum("n"), F.sum("good")).first()
    rate = ((all_[1] or 0) + 1) / ((all_[0] or 0) + 2)
    weights = [level.first()[0] for level in (strength(suffixes), strength(domains), strength(hosts))]

    def shrunk(parent: Column, weight: float) -> Column:
        return (F.col("good") + F.lit(weight) * parent) / (F.col("n") + F.lit(weight))
    suffix = suffixes.select("suffix", shrunk(F.lit(rate), weights[0]).alias("suffix_rate"))
    domain = domains.join(suffix, "suffix").select("domain", shrunk(F.col("suffix_rate"), weights[1]).alias("domain_rate"))
    host = hosts.join(domain, "domain").select("host", "n", shrunk(F.col("domain_rate"), weights[2]).alias("host_rate"))
    return {"host": host, "domain": domain, "suffix": suffix}, rate, weights[2]


def filter_urls(df: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url",
                rules: Sequence[tuple[str, str, str]] = RULES, least_rate: float = LEAST_RATE,
                deviations: float = DEVIATIONS) -> DataFrame:
    """(id, host, path, rule, verdict, rate, bound) of every row.

    ``outcomes`` has the page's id and a 0/1 column ``good`` for labelled pages.
    ``verdict`` is the longest fitting rule's; without one, allow where the
    posterior mean less ``deviations`` standard deviations is at least
    ``least_rate``, else block.  A host without labels has its domain's rate,
    then its suffix's, then the global one.  Urls that are null or lack ``://``
    have empty host and path and are judged as an unlabelled host.  Null labels
    and ids teach nothing; an id labelled twice counts once, as its worse label;
    repeated rows are judged alike and each counts.
    """
    host, path = url_parts(F.col("url"))
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).select(
        "id", host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col(f"`{id_col}`").alias("id"), F.col("good").cast("long").alias("good")).where(
        "id is not null and good in (0, 1)").groupBy("id").agg(F.min("good").alias("good"))
    tables, rate, weight = reputations(pages.where("host != ''").join(known, "id").select("host", "good"))
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    judged = (pages.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
              .join(tables["host"], "host", "left").join(tables["domain"], "domain", "left")
              .join(tables["suffix"], "suffix", "left"))
    mean = F.coalesce("host_rate", "domain_rate", "suffix_rate", F.lit(rate))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.coalesce("n", F.lit(0)) + F.lit(weight) + 1))
    judged = judged.withColumn("rate", mean).withColumn("bound", F.col("rate") - F.lit(deviations) * deviation)
    verdict = F.coalesce(says, F.when(F.col("bound") >= least_rate, "allow").otherwise("block"))
    return judged.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "rate", "bound")
