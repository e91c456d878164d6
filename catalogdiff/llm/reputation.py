"""URL filter by the reputation of hosts, estimated by empirical Bayes.

Labelled pages are good or bad. A host's share of good pages has a beta prior whose
mean is its registered domain's estimate, the domain's prior has that of its suffix, and
the suffix's that of all pages. How much a prior weighs is estimated at each level from the
spread of the groups below it (moments of the beta-binomial). A host is blocked if
even the upper bound of its posterior is below the accepted share; with few labels the bound
is wide, and the host is judged by what is known about its domain.

Only DataFrame operations: sums per group, joins, and four numbers a level on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogdiff.llm.common import written

# Public suffixes of two labels that are met most; all others are one label.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br",
    "co.in", "co.kr", "co.nz", "co.za", "com.ar", "com.cn", "com.mx", "com.tr", "com.tw",
)

LEVELS = ("suffix", "domain", "host")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, rest, 1), upper, lower), F.regexp_extract(url, rest, 2)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix; a number address is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    address = name.rlike(r"^[0-9.]+$|^\[")
    suffix = F.when(address, name).when(long, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, suffix


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of ``rules``, pairs of allow or block and host with path, that fits, as a struct.

    A rule fits its host and all hosts below it, where the path starts with the rule's.
    """
    found = []
    for order, (verdict, text) in enumerate(rules):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rank = F.struct(F.lit(len(text)).alias("length"), F.lit(-order).alias("order"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        found.append(F.when(fits, rank))
    return F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def _prior(groups: DataFrame, mean: str) -> float:
    """How many pages a level's prior weighs, from the spread of its groups about their ``mean``.

    Moments: the summed squared distance of a group's share from its mean has
    expectation sum of m(1-m)/n + rho m(1-m)(1-1/n), and the weight is 1/rho - 1.
    """
    base = F.col(mean) * (1 - F.col(mean))
    share = F.col("good") / F.col("pages")
    seen, least, slope, count = groups.where("pages > 0").agg(
        F.sum((share - F.col(mean)) ** 2), F.sum(base / F.col("pages")), F.sum(base * (1 - 1 / F.col("pages"))), F.count("*")
    ).first()
    if not count or not slope:
        return 10.0
    rho = min(0.9, max(0.001, (seen - least) / slope))
    # Rounded, so that the order in which a sum was made does not show.
    return round(1 / rho - 1, 6)


def reputations(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host, domain, suffix, pages, good, alpha, beta`` of all ``hosts`` from ``outcomes (host, good)``.

    A level's estimate is (good + weight x mean above) / (pages + weight).
    """
    counted = outcomes.groupBy("host").agg(F.count("good").alias("pages"), F.sum("good").alias("good"))
    domain, suffix = domain_and_suffix(F.col("host"))
    known = hosts.select("host").distinct().join(counted, "host", "left")
    known = known.select("host", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("good", F.lit(0)).alias("good"))
    known = written(known.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    total = known.agg(F.sum("pages"), F.sum("good")).first()
    # One good and one bad page are added, so that the mean is never 0 or 1.
    above = (int(total[1] or 0) + 1) / (int(total[0] or 0) + 2)
    estimates = known.withColumn("mean", F.lit(above))
    for at, level in enumerate(LEVELS):
        keys = LEVELS[: at + 1]
        groups = estimates.groupBy(*keys).agg(
            F.sum("pages").alias("pages"), F.sum("good").alias("good"), F.first("mean").alias("mean")
        )
        groups = written(groups, f"reputation-{level}")
        weight = F.lit(_prior(groups, "mean"))
        alpha = F.col("good") + weight * F.col("mean")
        beta = F.col("pages") - F.col("good") + weight * (1 - F.col("mean"))
        groups = groups.withColumn("alpha", alpha).withColumn("beta", beta)
        if level == LEVELS[-1]:
            return groups.drop("mean")
        means = groups.select(*keys, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean"))
        estimates = known.join(means, list(keys))


def upper_bound(alpha: Column, beta: Column, z: float) -> Column:
    """Posterior mean and ``z`` standard deviations, to 9 digits."""
    total = alpha + beta
    return F.round(alpha / total + F.lit(z) * F.sqrt(alpha * beta / (total * total * (total + 1))), 9)


def judged(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], accepted: float = 0.5, z: float = 1.645
) -> DataFrame:
    """``page_id, host, path, rule, verdict, bound`` of every row of ``pages (page_id, url)``.

    ``labels (page_id, good)`` are outcomes, 1 or 0; NULL is none, and of several for a page the lowest counts.
    A page is blocked by the method if ``bound``, the upper posterior bound of its host's share of
    good pages, is below ``accepted``. A rule that fits goes before the method. Urls that are NULL or
    have no ``://`` have an empty host and path and are judged together. Repeated rows stay, each a page of its own. Urls of any length are
    read whole, other columns are not read, whatever their names, and an empty table of pages gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = written(rows, "urls")
    good = labels.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    known = reputations(rows.join(good, "page_id").select("host", "good"), rows)
    bounds = known.select(F.col("host").alias("of"), upper_bound(F.col("alpha"), F.col("beta"), z).alias("bound"))
    rows = rows.join(bounds, F.col("host") == F.col("of")).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bound") < accepted, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "bound"
    )
