"""URL filter by Empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted by host. A host's rate of good pages is
shrunk towards its registered domain's, a domain's towards its suffix's and a suffix's
towards the overall rate: at each level the parent's posterior mean is the mean of a beta
prior whose concentration is fitted to all groups of the level by the moments of the
beta-binomial. A group's own outcomes are left out of its prior, so they count once. A page is blocked if the upper posterior bound of its host's rate is under
the least rate wanted, so only well-attested bad hosts go.

Everything is a DataFrame expression. Only one row of moments per level reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import ascii_lower, checkpointed

#: Suffixes of two labels under which names are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "org.uk")
LEVELS = ("suffix", "domain", "host")


@dataclass(frozen=True)
class Rule:
    """A fixed decision: host and its subdomains, paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next / ? or #, A-Z in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _concentration(groups: DataFrame, most: float = 1e6) -> float:
    """Beta concentration from the over-dispersion of n, good against the mean prior."""
    spread = F.col("prior") * (1 - F.col("prior"))
    excess = (F.col("good") - F.col("n") * F.col("prior")) ** 2 / spread
    row = (
        groups.where((F.col("prior") > 0) & (F.col("prior") < 1))
        .agg(F.sum(excess).alias("x"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1.0)).alias("pairs"))
        .first()
    )
    if row["x"] is None or not row["pairs"]:
        return 1.0
    rho = min(max((row["x"] - row["n"]) / row["pairs"], 1 / (most + 1)), 0.5)
    return 1 / rho - 1


def reputations(outcomes: DataFrame, least: float = 0.5, z: float = 1.645) -> dict[str, DataFrame]:
    """For each level, its groups with posterior mean and bounds, from outcomes (host, good).

    good is boolean; rows without it are not labelled and do not count. Levels are host,
    domain and suffix, and "all" with one row for names that no level knows.
    """
    hosts = checkpointed(
        outcomes.where(F.col("good").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = total["good"] / total["n"] if total["n"] else 0.5
    found: dict[str, DataFrame] = {}
    parent: DataFrame | None = None
    for level, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keys = [level, above] if above else [level]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        if parent is None:
            groups = groups.withColumn("prior", F.lit(overall))
        else:
            rest = (F.col("good_mass") - F.col("good")) / (F.col("mass") - F.col("n"))
            groups = groups.join(parent.select(above, "good_mass", "mass"), above).withColumn("prior", rest)
        groups = checkpointed(groups)
        kappa = _concentration(groups)
        good, bad = F.col("good") + kappa * F.col("prior"), F.col("n") - F.col("good") + kappa * (1 - F.col("prior"))
        mean = good / (good + bad)
        mass = F.col("n") + kappa
        error = F.sqrt(mean * (1 - mean) / (good + bad + 1))
        parent = groups.select(
            level, "n", "good", mean.alias("mean"), (mean - z * error).alias("lower"), (mean + z * error).alias("upper"),
            good.alias("good_mass"), mass.alias("mass"),
        ).withColumn("blocked", F.col("upper") < least)
        found[level] = parent
    return found


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule] | None = None,
    least: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled) for each row of pages (page_id, url).

    outcomes (host, good) are the labelled pages. A fitting rule decides; else the
    reputation of the host, of the domain if no page of the host is labelled, of the suffix
    if none of the domain is; names without any label are allowed. Urls that are null or
    hold no :// have an empty host and path. Repeated rows are judged alike and all
    returned; other columns of pages are not read.
    """
    rules = rules or []
    known = reputations(outcomes, least, z)
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    names = rows.select("host").distinct()
    names = names.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    for level in reversed(LEVELS):
        own = known[level].select(level, F.col("blocked").alias(f"{level}_blocked"), F.col("n").alias(f"{level}_n"))
        names = names.join(own, level, "left")
    names = names.select(
        "host",
        F.coalesce(*[F.col(f"{level}_blocked") for level in reversed(LEVELS)], F.lit(False)).alias("blocked"),
        F.coalesce("host_n", F.lit(0)).cast("long").alias("n_labelled"),
    )
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(decided, F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.join(names, "host").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n_labelled"
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of pages whose url's path ends in the number of a labelled document.

    Good pages have quality 1 and are not toxic; a document with several labels is good if
    all of them are.
    """
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(good).alias("good"))
    number = F.regexp_extract(url_path(F.col("url")), r"/([0-9]{1,18})[^/]*/?$", 1)
    rows = pages.select(url_host(F.col("url")).alias("host"), number.alias("number"))
    rows = rows.where(F.col("number") != "").select("host", F.col("number").cast("bigint").alias("doc_id"))
    return rows.join(marks, "doc_id").select("host", "good")
