"""URL filters: fixed rules first, and an empirical-Bayes reputation for what they leave open.

Labelled page outcomes are counted per host.  Each host's rate of bad pages is shrunk to its
registered domain's, that to its public suffix's, that to the overall rate, by beta-binomial priors
whose strengths are estimated from the spread between siblings (method of moments).  A page is
blocked when the lower credible bound of its host's rate passes a threshold.  Built-in Spark
functions only; counts are summed map-side, so a hot host meets its reputation as one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
DOCUMENT = r"^/[^/]*/([0-9]+)(?:/|\.html)?$"  # of a path
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``rule`` is a host and a path prefix, like ``example.net/en/``."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


RULES = (UrlRule("block", "net/"), UrlRule("allow", "example.net/en/"), UrlRule("block", "example.com/de/"),
         UrlRule("allow", "org/fr/"))
# Suffixes of more than one label under which anyone may register; other hosts have their last label.
SUFFIXES = ("example.com", "example.net", "example.org")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def document_of(url: Column) -> Column:
    """The number of the document in the url's path, like 7817 of ``/en/7817.html``; null where there is none."""
    return F.regexp_extract(path_of(url), DOCUMENT, 1).try_cast("long")


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), len(r.host), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    out = F.substring_index(host, ".", -1)
    for s in sorted(suffixes, key=len):
        out = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(out)
    return out


def registered_domain(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; the host itself where it is a bare suffix."""
    rest = F.substring_index(F.expr("left(host, greatest(length(host) - length(suffix) - 1, 0))"), ".", -1)
    return F.when(rest == "", host).otherwise(F.concat(rest, F.lit("."), suffix))


PRIOR = (1.0, 9.0)  # pseudo-counts bad and good of the overall rate


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the prior strength of a level from ``groups`` (parent, n, bad, prior mean m).

    rho, the correlation of outcomes inside a group, by moments of the scaled squared distances of
    the groups' rates to their parents'; strength = 1 / rho - 1, kept between 1 and 10000."""
    totals = groups.groupBy("parent").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("g"),
        F.sum(F.expr("CASE WHEN n > 0 THEN n * power(bad / n - m, 2) / (m * (1 - m)) ELSE 0D END")).alias("s"))
    return totals.agg(F.expr("sum(s) - sum(g - 1)").alias("x"),
                      F.expr("sum(CASE WHEN n > 0 THEN n - nn / n ELSE 0D END) - sum(g - 1)").alias("y")).selectExpr(
        "coalesce(least(greatest(CASE WHEN x > 0 AND y > 0 THEN y / x - 1 ELSE 10000D END, 1D), 10000D), 10000D) AS k")


def _shrunk(groups: DataFrame, parents: DataFrame) -> DataFrame:
    """``groups`` (name, parent, n, bad) with a, b: the beta posterior under the parent's mean."""
    with_mean = write_through(groups.join(
        parents.select(F.col("name").alias("parent"), F.expr("a / (a + b)").alias("m")), "parent"), "host-level")
    return with_mean.join(F.broadcast(_strength(with_mean))).selectExpr(  # one row by construction
        "name", "parent", "n", "bad", "k * m + bad AS a", "k * (1 - m) + n - bad AS b")


def reputations(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """Per host of ``outcomes`` (host, n labelled pages, bad ones; one row per host): name, a, b of
    the beta posterior of its rate of bad pages.  Hosts without a labelled page have their domain's."""
    hosts = outcomes.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn(
        "domain", registered_domain(F.col("host"), F.col("suffix")))
    hosts = hosts.selectExpr("host AS name", "domain AS parent", "suffix", "CAST(n AS DOUBLE) AS n", "CAST(bad AS DOUBLE) AS bad")
    domains = hosts.groupBy(F.col("parent").alias("name"), F.col("suffix").alias("parent")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy(F.col("parent").alias("name")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("parent", F.lit(""))
    root = tops.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).selectExpr(
        "'' AS name", f"{PRIOR[0]}D + coalesce(bad, 0D) AS a", f"{PRIOR[1]}D + coalesce(n - bad, 0D) AS b")
    return _shrunk(hosts.drop("suffix"), _shrunk(domains, _shrunk(tops, root)))


def judge_pages(pages: DataFrame, labels: DataFrame, rules=RULES, suffixes=SUFFIXES, threshold: float = 0.5,
                z: float = 1.645, document: Column | None = None, lift: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, lower_bound for every row of ``pages``.

    ``labels`` (doc_id, quality, toxic) holds outcomes of documents; ``document`` says which one a page
    is (see ``document_of``), by default the one with the page's id.  With ``lift`` a page is blocked
    when the lower bound passes ``lift`` times the overall rate, else when it passes ``threshold``.  Bad is quality 0 or toxic 1;
    labels with nulls, or more than one for a page, count as their worst.  The lower bound is the
    posterior mean less ``z`` standard deviations.  A null url or one without ``://`` has an empty
    host and path and shares the reputation of such pages.  Repeated rows are judged alike.  Extra
    columns are dropped, so they never clash.  An empty table gives no rows.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       (F.col("page_id") if document is None else document).alias("document"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "ruled": ruled})
    outcome = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(
        F.col("doc_id").alias("document")).agg(F.max(F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END")).alias("bad"))
    outcomes = write_through(own.select("document", "host").join(outcome, "document", "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "host-outcomes")
    rated = reputations(outcomes, suffixes).selectExpr(
        "name AS host", "a / (a + b) AS bad_rate",
        f"a / (a + b) - {z}D * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_bound")
    limit = F.lit(threshold)
    if lift is not None:  # one row by construction
        own = own.join(F.broadcast(outcomes.agg(F.expr(
            f"({PRIOR[0]}D + coalesce(sum(bad), 0)) / ({sum(PRIOR)}D + coalesce(sum(n), 0)) * {float(lift)}D").alias("limit"))))
        limit = F.col("limit")
    return own.join(rated, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("lower_bound") > limit, "block").otherwise("allow")).alias("verdict"),
        F.round("bad_rate", 6).alias("bad_rate"), F.round("lower_bound", 6).alias("lower_bound"))
