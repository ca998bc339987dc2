"""Operator 4: URL filter by host reputation, shrunk by empirical Bayes, in DataFrame expressions only.

Labelled outcomes of pages are summed for hosts, registered domains and suffixes. Each level's rate is drawn towards the one
above by a beta prior, whose strength is estimated for the level from how much rates differ beyond chance (moments of the
beta-binomial). A host is blocked if the lower bound of its posterior bad rate is above a limit. Explicit rules go first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Standard deviations below the posterior mean; limit of the bound.
BOUND, LIMIT = 1.645, 0.5
#: Least and greatest correlation of outcomes in a group, so that priors stay proper.
CORRELATION = (1e-4, 0.9)


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased, and the rest up to ``? #`` or the end; empty where there is none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null. Rules of the same length are tried by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame) -> float:
    """Weight of the prior for groups (n, k) around their parent's mean m."""
    g = groups.where("n > 0")
    noise = F.col("m") * (1 - F.col("m"))
    r = g.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), F.lit(2))).alias("seen"), F.sum(noise).alias("chance"), F.sum(noise * (F.col("n") - 1)).alias("more")).first()
    rho = (r["seen"] - r["chance"]) / r["more"] if r["more"] else CORRELATION[0]
    rho = min(max(rho, CORRELATION[0]), CORRELATION[1])
    return 1 / rho - 1


def _shrunk(n: str, k: str, m: str, s: float) -> Column:
    return (F.col(k) + s * F.col(m)) / (F.col(n) + s)


def reputations(hosts: DataFrame) -> DataFrame:
    """(host, bad_rate, bound) from (host, n labelled pages, k bad ones). Hosts without labelled pages get what their domain or suffix says."""
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = ((whole["k"] or 0) + 1) / ((whole["n"] or 0) + 2)
    domain = F.when(F.regexp_extract("host", r"[^.]+\.[^.]+$", 0) != "", F.regexp_extract("host", r"[^.]+\.[^.]+$", 0)).otherwise(F.col("host"))
    hosts = hosts.withColumn("domain", domain)
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk")).withColumn("suffix", F.regexp_extract("domain", r"[^.]*$", 0))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("n"), F.sum("dk").alias("k")).withColumn("m", F.lit(root))
    s0 = _strength(suffixes)
    domains = domains.join(suffixes.select("suffix", _shrunk("n", "k", "m", s0).alias("sm")), "suffix")
    s1 = _strength(domains.select(F.col("dn").alias("n"), F.col("dk").alias("k"), F.col("sm").alias("m")))
    hosts = hosts.join(domains.select("domain", _shrunk("dn", "dk", "sm", s1).alias("m")), "domain")
    s2 = _strength(hosts)
    a, b = F.col("k") + s2 * F.col("m"), F.col("n") - F.col("k") + s2 * (1 - F.col("m"))
    mean = a / (a + b)
    return hosts.select("host", mean.alias("bad_rate"), (mean - BOUND * F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1)))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound of every row of ``pages`` (page_id, url); ``outcomes`` has page_id and bad (0/1).

    Null urls and those without ``://`` have an empty host, which is a host like others. Outcomes that are null or of unknown pages don't count; of several for
    one page the worst does. Without outcomes no host is blocked but by rules.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts = staged(parsed.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")), "op4-hosts")
    judged = parsed.join(reputations(hosts), "host", "left").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "bad_rate", "bound")
