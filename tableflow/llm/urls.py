"""Host reputation by empirical Bayes, under fixed host and path rules.

Labelled outcomes of pages are counted per host. Registered domains and public
suffixes sum their hosts. Going down from all pages to suffix, domain and host,
the rate of bad pages of each level is a beta-binomial whose prior mean is the
parent's posterior mean, and whose prior strength is fitted to the spread of
the rates at that level by the method of moments. A host is blocked when the
lower bound of its posterior lies above a limit; a host without any label has
its parent's mean and the prior's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import cut

# The rules of the job (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARED = ["ac", "co", "com", "edu", "gov", "net", "org"]  # second labels that belong to a country's suffix


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where a country keeps ``co``, ``com`` and the like apart."""
    labels = F.split(host, r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    both = (F.char_length(last) == 2) & second.isin(SHARED)
    return F.when(both, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one more label; the host itself if it has no more."""
    labels, last = F.split(host, r"\."), F.size(F.split(suffix, r"\."))
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - last), last + 1), ".")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else NULL."""
    name = verdict = None
    for kind, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=True):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        name = F.when(fits, own + start) if name is None else name.when(fits, own + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def _posterior(groups: DataFrame) -> DataFrame:
    """Beta parameters ``a`` and ``b`` of every group (n, bad, prior), under a prior strength fitted to all of them."""
    n, bad, p = F.col("n"), F.col("bad"), F.col("prior")
    spread, within, between = F.sum((bad - n * p) * (bad - n * p) / n), F.sum(p * (1 - p)), F.sum((n - 1) * p * (1 - p))
    rho = F.when(between > 0, F.least(F.greatest((spread - within) / between, F.lit(0.001)), F.lit(0.999)))
    strength = groups.where("n > 0").agg(F.coalesce((1 - rho) / rho, F.lit(1.0)).alias("s")).first().s
    return groups.withColumns({"a": bad + strength * p, "b": n - bad + strength * (1 - p)})


def reputation(hosts: DataFrame) -> DataFrame:
    """From (host, n, bad) to (host, n, bad, mean, low): posterior mean and lower bound of the rate of bad pages.

    ``n`` counts labelled pages and may be 0.
    """
    suffix = suffix_of(F.col("host"))
    hosts = cut(hosts.select("host", "n", "bad", suffix.alias("suffix"), domain_of(F.col("host"), suffix).alias("domain")), "url-hosts")
    sums, mean = [F.sum("n").alias("n"), F.sum("bad").alias("bad")], (F.col("a") / (F.col("a") + F.col("b"))).alias("prior")
    all_pages = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    top = (all_pages.bad + 0.5) / (all_pages.n + 1.0)
    suffixes = _posterior(hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(top)))
    domains = _posterior(hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", mean), "suffix"))
    own = _posterior(hosts.join(domains.select("domain", mean), "domain"))
    a, b = F.col("a"), F.col("b")
    width = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return own.select("host", "n", "bad", (a / (a + b)).alias("mean"), (a / (a + b) - 1.645 * width).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, low.

    ``outcomes``: page_id and ``bad`` (0 or 1) of the labelled pages; a NULL
    ``bad`` is no label, and of several labels of a page the worst counts.
    ``verdict`` is the rule's; else ``block`` where the lower posterior bound
    of the host's rate of bad pages is above ``limit``, and ``allow``
    otherwise. NULL urls and urls without ``://`` have an empty host, which is
    a host like any other. Repeated rows stay; further columns play no part.
    """
    parsed = pages.select(
        pages[page_id].cast("long").alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path")
    )
    labels = outcomes.where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    counted = parsed.select("page_id", "host").join(labels, "page_id", "left")
    hosts = counted.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0).cast("long")).alias("bad"))
    known = cut(reputation(hosts).select("host", "low"), "url-reputation")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("low") > limit, "block").otherwise("allow")
    return parsed.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.round("low", 6).alias("low")
    )
