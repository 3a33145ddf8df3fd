"""URL filters: allow and block rules first, then empirical-Bayes reputations of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

# Fixed values: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (between the first :// and the next / ? # or the end, A-Z lower-cased) and path (then up to ? or #).
    Both are empty for null and for text without ://."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({'coalesce(`' + url_col + '`, \"\")'}, instr(coalesce(`{url_col}`, ''), '://') + 3)")).otherwise("")
    pages = pages.withColumn("_rest", rest)
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path}).drop("_rest")


def match_rule(rules: Sequence[tuple[str, str, str]] = RULES) -> F.Column:
    """struct(rule, verdict) of the longest rule that fits host and path, else null. A rule fits its host and all
    subdomains if the path starts with the rule's. The list is a parameter of fixed size, so it is part of the plan."""
    fits = []
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        on = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits.append((on & F.startswith(F.col("path"), F.lit(path)), F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))))
    out = F.when(*fits[0])
    for condition, value in fits[1:]:
        out = out.when(condition, value)
    return out


def _strength(stats: DataFrame, least: float = 1.0) -> float | None:
    """The strength of beta priors around `prior`, fitted to all rows by moments: how far rates stray from their priors
    beyond binomial noise; None where they stray no farther. One row of sums reaches the driver."""
    m = F.col("prior")
    row = stats.agg(F.sum(F.pow(F.col("bad") - F.col("n") * m, 2)).alias("spread"), F.sum(F.col("n") * m * (1 - m)).alias("noise"), F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("pairs")).first()
    # E[(bad - n m)^2] = n m (1 - m) (1 + (n - 1) rho) for a beta-binomial with strength 1 / rho - 1.
    rho = (row["spread"] - row["noise"]) / row["pairs"] if row["pairs"] else 0.0
    return max(least, 1 / rho - 1) if rho > 0 else None


def _below(parents: DataFrame, strength: float | None, children: DataFrame, key: str) -> DataFrame:
    """children with `prior`: the posterior mean of their parent without their own pages, which so count once. Where
    parents are not told from their priors, it is the parent's prior."""
    up = parents.select(key, F.col("n").alias("_n"), F.col("bad").alias("_bad"), F.col("prior").alias("_m"))
    rest = (strength * F.col("_m") + F.col("_bad") - F.col("bad")) / (strength + F.col("_n") - F.col("n")) if strength else F.col("_m")
    return children.join(up, key).withColumn("prior", rest).drop("_n", "_bad", "_m")


# Public suffixes of several labels; a longer list is a parameter.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")


def registered_domain(host: str, suffixes: Sequence[str] = SUFFIXES) -> tuple[F.Column, F.Column]:
    """(registered domain, public suffix) of a host column: without its port, the suffix is the longest of `suffixes`
    that fits, else the last label, and the domain has one label more. An IP address is its own domain and has none."""
    name = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    many = two.isin(*suffixes) if suffixes else F.lit(False)
    address = F.regexp_like(name, F.lit(r"^\d+\.\d+\.\d+\.\d+$")) | F.startswith(name, F.lit("["))
    domain = F.when(address, name).when(many, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(address, "").when(many, two).otherwise(F.substring_index(name, ".", -1))


def host_reputation(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, bad, rate, sd, overall) for the hosts of labelled pages (host, bad 0/1): beta-binomial posteriors, each
    host shrunk to the rest of its registered domain, that to the rest of its suffix, that to all pages, whose rate is
    `overall`. Counts are pre-aggregated per host before anything else, so a host with a third of all pages costs one row
    a task. Where hosts stray from their domains no more than chance makes them, rate is the domain's and sd is 0, whatever
    the host's size."""
    hosts = outcomes.filter("host <> '' and bad is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    domain, suffix = registered_domain("host", suffixes)
    hosts = store(hosts, "host-counts").withColumns({"domain": domain, "suffix": suffix})
    total = hosts.agg(F.sum("n"), F.sum("bad")).first()
    overall = (total[1] + 0.5) / (total[0] + 1) if total[0] else 0.5
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(overall))
    domains = _below(top, _strength(top), hosts.groupBy("domain", "suffix").agg(*sums), "suffix")
    hosts = _below(domains, _strength(domains), hosts, "domain")
    strength, m = _strength(hosts), F.col("prior")
    if strength is None:
        rate, sd = m, F.lit(0.0)
    else:
        a, b = strength * m + F.col("bad"), strength * (1 - m) + F.col("n") - F.col("bad")
        rate, sd = a / (a + b), F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return hosts.select("host", "n", "bad", rate.alias("rate"), sd.alias("sd"), F.lit(overall).alias("overall"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, lift: float = 2.0, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_bound). The longest fitting rule decides; every other page
    is blocked when the lower posterior bound of its host's bad rate, rate - z * sd, has more than `lift` times the odds of
    all pages: when the host is beyond doubt that much worse than the rest. A host that is a little worse is not blocked,
    however many pages prove it. Where rates stray no more than chance makes them, nothing is blocked.

    Null urls and urls without :// have empty host and path, fit no rule and are allowed, as are hosts without
    labelled pages. Repeated rows are judged one by one; other columns, whatever their names, are ignored; an empty table
    gives an empty one.
    """
    judged = url_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).withColumn("fit", match_rule(rules))
    known = host_reputation(outcomes, suffixes).select("host", "overall", F.col("rate").alias("bad_rate"), F.greatest(F.lit(0.0), F.col("rate") - z * F.col("sd")).alias("bad_bound"))
    out = judged.join(known, "host", "left")
    own = F.when(F.col("bad_bound") * (1 - F.col("overall")) > lift * F.col("overall") * (1 - F.col("bad_bound")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "bad_rate", "bad_bound")


# Words of a url, between anything but letters, that mark its page as bad; another list is a parameter.
SPAM_WORDS = ("ads", "adult", "bet", "bets", "casino", "escort", "loan", "pills", "poker", "porn", "spam", "viagra", "xxx")


def page_outcomes(pages: DataFrame, share: float = 0.05, words: Sequence[str] = SPAM_WORDS, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Labelled outcomes (host, bad) from the pages themselves: bad if the runs of junk symbols in the visible text
    make up `share` of its words or more, or if the url holds one of the words. Pages without html are unlabelled."""
    text = F.regexp_replace(F.regexp_replace(html_col, r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    pages = url_parts(pages.select(F.col(url_col).alias("url"), text.alias("seen")))
    junk = F.regexp_count("seen", F.lit(r"([#*$%])\1\1|&amp;&amp;&amp;")) >= share * F.greatest(word_runs("seen"), F.lit(1))
    spam = F.arrays_overlap(F.split(F.concat_ws("/", "host", F.lower("path")), "[^a-z]+"), F.array(*map(F.lit, words))) if words else F.lit(False)
    return pages.filter("seen is not null").select("host", (junk | spam).cast("int").alias("bad"))


def word_runs(col: str) -> F.Column:
    return F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+"))
