"""Operator 9: URL filters with rules and an empirical-Bayes reputation of hosts.

Rules decide where one fits.  Elsewhere the host's reputation does: labelled outcomes of
its pages, shrunk through beta-binomial priors from the suffix to the registered domain
to the host.  Each level's prior is the posterior mean of the level above, without the key's
own outcomes, with a strength fitted by moments; a page is blocked where even the upper
posterior bound of its host's share of good pages lies below a threshold.  A host without
outcomes has its domain's posterior, with none there the suffix's, and with none there that
of all pages.  The column ``decided_by`` tells which of them, or a rule, gave the verdict.

Outcomes are summed per host before anything is shuffled, so that a host with a third of
all pages costs one row from each task.  The table of hosts grows with the data and is
joined by shuffle; Spark may broadcast it only while it measures as small.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import LOWER, UPPER, cut, named, packed


@dataclass(frozen=True)
class Rule:
    """allow or block for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules (fixed values).
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Public suffixes of more than one part (fixed values); any other last part is one.  ``suffixes_of`` reads a longer list.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
#: Parts of host names that public URL filters count as adult, gambling, drugs, loans, advertising or spam (fixed values).
SPAM_WORDS = (
    "ad", "ads", "adserver", "adult", "bet", "bets", "betting", "cam", "cams", "casino", "escort", "gamble", "gambling", "jackpot",
    "loan", "loans", "payday", "pharma", "pill", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx",
)
#: A page is blocked where its host's upper bound on the share of good pages is below this.
LEAST_GOOD = 0.5
#: Posterior standard deviations from the mean to the bound.
WIDTH = 1.645
#: Suffixes (a name and two numbers) up to which their table is broadcast.
FEW_SUFFIXES = 100_000
#: Bounds of a level's prior strength, in pseudo-pages.
WEAKEST, STRONGEST = 2.0, 200.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    return F.when(F.instr(rest, "/") > 0, F.substring(rest, F.instr(rest, "/"), F.length(rest))).otherwise(F.lit(""))


def site_of(host: Column) -> Column:
    """The host whose reputation counts: without user name, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", ""), r"\.+$", "")


def is_address(site: Column) -> Column:
    """Whether a site is an IPv4 address or a bracketed IPv6 address."""
    return site.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") | F.startswith(site, F.lit("["))


def suffixes_of(spark: SparkSession, path: str, most: int = 50_000) -> tuple[str, ...]:
    """Suffixes of more than one part from a file in the form of the public suffix list.

    Comments, exceptions (!) and the stars of wildcards are left out; more than ``most``
    lines, a bound far above that list, are refused, as the suffixes become part of the plan.
    """
    lines = spark.read.text(path).select(F.regexp_replace(F.lower(F.trim("value")), r"^\*\.", "").alias("s"))
    rows = lines.filter(F.col("s").contains(".") & ~F.col("s").startswith("//") & ~F.col("s").startswith("!")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} suffixes in {path}")
    return tuple(sorted(r.s for r in rows))


def _levels(site: Column, suffixes: tuple[str, ...]) -> tuple[Column, Column]:
    """The suffix of a site, the longest that is listed or else its last part, and one part more: its registered domain."""
    suffix, domain = F.substring_index(site, ".", -1), F.substring_index(site, ".", -2)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        listed = F.substring_index(site, ".", -n).isin(*[s for s in suffixes if s.count(".") + 1 == n])
        suffix, domain = F.when(listed, F.substring_index(site, ".", -n)).otherwise(suffix), F.when(listed, F.substring_index(site, ".", -n - 1)).otherwise(domain)
    return F.when(is_address(site), "ip").otherwise(suffix), F.when(is_address(site), site).otherwise(domain)


def suffix_of(site: Column, suffixes: tuple[str, ...] = TWO_PART_SUFFIXES) -> Column:
    return _levels(site, suffixes)[0]


def domain_of(site: Column, suffixes: tuple[str, ...] = TWO_PART_SUFFIXES) -> Column:
    return _levels(site, suffixes)[1]


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


#: What a reader does not see (fixed values): scripts, styles, tags and character references.
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;")
_SPAM_HOST = rf"(^|[.-])({'|'.join(SPAM_WORDS)})([.-]|$)"


def _good_text(html: str | None) -> int | None:
    """1 for a page of ordinary words, 0 for one of signs, capitals or one word over and over, null without words."""
    body = _HIDDEN.sub(" ", html or "")
    words = body.split()
    if not words:
        return None
    chars = sum(map(len, words)) + 1
    signs = sum(map(body.count, "#*$%|")) > 0.05 * chars
    shouted = sum(map(body.count, UPPER)) > 0.5 * chars
    same = len(words) >= 30 and len(set(words)) < 0.2 * len(words)
    return int(not (signs or shouted or same))


def page_outcome(html: Column, url: Column) -> Column:
    """Weak label of a page by its visible words and its host's name: 1 good, 0 bad, null without words.

    Bad pages are those whose text is full of signs, shouted, or one word over and over,
    and those whose host is named after what public filters block.  The text is read in
    Arrow batches: it takes a quarter of the time that columns take.
    """

    @F.pandas_udf(T.IntegerType())
    def good_texts(html):
        import pandas as pd

        return pd.Series([_good_text(h) for h in html], dtype="Int32")

    text = good_texts(html)
    return F.when(text.isNotNull() & host_of(F.coalesce(url, F.lit(""))).rlike(_SPAM_HOST), 0).otherwise(text)


def _strength(rows: DataFrame) -> float:
    """Strength of a level's prior in pseudo-pages, by moments over rows of (good, n, prior).

    It follows from how much the shares of good pages spread about their priors beyond
    what the binomial alone explains.
    """
    m = F.col("prior")
    seen = rows.filter("n > 1").select(
        F.sum(F.pow(F.col("good") - F.col("n") * m, 2.0)).alias("a"),
        F.sum(F.col("n") * m * (1 - m)).alias("b"),
        F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("c"),
    ).first()
    if not seen["c"]:
        return STRONGEST
    # E[(good - n m)^2] = n m (1 - m) (1 + (n - 1) r), with r = 1 / (strength + 1).
    r = (seen["a"] - seen["b"]) / seen["c"]
    return min(STRONGEST, max(WEAKEST, 1 / r - 1)) if r > 1e-9 else STRONGEST


def _prior(above: str, strength: float) -> Column:
    """Prior mean of a key: the posterior of the level above without the key's own outcomes."""
    rest = F.col(f"{above}_n") - F.col("n")
    return (F.col(f"{above}_good") - F.col("good") + strength * F.col(f"{above}_prior")) / (rest + strength)


def _posterior(key: str, strength: float) -> list[Column]:
    """A level's key and the posterior mean and sd of its share of good pages, from (good, n, prior)."""
    total = F.col("n") + strength
    mean = (F.col("good") + strength * F.col("prior")) / total
    return [F.col(key), mean.alias(f"{key}_mean"), F.sqrt(mean * (1 - mean) / (total + 1)).alias(f"{key}_sd")]


@dataclass(frozen=True)
class Reputation:
    """Posterior mean and sd of the share of good pages: a table for each level, and of all pages."""

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    mean: float
    sd: float
    listed: tuple[str, ...]

    def of(self, hosts: DataFrame) -> DataFrame:
        """host, host_mean, host_sd and the level they come from, for the distinct values of host."""
        known = self.hosts.withColumn("level", F.lit("host"))
        new = hosts.select("host").distinct().join(self.hosts.select("host"), "host", "left_anti")
        new = new.withColumns({"domain": domain_of(F.col("host"), self.listed), "suffix": suffix_of(F.col("host"), self.listed)})
        # One suffix may have most of the hosts: broadcast the few there are, and let skewed ones be split where they are not few.
        few = self.suffixes.limit(FEW_SUFFIXES + 1).count() <= FEW_SUFFIXES
        new = new.join(self.domains, "domain", "left").join(F.broadcast(self.suffixes) if few else self.suffixes, "suffix", "left")
        found = [F.coalesce(f"domain_{x}", f"suffix_{x}", F.lit(whole)).alias(f"host_{x}") for x, whole in (("mean", self.mean), ("sd", self.sd))]
        level = F.when(F.col("domain_mean").isNotNull(), "domain").when(F.col("suffix_mean").isNotNull(), "suffix").otherwise("all")
        return known.unionByName(new.select("host", *found, level.alias("level")))


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = TWO_PART_SUFFIXES) -> Reputation:
    """What outcomes (host, good of 0 or 1) tell of hosts, registered domains and suffixes."""
    hosts = outcomes.filter(F.col("good").isNotNull()).groupBy("host").agg(F.sum("good").cast("double").alias("good"), F.count("*").cast("double").alias("n"))
    hosts = cut(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    ends = cut(domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    whole = ends.agg(F.sum("good"), F.sum("n")).first()
    root = ((whole[0] or 0.0) + 1) / ((whole[1] or 0.0) + 2)
    level = ends.withColumn("prior", F.lit(root))
    known = []
    for key, rows in (("suffix", domains), ("domain", hosts)):
        strength = _strength(level)
        known.append(cut(level.select(_posterior(key, strength))))
        above = level.select(key, F.col("good").alias(f"{key}_good"), F.col("n").alias(f"{key}_n"), F.col("prior").alias(f"{key}_prior"))
        level = cut(rows.join(above, key).withColumn("prior", _prior(key, strength)))
    hosts = level.select(_posterior("host", _strength(level)))
    return Reputation(hosts, known[1], known[0], root, math.sqrt(root * (1 - root) / ((whole[1] or 0.0) + 3)), suffixes)


def filter_urls(pages: DataFrame, outcomes: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, least_good: float = LEAST_GOOD, suffixes: tuple[str, ...] = TWO_PART_SUFFIXES) -> DataFrame:
    """pages with host, path, rule, verdict, decided_by, good_mean and good_bound in place of the url.

    outcomes holds labelled pages: a url column of the same name and good (0, 1 or null).
    decided_by is ``rule``, or the level whose posterior decides: ``host``, ``domain``,
    ``suffix`` or ``all``.  A null url, or one without ``://``, has an empty host and path:
    no rule fits and the empty host's reputation decides.  Of two rules of one length the
    one listed last wins; rules see hosts as they stand, ports included.  Every row of pages comes back
    once, repeated ones too; each row of outcomes counts; an empty table of pages gives an
    empty one, and without outcomes all that no rule blocks is allowed.  Columns that bear a
    result's name are replaced; other names, whatever they are, stay.
    """
    names = ("host", "path", "rule", "verdict", "decided_by", "good_mean", "good_bound")
    address = F.coalesce(named(url), F.lit(""))
    seen = outcomes.select(site_of(host_of(address)).alias("host"), F.col("good"))
    rows = pages.select(packed(pages, url, *names), host_of(address).alias("host"), path_of(address).alias("path"))
    rows = rows.withColumn("site", site_of(F.col("host")))
    known = reputation(seen, suffixes).of(rows.select(F.col("site").alias("host"))).withColumnRenamed("host", "site")
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(known, "site", "left").withColumns({"rule": rule, "good_bound": F.col("host_mean") + WIDTH * F.col("host_sd")})
    own = F.when(F.col("good_bound") < least_good, "block").otherwise("allow")
    by = F.when(F.col("rule").isNotNull(), "rule").otherwise(F.col("level"))
    return out.select("own.*", "host", "path", "rule", F.coalesce(decided, own).alias("verdict"), by.alias("decided_by"), F.col("host_mean").alias("good_mean"), "good_bound")
