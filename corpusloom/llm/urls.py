"""URL filters: rules on hosts and paths, and for the rest trust and distrust that spread over links between hosts. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """A rule like example.com/en/: a host with all its subdomains, and the start of a path."""

    rule: str
    allow: bool

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


RULES = (Rule("com/", True), Rule("example.com/en/", False), Rule("www.example.com/en/", True), Rule("net/es/", False), Rule("net/fr/", False))


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, with A-Z lower-cased; empty without ://, and of a null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://, and of a null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, r.rule).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst and links: how many absolute links the pages of one host have to another host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(2))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def host_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, damping: float = 0.85, tolerance: float = 1e-4, most_rounds: int | None = None, margin: float = 1.0) -> DataFrame:
    """host, trust, distrust and blocked for each host of a page or link.

    trust is the PageRank whose jumps go to hosts with pages that a rule allows, by the number of those pages; distrust is that over the reversed
    links whose jumps go to hosts with blocked pages. Both add up to 1 at most; what reaches a host without links onward ends there. A host is
    blocked if distrust > margin * trust. Rounds end when neither has changed by more than the share tolerance of itself on any host, however little of the
    whole that host has, and so not before all that links lead to are reached; or after most_rounds, if given.
    """
    judged = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed, blocked = ([r.rule for r in rules if r.allow is x] for x in (True, False))
    seeds = judged.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("rule").isin(allowed)).alias("good"), F.count_if(F.col("rule").isin(blocked)).alias("bad"))
    links = checkpointed(host_links(pages))
    hosts = seeds.unionByName(links.select(F.col("dst").alias("host"), F.lit(0).alias("good"), F.lit(0).alias("bad"))).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    hosts = checkpointed(hosts)
    good, bad = hosts.agg(F.sum("good"), F.sum("bad")).first()
    jump = {"jump_t": F.col("good") / F.lit(max(good or 0, 1)), "jump_d": F.col("bad") / F.lit(max(bad or 0, 1))}
    ranks = hosts.select("host", *(c.alias(n) for n, c in jump.items())).withColumns({"trust": F.col("jump_t"), "distrust": F.col("jump_d")})
    if links.isEmpty():
        return ranks.select("host", "trust", "distrust", (F.col("distrust") > margin * F.col("trust")).alias("blocked"))

    # Each link hands on trust from src to dst and distrust from dst to src; the shares don't change.
    out = links.groupBy("src").agg(F.sum("links").alias("n_out"))
    into = links.groupBy("dst").agg(F.sum("links").alias("n_in"))
    shares = links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("links") / F.col("n_out")).alias("forward"), (F.col("links") / F.col("n_in")).alias("backward"))
    none = F.lit(0.0)
    steps = shares.select(F.col("src").alias("at"), F.col("dst").alias("host"), F.col("forward").alias("t"), none.alias("d")).unionByName(
        shares.select(F.col("dst").alias("at"), F.col("src").alias("host"), none.alias("t"), F.col("backward").alias("d"))
    )
    steps = checkpointed(steps)
    # Below this, numbers have too few digits to settle.
    change = lambda new, old: F.when(F.col(new) > 1e-300, F.abs(F.col(new) - F.col(old)) / F.col(new))
    for _ in count() if most_rounds is None else range(most_rounds):
        held = ranks.select(F.col("host").alias("at"), "trust", "distrust")
        got = steps.join(held, "at").groupBy("host").agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        new = ranks.join(got, "host", "left").select(
            "host", "jump_t", "jump_d", F.col("trust").alias("_t"), F.col("distrust").alias("_d"),
            ((1 - damping) * F.col("jump_t") + damping * F.coalesce("t", none)).alias("trust"),
            ((1 - damping) * F.col("jump_d") + damping * F.coalesce("d", none)).alias("distrust"),
        )
        ranks = checkpointed(new)
        moved = ranks.agg(F.greatest(F.max(change("trust", "_t")), F.max(change("distrust", "_d")))).first()[0]
        ranks = ranks.drop("_t", "_d")
        if (moved or 0) <= tolerance:
            break
    return ranks.select("host", "trust", "distrust", (F.col("distrust") > margin * F.col("trust")).alias("blocked"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each row of pages (page_id, url, html).

    The longest rule that fits decides; else the verdict on the host. A url that is null or has no :// has an empty host and path, fits no rule and
    is allowed, as there is nothing against it. Null html has no links; repeated rows are judged alike, and count for the seeds; other columns are
    ignored; an empty table gives no rows.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = host_verdicts(pages, rules, **options)
    allowed = [r.rule for r in rules if r.allow]
    by_rule = F.when(F.col("rule").isin(allowed), "allow").otherwise("block")
    by_host = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_host)
    return rows.join(verdicts, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
