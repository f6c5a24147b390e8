"""URL filters: rules by host and path, and for the rest trust and distrust over the graph of hosts.

A host that rules decide has its share of allowed pages as trust and of blocked pages as distrust; a host
that is only linked to has the shares of the links to it, by the rules for their targets. As far as rules
leave a host open, its distrust is DAMPING of the mean distrust of the hosts it links to (who links to bad
hosts is not trusted either) and its trust DAMPING of the mean trust of the hosts that link to it. So distrust is what a
surfer who starts at the host, follows links and gives up with 1 - DAMPING at each step finds of blocked hosts: the host's own
personalised PageRank, ended at and summed over the blocked seeds; trust is the same against the links, for trusted seeds. Hosts
link where a page has an absolute link to another host, and, in both directions, where one is the parent
domain of the other. Means do not depend on how many other hosts link to the same one, so scores do not
shrink as the graph grows. Trust never blocks by its absence: a host that nothing is known of passes. Everything is joins and sums of DataFrames, repeated until scores stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import common
from tidemill.llm.common import cut, join_groups

HREF = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//"""
#: Absolute or protocol-relative link targets; the group is the host, of TARGET host and the rest.
LINK = HREF + r"""([^"'/?#\s>]*)"""
TARGET = HREF + r"""([^"'\s>]*)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Rounds between two looks at the change, and the change up to which scores count as settled.
ROUNDS = 8
TOLERANCE = 1e-6
#: A host is blocked where its distrust is this or more, and more than its trust.
DISTRUST = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null and for a text without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. rules: host/path -> allow or block; a host stands for its subdomains too."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if found is None else found


def ruling(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """Whether rules allow, and whether they block; an empty path is the root."""
    rule = rule_of(host, F.when(path == "", "/").otherwise(path), rules)
    allowed = rule.isin([r for r, v in rules.items() if v == "allow"])
    return F.coalesce(allowed, F.lit(False)), F.coalesce(rule.isNotNull() & ~allowed, F.lit(False))  # without allow rules, isin is false for null too


def edges(pages: DataFrame, host: str, html: str, rules: dict[str, str], names: DataFrame | None = None) -> DataFrame:
    """(src, dst, w, n, allowed, blocked): links between different hosts, with the number of pages' links and of those
    to targets that rules allow or block, and parent domains, which add to w only. names(h): the pages' hosts, if known."""
    found = (
        pages.where(F.col(html).contains("//") & (F.col(host) != ""))
        .select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(TARGET), F.lit(1))).alias("to"))
        .select("src", *(c.alias(n) for c, n in zip(parts(F.concat(F.lit("://"), "to")), ("dst", "path"), strict=True))).where("dst != '' and src != dst")
    )
    allowed, blocked = ruling(F.col("dst"), F.col("path"), rules)
    links = found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count_if(allowed).alias("allowed"), F.count_if(blocked).alias("blocked"))
    names = pages.where(F.col(host) != "").select(F.col(host).alias("h")).distinct() if names is None else names
    up = names.select("h", F.regexp_replace("h", r"^[^.]*\.", "").alias("p")).where("p != h")
    family = up.join(names.select(F.col("h").alias("p")), "p", "left_semi")
    both = family.select(F.col("h").alias("src"), F.col("p").alias("dst")).union(family.select("p", "h"))
    none = [F.lit(0).cast("long").alias(c) for c in ("n", "allowed", "blocked")]
    every = links.withColumn("w", F.col("n").cast("double")).unionByName(both.select("src", "dst", F.lit(1.0).alias("w"), *none))
    return every.groupBy("src", "dst").agg(*(F.sum(c).alias(c) for c in ("w", "n", "allowed", "blocked")))


def host_scores(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(host, trust, distrust). pages: (host, n, allowed, blocked); links: (src, dst, w, n, allowed, blocked)."""
    targets = links.where("n > 0").groupBy(F.col("dst").alias("host")).agg(*(F.sum(c).alias(c) for c in ("n", "allowed", "blocked")))
    judged = pages.select("host", "n", "allowed", "blocked").unionByName(targets.join(pages, "host", "left_anti"))
    known = links.select(F.col("dst").alias("host")).union(links.select("src")).distinct()
    hosts = judged.select("host", (F.col("allowed") / F.col("n")).alias("trust"), (F.col("blocked") / F.col("n")).alias("distrust"))
    hosts = hosts.join(known, "host", "full").na.fill(0.0, ["trust", "distrust"])
    # the weight with which each host takes the score of another: distrust from where it links to, trust from where links come from
    takes = cut(links.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w", F.lit("distrust").alias("kind")).union(links.select("dst", "src", "w", F.lit("trust"))), "takes")
    total = takes.count()
    # a host that many take from is dealt in parts; there are at most HOT_KEYS such hosts, so they may be sent out
    most = max(common.COLD_ROWS, total // common.HOT_KEYS)
    hot = cut(takes.groupBy("b", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("b", "kind", F.ceil(F.col("n") / most).alias("parts")), "hot")
    parts = F.coalesce("parts", F.lit(1).cast("long")).alias("parts")
    takes = cut(takes.join(F.broadcast(hot), ["b", "kind"], "left").select("a", "b", "kind", "w", F.pmod(F.xxhash64("a"), parts).alias("part")), "dealt")
    seeds = hosts.select("host", F.lit(1) - F.col("trust") - F.col("distrust"), F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust"))).toDF("b", "open", "kind", "seed")
    seeds = cut(seeds.join(F.broadcast(hot), ["b", "kind"], "left").select(F.col("b").alias("host"), "kind", "open", "seed", parts), "seeds")
    score = seeds.select("host", "kind", "parts", F.col("seed").alias("s"))
    moving = total > 0
    while moving:
        before = score.select("host", "kind", F.col("s").alias("_s"))
        for _ in range(ROUNDS):
            given = score.select(F.col("host").alias("b"), "kind", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
            # every host that links know has a score, so the weights that meet one are all weights; summed within tasks first
            mean = takes.join(given, ["b", "kind", "part"]).groupBy(F.col("a").alias("host"), "kind").agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("mean"))
            score = seeds.join(mean, ["host", "kind"], "left").select("host", "kind", "parts", (F.col("seed") + F.col("open") * DAMPING * F.coalesce("mean", F.lit(0.0))).alias("s"))
        score = cut(score, "scores")
        change = score.join(before, ["host", "kind"]).agg(F.max(F.abs(F.col("s") - F.col("_s")))).first()[0]
        moving = change > TOLERANCE  # each round leaves DAMPING of the change at most
    s = F.round("s", 9)  # sums come in any order
    return score.groupBy("host").agg(F.max(F.when(F.col("kind") == "trust", s)).alias("trust"), F.max(F.when(F.col("kind") == "distrust", s)).alias("distrust"))


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) for every row, repeated rows each.

    verdict: the rule's, else block where the host's distrust is DISTRUST or more and above its trust, else
    allow. Null URLs and those without :// have no host; they are allowed. Null pages have no links.
    """
    host, path = parts(F.col(url_col))
    named = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    # one pass over the URLs, and one over the pages for links; what follows reads these small tables
    ruled = cut(named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)), "ruled")
    allow = [r for r, v in rules.items() if v == "allow"]
    allowed, blocked = ruling(F.col("host"), F.col("path"), rules)
    counted = ruled.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(allowed).alias("allowed"), F.count_if(blocked).alias("blocked"))
    counted = cut(counted, "hosts")
    links = edges(pages.select(host.alias("host"), F.col(html_col).alias("_html")), "host", "_html", rules, counted.select(F.col("host").alias("h")))
    scores = host_scores(counted, cut(links, "links"))
    bad = scores.where((F.col("distrust") >= DISTRUST) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("_bad"))
    # hosts with their pages' counts, so that one with a third of all pages is dealt in parts; rows without a host need none
    judged = cut(counted.join(bad, "host", "left").select("host", "n", "_bad"), "judged")
    some = join_groups(ruled.where("host != ''"), judged, "host", "_id", ruled.count()).drop("n")
    out = some.unionByName(ruled.where("host = ''").withColumn("_bad", F.lit(None).cast("boolean")))
    by_rule = F.when(F.col("rule").isin(allow), "allow").when(F.col("rule").isNotNull(), "block")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("_bad"), "block"), F.lit("allow")).alias("verdict"))
