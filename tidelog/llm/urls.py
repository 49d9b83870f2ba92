"""URL filter by link-graph propagation over host edges, in DataFrame operations only.

Rules decide first: a rule fits its host and all subdomains if the path starts with
the rule's, the longest rule wins. Hosts with
pages that rules allow are trusted seeds, with pages that rules block blocked seeds.
Trust runs along links as personalised PageRank from
the trusted seeds; distrust runs against them from the blocked seeds (who links to
the bad is bad). A host whose distrust is over a multiple of its trust and of its
share of the pages is blocked by default.

Edges are the links of a page's html to other hosts (attributes and text, absolute or
scheme-relative, slashes escaped or not), and, with weight `bond` (0: none), the bond of a
host with the domains above it; relative links stay on the host and add nothing. Each round
shrinks what is missing of the ranks to `damping` of it, so as many rounds are made as leave
TOLERANCE of the whole at most.

Null urls or html, urls without `://`, and hosts without a link are
judged by the rules, else allowed. Repeated pages are judged each and count each, ties
(equal distrust and limit) are allowed. Other columns of the pages are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, stored

#: Verdict, host and path of the rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Share that is passed on, what may be missing of the ranks, how many times its trust a host's distrust must reach, weight of a bond.
DAMPING, TOLERANCE, FACTOR, BOND = 0.5, 1e-4, 1.5, 1
#: Edges of one host that a task takes; the rest of a hub's go to others. Hubs are at most so many times fewer than edges.
HUB = 100_000
#: Parts into which the pages of each host are dealt.
DEALT = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    rest = F.substring_index(F.substring_index(F.substring_index(after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    rest = F.substring_index(F.substring_index(after_scheme(url), "?", 1), "#", 1)
    at = F.locate("/", rest)
    return F.when(at > 0, F.substr(rest, at)).otherwise(F.lit(""))


def fits_host(host: Column, rule_host: str) -> Column:
    return (host == rule_host) | host.endswith("." + rule_host)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; nulls if none does."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: reduce(lambda c, r: c.when(fits_host(host, r[1]) & path.startswith(r[2]), F.lit(value(r))), longest_first, F.when(F.lit(False), F.lit("")))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def linked_hosts(html: Column) -> Column:
    """The host of every absolute or scheme-relative link."""
    plain = F.regexp_replace(html, r"(?i)\\/|&#x2f;|&#0*47;", "/")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"""(?i)(?:https?://|(?<=[="'(\s])//)([^"'\s<>()\\/?#]+)"""), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html", bond: int = BOND) -> DataFrame:
    """src, dst, share, back, src_parts, dst_parts: links between different hosts and between a host and the domains above it, summed. Stored.

    `share` is the edge's part of what its source sends, `back` of what its target sends back; the parts are those into which the edges of either are dealt.
    """
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(linked_hosts(F.col(html))).alias("dst"))
    edges = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    if bond:
        # All domains above a host that have two labels at least: a.b.c.d gives a.b.c.d - b.c.d and b.c.d - c.d.
        labels = F.split("host", r"\.")
        known = pages.select(host_of(F.col(url)).alias("host")).where("host <> ''").distinct()
        above = known.where(F.size(labels) > 2).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda k: F.struct(tail(labels, k).alias("low"), tail(labels, k + 1).alias("high")))).alias("e"))
        pairs = above.select("e.low", "e.high").distinct()
        kin = pairs.select(F.col("low").alias("src"), F.col("high").alias("dst")).union(pairs.select("high", "low")).withColumn("weight", F.lit(bond).cast("long"))
        edges = edges.union(kin).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    edges = stored(edges, "edges")
    # Stored, so that the joins can split a hub's rows.
    side = lambda end: stored(edges.groupBy(end).agg(F.sum("weight").alias(f"__{end}"), F.ceil(F.count("*") / HUB).cast("int").alias(f"{end}_parts")), end)
    out, into = side("src"), side("dst")
    shares = edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("weight") / F.col("__src")).alias("share"), (F.col("weight") / F.col("__dst")).alias("back"), "src_parts", "dst_parts")
    shares = stored(shares, "host-edges")
    forget(edges, out, into)
    return shares


def tail(labels: Column, first: Column) -> Column:
    """The domain of the labels from `first` (from 1) on."""
    return F.array_join(F.slice(labels, first, F.size(labels)), ".")


def rounds_for(tolerance: float, damping: float) -> int:
    """Rounds after which what is missing of all ranks together is at most `tolerance` of the whole."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def propagate(edges: DataFrame, seeds: DataFrame, source: str, target: str, share: str, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: host, score. seeds: host, seed (sums to 1). Each round is one join on the sending host and one sum by receiver, both of host size."""
    parts = F.col(f"{source}_parts")
    # At most a HUB-th as many as edges.
    hubs = edges.where(parts > 1).select(F.col(source).alias("host"), parts.alias("parts")).distinct()
    sending = edges.select(F.col(source).alias("host"), F.pmod(F.xxhash64(target), parts).cast("int").alias("part"), F.col(target).alias("to"), F.col(share).alias("share"))
    hubs = stored(hubs, "hubs")
    few = hubs.count()
    rank = seeds.select("host", F.col("seed").alias("score"))
    base = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    for k in range(rounds_for(tolerance, damping)):
        if few:
            dealt = rank.join(hubs, "host", "left").select("host", "score", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        else:
            dealt = rank.withColumn("part", F.lit(0))
        sent = dealt.join(sending, ["host", "part"]).select(F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        rank = sent.unionByName(base).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 4 == 3:
            rank = cut(rank)
    return rank


def host_scores(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", bond: int = BOND, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust, share (of all pages) of every host that has pages. Seeds are the hosts with pages that a rule allows or blocks, by their number."""
    _, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).where("host <> ''").withColumn("verdict", verdict)
    hosts = stored(judged.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block")), "hosts")
    edges = host_edges(pages, url, html, bond)
    total = hosts.agg(*(F.greatest(F.sum(x), F.lit(1)).alias(x) for x in ("pages", "allow", "block"))).first()

    def spread(kind: str, source: str, target: str, share: str) -> DataFrame:
        seeds = hosts.where(F.col(kind) > 0).select("host", (F.col(kind) / F.lit(total[kind] or 1)).alias("seed"))
        return propagate(edges, seeds, source, target, share, tolerance)

    zero = F.lit(0.0)
    trust = spread("allow", "src", "dst", "share").select("host", F.col("score").alias("trust"), zero.alias("distrust"), zero.alias("share"))
    distrust = spread("block", "dst", "src", "back").select("host", zero.alias("trust"), F.col("score").alias("distrust"), zero.alias("share"))
    shares = hosts.select("host", zero.alias("trust"), zero.alias("distrust"), (F.col("pages") / F.lit(total["pages"] or 1)).alias("share"))
    return trust.unionByName(distrust).unionByName(shares).groupBy("host").agg(*(F.sum(x).alias(x) for x in ("trust", "distrust", "share"))).where("share > 0")


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html", factor: float = FACTOR, bond: int = BOND, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    Without a rule, a page is blocked if its host's distrust is over `factor` times both its trust and what its share of all pages would give.
    """
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    # A host's pages are dealt into parts, each of which meets the host's scores: one host may have most of the pages.
    scores = host_scores(pages, rules, url, html, bond, tolerance).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    rows = pages.select(F.col(page_id).alias("__id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = rows.withColumn("__part", F.pmod(F.xxhash64("__id", "path"), F.lit(DEALT)).cast("int")).join(scores, ["host", "__part"], "left")
    zero = F.lit(0.0)
    trust, distrust, share = (F.coalesce(x, zero) for x in ("trust", "distrust", "share"))
    own = F.when(distrust > factor * F.greatest(trust, share), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("__id").alias(page_id), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
