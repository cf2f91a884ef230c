"""URL verdicts: explicit rules, then trust and distrust propagated over the host graph.

Trust is personalised PageRank from the hosts of allowed pages along links; distrust is the same from the hosts of blocked
pages against the direction of links (who links to a bad host is suspect). A link within a site names a path, and sites of one
make share their menus: such a path is a node between the hosts whose pages link to it, and both scores pass it both ways. Both
are iterated as DataFrame joins over edges that are aggregated first: a row per pair of hosts, or of host and path, not per link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: (verdict, host, path): fixed by the query's contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Share of a score that follows links; rounds; a host is blocked when its share of all distrust is above RATIO times its share of
#: all trust, and at least FLOOR times an even share.
DAMPING, ROUNDS, RATIO, FLOOR = 0.85, 8, 1.25, 0.1

#: Links with a host, and links within a site: from its root, without the root itself, up to a query or fragment.
ABSOLUTE = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]+)"""
LOCAL = r"""(?i)\bhref\s*=\s*["']?\s*(/[^/\s"'>?#][^\s"'>?#]*)"""


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), common.UPPER, common.LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _links(pages: DataFrame, pattern: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("link")).where("src <> ''")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, links: links between different hosts, counted per pair."""
    links = _links(pages, ABSOLUTE, url_col, html_col)
    links = links.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))).alias("dst"))
    return links.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def shared_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, links: links within sites, counted per host and path, both ways. No host begins with a slash, as paths do."""
    links = _links(pages, LOCAL, url_col, html_col).groupBy("src", F.col("link").alias("dst")).agg(F.count(F.lit(1)).alias("links"))
    return links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, score: personalised PageRank of ``seeds`` (host, seed: its weight) along ``edges`` (src, dst, links).

    Nodes with very many edges, found by a count, have their scores broadcast; the others meet by a sort. The score of nodes
    without outgoing links goes back to nobody: only order and ratio of scores are used.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("n_out"), F.count(F.lit(1)).alias("edges"))
    w = common.staged(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("n_out")).alias("w"), "edges"), "host-edges")
    # under HOT nodes have more than this many edges: of those the scores are broadcast
    least = max(w.count() // common.HOT, common.WARM)
    heavy, light = w.where(F.col("edges") > least), w.where(F.col("edges") <= least)
    hot = not heavy.isEmpty()
    nodes = heavy.select(F.col("src").alias("host")).distinct()
    score = seeds.select("host", F.col("seed").alias("score"))
    for k in range(rounds):
        moved = score.join(light, score.host == light.src).select("dst", (F.col("score") * F.col("w")).alias("part"))
        if hot:
            known = F.broadcast(score.join(F.broadcast(nodes), "host", "left_semi"))
            moved = moved.unionByName(heavy.join(known, known.host == heavy.src).select("dst", (F.col("score") * F.col("w")).alias("part")))
        moved = moved.groupBy(F.col("dst").alias("host")).agg((F.sum("part") * damping).alias("part"))
        both = moved.unionByName(seeds.select("host", (F.col("seed") * (1 - damping)).alias("part")))
        score = both.groupBy("host").agg(F.sum("part").alias("score"))
        if hot or k % 4 == 3:
            score = common.staged(score, "host-scores")
    return score


def judge_urls(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", rules=RULES, damping=DAMPING, rounds=ROUNDS, ratio=RATIO, floor=FLOOR) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, trust, distrust.

    A url that is null or has no ``://`` has host and path '' and no rule, and is allowed. Seeds weigh a host by the share of
    its pages that the rules allow or block; all seeds of a kind add up to 1. A host that neither score reaches is allowed. Of rules that fit, the longest wins;
    a distrust that ties with the trust doesn't block. Null html has no links. Urls and pages are read whole, however long.
    Repeated rows give a row each and count each; extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    hosts = common.staged(rows.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "hosts")
    edges, paths = common.staged(host_edges(pages, url_col, html_col), "links"), common.staged(shared_paths(pages, url_col, html_col), "paths")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    n_hosts, *sums = hosts.agg(F.count(F.lit(1)), F.sum(F.col("good") / F.col("n")), F.sum(F.col("bad") / F.col("n"))).first()

    def spread(kind: str, along: DataFrame, all_: float | None) -> DataFrame:
        seeds = hosts.where(F.col(kind) > 0).select("host", (F.col(kind) / F.col("n") / F.lit(all_ or 1.0)).alias("seed"))
        return propagate(along.unionByName(paths), seeds, damping, rounds)

    trust, distrust = spread("good", edges, sums[0]), spread("bad", back, sums[1])
    scores = trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full")
    scores = scores.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    scores = common.staged(scores.join(hosts.select("host", F.col("n").alias("pages")), "host"), "host-scores")
    total = rows.count()
    blocked = F.coalesce((F.col("distrust") > ratio * F.col("trust")) & (F.col("distrust") * n_hosts >= floor), F.lit(False))
    return common.join_hot(rows, scores, ["host"], "pages", total, "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
