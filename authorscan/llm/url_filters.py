"""URL filters: list rules, and link-graph propagation for hosts that no rule decides.

Rules are ``host/path`` with a verdict; one fits its host and all subdomains if the url's path starts with
the rule's path, and the longest wins. Hosts with a page that a rule allows are trusted seeds, hosts with a blocked page
are blocked seeds. Over the host edges that absolute links in the pages make, trust is personalised PageRank from the trusted
seeds, and distrust the same from the blocked seeds over the reversed edges (who links to blocked hosts).
Every seed gives the same mass, one, however many there are, so hosts that have no links with a host don't change its verdict.
A host is blocked if its distrust is at least ``least`` (a share of one seed's mass) and larger than its trust. Ranks are
whole numbers of 1e-10, so sums don't depend on their order, and only grow from round to round up to a bound, so that
rounds end when no rank changes. ``HOPS`` rounds are one job, whose ranks take the place of those stored before. Edges are added up per pair of hosts before they
meet ranks; ranks and edges are stored tables, so a hub's rows can be split in the join.

Defined cases: a null url or one without ``://`` has the empty host and path, which no rule fits and which is no node of
the graph: allowed; null html has no links; repeated pages are judged each and count in the edges;
pages without links, rules or seeds leave ranks at zero; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorscan.llm.blocks import store
from authorscan.session import recorded_stages, remove_stages

HOPS = 8
UNIT = 10 ** 10  # of one seed; a long holds the mass of 9e8 seeds on one host
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?is)\b(?:href|src|action)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    hit = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        hit.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*hit) if hit else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from one host to another."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    return store(links.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> '' and src <> dst")
                 .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def _shares(pairs: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    out = store(pairs.groupBy(src).agg(F.sum("n").alias("total")))
    return pairs.join(out, src).select(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"),
                                       (F.col("n") / F.col("total")).alias("share"))


def propagate(pairs: DataFrame, seeds: DataFrame, damping: float = 0.85) -> DataFrame:
    """(host, trust, distrust) in units of 1e-10 of a seed from ``seeds(kind, host)``; kinds are trust and distrust."""
    edges = store(_shares(pairs, "trust", "src", "dst").unionByName(_shares(pairs, "distrust", "dst", "src")))
    base = store(seeds.select("kind", "host", F.lit(round(UNIT * (1 - damping))).cast("long").alias("rank")))

    def moved(rank):
        return (edges.join(rank, (edges["kind"] == rank["kind"]) & (edges["src"] == rank["host"]))
                .select(edges["kind"], F.col("dst").alias("host"), F.floor(F.col("rank") * damping * F.col("share")).alias("rank")))

    rank, before, settled = base, [], False
    while not settled:
        for _ in range(HOPS - 1):
            rank = base.unionByName(moved(rank)).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        zero = F.lit(0).cast("long")
        last = base.unionByName(moved(rank)).withColumn("was", zero).unionByName(rank.select("kind", "host", zero.alias("rank"), F.col("rank").alias("was")))
        with recorded_stages() as written:
            both = store(last.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")))
        remove_stages(pairs.sparkSession, before)
        before, settled = written, both.where("rank <> was").isEmpty()
        rank = both.select("kind", "host", "rank")
    one = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0)).alias(k)
    return rank.groupBy("host").agg(one("trust"), one("distrust"))


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]], least: float = 1e-4, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust (units of 1e-10 of a seed) for each row of ``pages``."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = store(named.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict"))
    seeds = store(ruled.where("rule is not null and host <> ''").select(
        F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").distinct())
    ranks = propagate(host_edges(pages.select(host_of(F.col("url")).alias("host"), "html")), seeds, damping)
    bad = (F.col("distrust") >= int(least * UNIT)) & (F.col("distrust") > F.col("trust"))
    hosts = store(ranks.select(F.col("host").alias("h"), "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("v")))
    return ruled.join(hosts, ruled["host"] == hosts["h"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "v", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0).cast("long")).alias("trust"), F.coalesce("distrust", F.lit(0).cast("long")).alias("distrust"))
