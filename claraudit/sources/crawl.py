"""Which pages a crawl of a known link graph visits, breadth first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claraudit.functions import urls
from claraudit.sources.stage import kept


@dataclass(frozen=True)
class CrawlPolicy:
    """What a crawl may visit. Pages and links a page are limits of the feature, not of the engine."""

    max_depth: int = 0
    max_pages: int = 10
    max_links: int = 50
    same_origin: bool = True
    include_subdomains: bool = False
    drop_parameters: tuple[str, ...] = urls.TRACKERS


def bfs(seeds: DataFrame, links: DataFrame, *, max_depth: int, max_pages: int) -> DataFrame:
    """url, depth of the first max_pages pages: by depth, then by the place of the finding page and of the link on it.
    seeds: url; links: source, target, place. The frontier and the visited set are limited by max_pages, so each round is
    a join of a small side with the link table."""
    spark = seeds.sparkSession
    first = seeds.select("url").distinct().orderBy("url").limit(max_pages).collect()  # max_pages rows at most
    frontier = spark.createDataFrame([(r["url"], i) for i, r in enumerate(first)], "url string, rank int")
    visited = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        room = max_pages - visited.count()
        if room <= 0 or frontier.isEmpty():
            break
        found = links.join(F.broadcast(frontier.select(F.col("url").alias("source"), "rank")), "source").groupBy(F.col("target").alias("url")).agg(F.min(F.struct("rank", "place")).alias("at"))
        found = found.join(F.broadcast(visited.select("url")), "url", "left_anti").orderBy("at", "url").limit(room)
        rows = [(r["url"], i) for i, r in enumerate(found.collect())]
        if not rows:
            break
        frontier = spark.createDataFrame(rows, "url string, rank int")
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return visited.select("url", "depth")


def frontier(seeds: DataFrame, links: DataFrame, policy: CrawlPolicy) -> DataFrame:
    """url, host, depth, rank (from 0, in its host) of the first `max_pages` pages of every host, breadth first: by depth, then
    by the rank and host of the page that links to it, the link's place, and its address. seeds: url; links: source, target,
    place; `max_links` of each page are followed, in order of place.

    A delta iteration: a round joins the last round's pages with the links, leaves out what has been visited and takes of each
    host what its budget allows. Every round's pages are kept as a table of the shared folder; the driver learns how many
    there are, never which. The visited set meets new addresses by a join on the address; it is never broadcast unasked."""
    own = lambda c: F.coalesce(urls.host(F.col(c)), F.lit(""))
    on_page = Window.partitionBy("source").orderBy("place", "target")
    links = links.select("source", "target", "place").withColumn("_n", F.row_number().over(on_page)).filter(F.col("_n") <= policy.max_links).drop("_n")
    if policy.same_origin:
        links = links.filter(urls.same_host(F.col("target"), F.col("source"), policy.include_subdomains))
    in_host = lambda *order: F.row_number().over(Window.partitionBy("host").orderBy(*order)) - 1
    now = seeds.select("url").filter("url is not null").distinct().withColumn("host", own("url")).withColumn("rank", in_host("url").cast("long"))
    now = kept(now.filter(F.col("rank") < policy.max_pages).withColumn("depth", F.lit(0)), "frontier")
    visited = now
    for depth in range(1, policy.max_depth + 1):
        found = links.join(now.select(F.col("url").alias("source"), F.col("host").alias("_by"), F.col("rank").alias("_rank")), "source")
        found = found.groupBy(F.col("target").alias("url")).agg(F.min(F.struct("_rank", "_by", "place")).alias("at")).join(visited.select("url"), "url", "left_anti")
        used = visited.groupBy("host").agg(F.count(F.lit(1)).alias("_used"))
        found = found.withColumn("host", own("url")).withColumn("_n", in_host("at", "url")).join(used, "host", "left")
        rank = (F.coalesce("_used", F.lit(0)) + F.col("_n")).cast("long")
        now = kept(found.withColumn("rank", rank).filter(F.col("rank") < policy.max_pages).select("url", "host", "rank", F.lit(depth).alias("depth")), "frontier")
        if now.isEmpty():
            break
        visited = visited.unionByName(now)
    return visited.select("url", "host", "depth", "rank")
