"""Which pages a crawl would visit: links to follow, and breadth-first search over a table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions import urls
from pagewarden.operators import screens
from pagewarden.plans.shared import stored
from pagewarden.sources import sitemap


def followed(url: Column, site: Column, subdomains: bool = True) -> Column:
    """Whether a crawl of a site follows an address."""
    return (url != "") & urls.crawlable(url) & urls.safe(url) & urls.same_site(urls.host(url), urls.host(site), subdomains)


def next_links(pages: DataFrame, links: DataFrame, subdomains: bool = True) -> DataFrame:
    """(url, next, ord): the addresses that each page leads to, once each, in order.

    ``pages``: url, final_url, site. ``links``: url, ord, href.
    """
    base = F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.col("url"))
    joined = links.join(pages.select("url", base.alias("base"), "site"), "url").withColumn("next", urls.resolved("href", "base"))
    good = joined.where(followed(F.col("next"), F.col("site"), subdomains))
    return good.groupBy("url", "next").agg(F.min("ord").alias("ord"))


def merged_records(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Records of two extractions of pages, first come first kept, by (frame_path, selector, type, content, href, src)."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    by = Window.partitionBy(*key, "frame_path", "selector", "type", "content", "href", "src").orderBy("_turn", "elem_ord")
    return both.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def reachable(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): what is reached from the starts (url) over edges (url, next) within so many steps.

    One round per depth: new addresses are the neighbours of the last round that aren't known yet, so cycles
    end. Each round is stored in the shared folder and read by the next ones.
    """
    edges = stored(edges.select("url", "next").distinct(), "edges")
    known = front = stored(starts.select("url", F.lit(0).alias("depth")).distinct(), "front")
    for depth in range(1, max_depth + 1):
        found = front.join(edges, "url").select(F.col("next").alias("url")).distinct().join(known, "url", "left_anti")
        front = stored(found.withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def merged(seeds: DataFrame, listed: DataFrame, linked: DataFrame, subdomains: bool = True) -> DataFrame:
    """(site, url, depth, found_on, ord): every address that a crawl knows of, where it was first found.

    ``seeds``: site, url, ord. ``listed`` by sitemaps or feeds: site, url, ord. ``linked``: site, url, found_on, depth, ord,
    of the page with the link. Listed addresses count only where a crawl would follow them.
    """
    own = seeds.select("site", "url", F.lit(0).alias("depth"), F.lit("").alias("found_on"), "ord", F.lit(0).alias("turn"))
    told = listed.select("site", urls.normalized("url").alias("url"), "ord").where(followed(F.col("url"), F.col("site"), subdomains))
    told = told.select("site", "url", F.lit(1).alias("depth"), F.lit("sitemap.xml").alias("found_on"), "ord", F.lit(1).alias("turn"))
    met = linked.select("site", "url", (F.col("depth") + 1).alias("depth"), "found_on", "ord", F.lit(2).alias("turn"))
    every = own.unionByName(told).unionByName(met)
    first = every.groupBy("site", "url").agg(F.min(F.struct("turn", "depth", "ord", "found_on")).alias("f"))
    return first.select("site", "url", "f.depth", "f.found_on", "f.ord")


def titled(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Pages (crawl_id, url, ...) with the title that a sitemap or feed (crawl_id, ord, url, title) first gave their address."""
    named = listed.where("title <> ''").select("crawl_id", urls.normalized("url").alias("url"), "ord", "title")
    first = named.where("url <> ''").groupBy("crawl_id", "url").agg(F.min_by("title", "ord").alias("listed_title"))
    return pages.drop("listed_title").join(first, ["crawl_id", "url"], "left").withColumn("listed_title", F.coalesce("listed_title", F.lit("")))


def skipped(frontier: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """(site, url, reason): addresses of a frontier (site, url) that robots.txt (site, robots) keeps an agent from."""
    asked = frontier.join(robots, "site", "left").withColumn("_may", sitemap.allowed(F.col("url"), F.col("robots"), agent))
    return asked.where("not _may").select("site", "url", F.lit("robots.txt").alias("reason"))


def content_links(pages: DataFrame, links: DataFrame, subdomains: bool = True) -> DataFrame:
    """(crawl_id, url, next): where content links lead, once each.

    ``pages``: crawl_id, url, final_url, site. ``links``: crawl_id, url, ord, href, raw_href, content, footer. Links that
    stand on every page don't count, nor those to the page itself.
    """
    content = links.where(~screens.standing_link(F.col("footer"), F.col("raw_href"), F.col("content")))
    final = F.coalesce("final_url", F.lit(""))
    base = F.when(final != "", final).otherwise(F.col("url"))
    joined = content.join(pages.select("crawl_id", "url", base.alias("base"), "site"), ["crawl_id", "url"]).withColumn("next", urls.resolved("href", "base"))
    good = joined.where(followed(F.col("next"), F.col("site"), subdomains))
    own = F.array(urls.normalized("url"), urls.normalized("base"))
    return good.where(~F.array_contains(own, F.col("next"))).select("crawl_id", "url", "next").distinct()


def content_linked(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages after the first that content links (crawl_id, next) lead to, by their address or where it took the visitor."""
    targets = found.select("crawl_id", F.col("next").alias("target")).distinct()
    addresses = pages.where("page_ord > 0").select("crawl_id", "page_ord", F.explode(F.array("url", F.coalesce("final_url", F.lit("")))).alias("target"))
    reached = addresses.join(targets, ["crawl_id", "target"]).select("crawl_id", "page_ord").distinct()
    return pages.join(reached, ["crawl_id", "page_ord"], "left_semi")


def new_links(after: DataFrame, before: DataFrame, own: DataFrame) -> DataFrame:
    """(crawl_id, url): links after a step that weren't there before and don't lead to the page itself."""
    names = ["crawl_id", "url"]
    return after.select(*names).distinct().join(before.select(*names), names, "left_anti").join(own.select(*names), names, "left_anti")


def firsts(pages: DataFrame) -> DataFrame:
    """(crawl_id, gate, start_error): the first page's gate that was opened, and why the start page is an error page."""
    gate = F.min_by("gate", F.when(F.col("gate").isNotNull(), F.col("page_ord")))
    return pages.groupBy("crawl_id").agg(gate.alias("gate"), F.coalesce(F.max(F.when(F.col("page_ord") == 0, F.col("error_page"))), F.lit("")).alias("start_error"))


def planned(found: DataFrame, total: int) -> DataFrame:
    """The first so many addresses of each site: by depth, then as they were found. ``found``: site, url, depth, ord."""
    once = found.groupBy("site", "url").agg(F.min(F.struct("depth", "ord")).alias("place"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("place", "url"))).where(F.col("k") <= total).select("site", "url", "place.depth", "k")
