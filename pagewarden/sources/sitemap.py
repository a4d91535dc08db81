"""Sitemaps, feeds and robots.txt as tables.

Bodies are given as a table (url, body): a crawl stores what it fetched, and everything here is a query
over that.
"""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET
import zlib
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pagewarden.functions.arrow import once
from pagewarden.plans.shared import stored

# Bounds of a discovery and where sitemaps and feeds are looked for.
MAX_FILES, MAX_BYTES, MAX_URLS, FEEDS_BELOW = 30, 20 << 20, 5000, 50
SITEMAPS, FEEDS = ["/sitemap.xml", "/sitemap_index.xml", "/all/sitemap.xml"], ["/rss", "/feed", "/rss.xml"]
PARSED = "struct<kind:string,items:array<struct<url:string,title:string>>,children:array<string>>"


def unzipped(body: bytes) -> bytes:
    """The body, unpacked if it is gzip; empty if that fails."""
    if body[:2] != b"\x1f\x8b":
        return body
    try:
        return gzip.decompress(body)
    except (OSError, EOFError, zlib.error):
        return b""


def name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2].lower() if isinstance(element.tag, str) else ""


def child(element: ET.Element, wanted: str) -> ET.Element | None:
    return next((c for c in element if name(c) == wanted), None)


def words(element: ET.Element | None) -> str:
    return (element.text or "").strip() if element is not None else ""


def feed_link(item: ET.Element) -> str:
    guid = child(item, "guid")
    return words(child(item, "link")) or (words(guid) if guid is not None and guid.get("isPermaLink", "true") != "false" else "")


def entry_link(entry: ET.Element) -> str:
    return next((c.get("href", "") for c in entry if name(c) == "link" and c.get("rel", "alternate") == "alternate"), "")


def parse(body: bytes | None, base: str) -> dict:
    """Kind, items and children of a document; an empty kind if it is neither a sitemap nor a feed."""
    nothing = {"kind": "", "items": [], "children": []}
    try:
        root = ET.fromstring(unzipped(body or b"")[:MAX_BYTES])
    except ET.ParseError:
        return nothing
    kind = name(root)
    if kind in ("sitemapindex", "urlset"):
        places = [urljoin(base, words(e)) for e in root.iter() if name(e) == "loc"]
        places = [u for u in places if u.startswith("http")]
        index = kind == "sitemapindex"
        return {"kind": "sitemap", "items": [] if index else [{"url": u, "title": ""} for u in places], "children": places if index else []}
    if kind in ("rss", "rdf"):
        found = [(feed_link(e), words(child(e, "title"))) for e in root.iter() if name(e) == "item"]
    elif kind == "feed":
        found = [(entry_link(e), words(child(e, "title"))) for e in root if name(e) == "entry"]
    else:
        return nothing
    items = [{"url": urljoin(base, u), "title": t} for u, t in found if u]
    return {"kind": "atom" if kind == "feed" else "rss", "items": [i for i in items if i["url"].startswith("http")], "children": []}


def parsed(body: Column, base: Column) -> Column:
    """The struct of ``parse``."""

    def one(bodies: pd.Series, bases: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(b, u) for b, u in zip(bodies, bases)], columns=["kind", "items", "children"])

    return once(pandas_udf(one, PARSED))(body, base)


def locations(robots: Column, base: Column) -> Column:
    """The distinct sitemaps that a robots.txt names, in order."""

    def one(texts: pd.Series, bases: pd.Series) -> pd.Series:
        def found(text, url):
            pairs = (line.partition(":") for line in (text or "").splitlines())
            return list(dict.fromkeys(urljoin(url, v.strip()) for k, _, v in pairs if k.strip().lower() == "sitemap" and v.strip()))

        return pd.Series([found(t, u) for t, u in zip(texts, bases)], dtype=object)

    return once(pandas_udf(one, "array<string>"))(robots, base)


def discover(bodies: DataFrame, origins: DataFrame, explicit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What sitemaps and feeds of each origin list: (origin, ord, url, title), and sources (origin, url, kind, source, urls).

    ``bodies``: (url, body). ``origins``: (origin, robots) with the text of robots.txt or null. ``explicit``:
    (origin, url) given by the user. Index files are followed breadth first, without going in circles. Bounds
    per origin are those of the data contract; feeds count only where sitemaps list fewer than ``FEEDS_BELOW``.
    """
    guess = lambda paths, rank, label: origins.select(
        "origin", F.posexplode(F.array(*[F.concat("origin", F.lit(p)) for p in paths])).alias("k", "url"), F.lit(rank).alias("rank"), F.lit(label).alias("source")
    )
    told = origins.where("robots is not null").select("origin", F.posexplode(locations(F.col("robots"), F.concat("origin", F.lit("/")))).alias("k", "url"), F.lit(1).alias("rank"), F.lit("robots.txt").alias("source"))
    starts = told.unionByName(guess(SITEMAPS, 2, "자동 탐색")).unionByName(guess(FEEDS, 3, "자동 탐색"))
    if explicit is not None:
        starts = starts.unionByName(explicit.select("origin", F.monotonically_increasing_id().alias("k"), "url", F.lit(0).alias("rank"), F.lit("지정").alias("source")))
    read = bodies.select("url", parsed(F.col("body"), F.col("url")).alias("p")).where("p.kind <> ''").select("url", "p.*")
    first = Window.partitionBy("origin", "url").orderBy("path")
    front = starts.select("origin", "url", "rank", "source", F.array("rank", F.col("k").cast("int")).alias("path"))
    front = front.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    read, front, seen = stored(read, "documents"), stored(front, "front"), None
    while not front.isEmpty():  # an address is read once for each origin, so indexes of any depth come to an end
        found = front.join(read, "url")
        seen = found if seen is None else seen.unionByName(found)
        below = found.select("origin", "rank", "source", "path", F.posexplode("children").alias("i", "url"))
        below = below.select("origin", "url", "rank", "source", F.concat("path", F.array("i")).alias("path"))
        front = stored(below.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(seen.select("origin", "url"), ["origin", "url"], "left_anti"), "front")
    seen = seen if seen is not None else front.join(read, "url")
    files = Window.partitionBy("origin").orderBy("rank", "path")
    seen = seen.withColumn("file", F.row_number().over(files)).where(F.col("file") <= MAX_FILES)
    items = seen.select("origin", F.col("url").alias("file_url"), "rank", "source", "kind", "file", F.posexplode("items").alias("i", "item"))
    enough = F.count_if(F.col("rank") < 3).over(Window.partitionBy("origin")) >= FEEDS_BELOW
    items = items.withColumn("_enough", enough).where("rank < 3 or not _enough")
    place = F.struct("rank", "file", "i")
    pages = items.groupBy("origin", F.col("item.url").alias("url")).agg(
        F.min(place).alias("place"), F.min_by("file_url", place).alias("file_url"),
        F.min_by(F.when(F.col("item.title") != "", F.col("item.title")), F.when(F.col("item.title") != "", place)).alias("title"),
    )
    pages = pages.withColumn("ord", F.row_number().over(Window.partitionBy("origin").orderBy("place"))).where(F.col("ord") <= MAX_URLS)
    sources = seen.join(pages.groupBy("origin", F.col("file_url").alias("url")).agg(F.count("*").alias("urls")), ["origin", "url"], "left")
    sources = sources.select("origin", "url", "kind", "source", F.coalesce("urls", F.lit(0)).alias("urls"))
    return pages.select("origin", "ord", "url", F.coalesce("title", F.lit("")).alias("title")), sources


def allowed(url: Column, robots: Column, agent: str = "*") -> Column:
    """Whether a robots.txt lets an agent fetch a URL; null or blank text allows all."""

    def one(urls_: pd.Series, texts: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}

        def ask(u, t):
            if not (t or "").strip():
                return True
            if t not in known:
                known[t] = RobotFileParser()
                known[t].parse(t.splitlines())
            return known[t].can_fetch(agent, u)

        return pd.Series([ask(u, t) for u, t in zip(urls_, texts)], dtype=bool)

    told = F.coalesce(F.trim(robots), F.lit("")) != ""
    return once(pandas_udf(one, "boolean"))(F.when(told, url), F.when(told, robots))  # null costs nothing
