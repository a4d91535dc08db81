"""Crawl documents: nested JSON in, tables of pages, frames and elements out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = (
    "struct<frame_url:string,src:string,loaded:boolean,frame_path:array<string>,is_main:boolean,title:string,text:string,truncated:boolean,"
    "timed_out:boolean,scanned:bigint,total_elements:bigint,elapsed_ms:bigint,error:string>"
)
ELEMENT = (
    "struct<type:string,selector:string,content:string,href:string,raw_href:string,src:string,raw_src:string,tag:string,field:string,source:string,"
    "target:string,context_title:string,search_widget:string,hidden:boolean,footer:boolean,hidden_reasons:array<string>,links:array<string>,"
    "frame_url:string,frame_path:array<string>,rect:struct<x:int,y:int,w:int,h:int>>"
)
PROFILE = (
    "struct<key:string,label:string,only_in:string,status:int,final_url:string,title:string,text:string,links:array<string>,"
    "redirects:array<string>,hidden:array<string>,error:string>"
)
PAGE = (
    "struct<url:string,final_url:string,depth:int,status:int,title:string,listed_title:string,found_on:string,crawled_at:string,error:string,"
    "error_page:string,timed_out:boolean,offsite_redirect:boolean,retry_after:string,timings:map<string,double>,"
    f"frames_skipped:array<struct<frame_url:string,reason:string>>,frames:array<{FRAME}>,elements:array<{ELEMENT}>,"
    f"cloaking:struct<url:string,reason:string,profiles:array<{PROFILE}>>>"
)
SCREENS = "array<struct<title:string,count:int,urls:array<string>>>"
META = (
    "struct<mode:string,start_url:string,seed_urls:array<string>,started_at:string,finished_at:string,stopped_by_user:boolean,stopped_reason:string,"
    "robots_ignored:boolean,notes:array<string>,config:struct<include_subdomains:boolean,max_depth:int,max_pages:int>,"
    f"repeated_screens:{SCREENS},duplicate_screens:{SCREENS},gate_rejections:int,blocked_resources:int,"
    "throttle_events:array<struct<url:string,reason:string,delay_sec:double,wait_sec:double,at:string>>>"
)
CRAWL = f"meta {META}, skipped array<struct<url:string,reason:string>>, pages array<{PAGE}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per crawl document, with its file's name as ``crawl_id``."""
    found = spark.read.schema(CRAWL).option("multiLine", True).json(path)
    return found.select(F.col("_metadata.file_path").alias("crawl_id"), "*")


def from_json(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Crawl documents out of a text column."""
    parsed = F.from_json(json_col, f"struct<{', '.join(f'{n}:{t}' for n, t in (('meta', META), ('skipped', 'array<struct<url:string,reason:string>>'), ('pages', f'array<{PAGE}>')))}>")
    return rows.select(F.col(id_col).cast("string").alias("crawl_id"), parsed.alias("c")).select("crawl_id", "c.*")


def pages(crawls: DataFrame) -> DataFrame:
    """One row per page, with what it needs to know of its crawl."""
    seeds = F.when(F.size("meta.seed_urls") > 0, F.col("meta.seed_urls")).otherwise(F.array(F.coalesce("meta.start_url", F.lit(""))))
    subdomains = F.coalesce("meta.config.include_subdomains", F.lit(True)).alias("subdomains")
    rows = crawls.select("crawl_id", seeds.alias("seeds"), subdomains, "pages")
    rows = rows.select("crawl_id", "seeds", "subdomains", F.posexplode("pages").alias("page_ord", "page"))
    return rows.select("crawl_id", "page_ord", "seeds", "subdomains", "page.*")


def read_pages(spark: SparkSession, path: str, crawls: DataFrame) -> DataFrame:
    """The same from pages stored apart, one JSON line each, for crawls of any size.

    A line has the fields of a page, ``crawl_id`` and ``page_ord``; ``crawls`` has crawl_id, seeds array<string>, subdomains.
    """
    lines = spark.read.schema(f"crawl_id string, page_ord int, page {PAGE}").json(path)
    return lines.join(crawls.select("crawl_id", "seeds", "subdomains"), "crawl_id").select("crawl_id", "page_ord", "seeds", "subdomains", "page.*")


def to_pages(crawls: DataFrame) -> DataFrame:
    """(crawl_id, page_ord, page): pages of crawl documents, to be written as JSON lines for ``read_pages``."""
    return crawls.select("crawl_id", F.posexplode("pages").alias("page_ord", "page"))


def elements(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per element, in page order; the main frame's title comes last as an element of its own."""
    main = F.get(F.filter("frames", lambda f: f["is_main"]), F.lit(0))
    empty = {n: None for n in ("href", "raw_href", "src", "raw_src", "tag", "field", "source", "target", "context_title", "search_widget")}
    title = F.struct(
        F.lit("title").alias("type"), F.lit("title").alias("selector"), main["title"].alias("content"),
        *[F.lit(v).cast("string").alias(n) for n, v in empty.items()],
        F.lit(False).alias("hidden"), F.lit(False).alias("footer"), F.array().cast("array<string>").alias("hidden_reasons"),
        F.array().cast("array<string>").alias("links"), F.coalesce(main["frame_url"], F.col("url")).alias("frame_url"),
        F.array().cast("array<string>").alias("frame_path"), F.lit(None).cast("struct<x:int,y:int,w:int,h:int>").alias("rect"),
    )
    titles = F.when(F.coalesce(main["title"], F.lit("")) != "", F.array(title)).otherwise(F.array().cast(f"array<{ELEMENT}>"))
    every = F.concat(F.coalesce("elements", F.array().cast(f"array<{ELEMENT}>")), titles)
    kept = keep or []
    rows = pages.select("crawl_id", "page_ord", *kept, F.posexplode(every).alias("elem_ord", "e")).select("crawl_id", "page_ord", "elem_ord", *kept, "e.*")
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "content": F.coalesce("content", F.lit("")), "selector": F.coalesce("selector", F.lit("")), "hidden": F.coalesce("hidden", F.lit(False)),
        **{c: F.coalesce(c, none) for c in ("frame_path", "links", "hidden_reasons")},
    })


def frames(pages: DataFrame) -> DataFrame:
    """One row per frame."""
    return pages.select("crawl_id", "page_ord", "url", F.posexplode("frames").alias("frame_ord", "f")).select(
        "crawl_id", "page_ord", F.col("url").alias("page_url"), "frame_ord", "f.*"
    )
