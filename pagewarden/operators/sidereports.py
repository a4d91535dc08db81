"""What a report says besides its findings: areas not checked, statistics, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import urls
from pagewarden.operators.evidence import Settings
from pagewarden.sources import crawl

KINDS = {"page": "페이지", "iframe": "iframe", "robots": "수집 금지 주소"}
NONE = "array<string>"


def unchecked_pages(crawls: DataFrame) -> DataFrame:
    """(crawl_id, kind, url, frame_path, reason, page_url): where each area that wasn't checked was met, however often.

    Every way in which a crawl has left something unseen is a branch of a union.
    """
    pages, none = crawl.pages(crawls), F.array().cast(NONE)
    area = lambda rows, kind, page, url, path, reason: rows.select(
        "crawl_id", kind.alias("kind"), page.alias("page"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(path, none).alias("frame_path"), reason.alias("reason")
    )
    lit, url = F.lit, F.col("url")
    failed, opened = pages.where("error <> ''"), pages.where("coalesce(error, '') = ''")
    branches = [
        area(failed, lit("page"), url, url, none, F.concat(lit("페이지를 열지 못함: "), "error")),
        area(opened.where("error_page <> ''"), lit("page"), url, url, none, F.concat(lit("오류 페이지로 열림("), "error_page", lit(")"))),
    ]
    source = F.get(
        F.filter("elements", lambda e: (e["type"] == "iframe") & (F.concat(F.coalesce(e["frame_path"], none), F.array(e["selector"])) == F.col("f.frame_path"))), lit(0)
    )["src"]
    frames = opened.select("crawl_id", "url", "elements", F.explode("frames").alias("f")).withColumn("from_element", source)
    first = lambda *cs: F.coalesce(*[F.when(F.coalesce(c, lit("")) != "", c) for c in cs], lit(""))
    place, main = first(F.col("f.frame_url"), F.col("f.src"), F.col("from_element")), F.coalesce("f.is_main", lit(False))
    kind = F.when(main, "page").otherwise("iframe")
    broken = (
        F.when(~main & (F.col("f.loaded") == lit(False)), "iframe이 불러와지지 않아 내용을 확인하지 못함 (숨겨진 탭 안의 iframe 등)")
        .when(F.coalesce("f.timed_out", lit(False)), "응답이 없어 제한 시간 안에 내용을 확인하지 못함")
        .otherwise(F.concat(lit("내용을 읽지 못함 ("), "f.error", lit(")")))
    )
    partly = F.concat(lit("일부만 검사함 (요소 "), F.col("f.total_elements").cast("string"), lit("개 중 "), F.coalesce("f.scanned", lit(0)).cast("string"), lit("개)"))
    part = (F.coalesce("f.error", lit("")) == "") & (F.col("f.total_elements") > F.coalesce("f.scanned", lit(0)))
    branches += [
        area(frames.where("f.error <> ''"), kind, url, place, F.col("f.frame_path"), broken),
        area(frames.where(part), kind, url, place, F.col("f.frame_path"), partly),
    ]
    left_out = opened.select("crawl_id", "url", F.explode("frames_skipped").alias("s"))
    branches.append(area(left_out, lit("iframe"), url, F.col("s.frame_url"), none, F.col("s.reason")))
    screens = crawls.select("crawl_id", F.explode("meta.repeated_screens").alias("s"))
    screens = screens.select("crawl_id", "s.title", F.explode(F.slice("s.urls", lit(2), F.greatest(F.size("s.urls"), lit(1)))).alias("url"))
    titled = F.concat(lit("다른 주소와 똑같은 화면('"), first(F.col("title"), lit("제목 없음")), lit("')이 나와 실제 내용이 점검되지 않았을 수 있음"))
    branches.append(area(screens, lit("page"), url, url, none, titled))
    skipped = crawls.select("crawl_id", F.explode("skipped").alias("s")).select("crawl_id", "s.url")
    branches.append(area(skipped, lit("robots"), url, url, none, lit("robots.txt에서 수집을 막아 둔 주소라 점검하지 않음")))
    every = branches[0]
    for b in branches[1:]:
        every = every.unionByName(b)
    return every.withColumnRenamed("page", "page_url").distinct()


def unchecked(crawls: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(crawl_id, kind, kind_label, url, frame_path, reason, host, trusted_domain, page_count): areas that weren't checked."""
    settings = settings or Settings()
    groups = unchecked_pages(crawls).groupBy("crawl_id", "kind", "url", "frame_path", "reason").agg(F.count("*").cast("int").alias("page_count"))
    host = urls.host("url")
    label = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KINDS.items()])
    trusted = (host != "") & urls.listed(host, settings.trusted)
    return groups.withColumns({"kind_label": label, "host": host, "trusted_domain": trusted})


def stats(crawls: DataFrame, unchecked_areas: DataFrame) -> DataFrame:
    """One row of counts per crawl."""
    frames = F.flatten(F.transform(F.filter("pages", lambda p: p["frames"].isNotNull()), lambda p: p["frames"]))
    scanned = F.aggregate("_frames", F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f["scanned"], F.lit(0)))
    seen = F.filter("_frames", lambda f: ~F.coalesce(f["is_main"], F.lit(False)) & (F.coalesce(f["error"], F.lit("")) == ""))
    twice = F.aggregate(F.coalesce("meta.duplicate_screens", F.array().cast(crawl.SCREENS)), F.lit(0), lambda s, d: s + d["count"] - 1)
    lasted = F.unix_timestamp(F.try_to_timestamp("meta.finished_at")) - F.unix_timestamp(F.try_to_timestamp("meta.started_at"))
    rows = crawls.withColumn("_frames", F.coalesce(frames, F.array().cast(f"array<{crawl.FRAME}>"))).select(
        "crawl_id", F.size("pages").alias("pages"), F.size(F.filter("pages", lambda p: F.coalesce(p["error"], F.lit("")) != "")).alias("page_errors"),
        F.size("_frames").alias("frames"), F.size(seen).alias("iframes"), scanned.alias("elements_scanned"), twice.alias("duplicate_pages"),
        lasted.alias("duration_sec"), F.coalesce("meta.stopped_by_user", F.lit(False)).alias("stopped_by_user"),
    )
    counts = unchecked_areas.groupBy("crawl_id").agg(F.count("*").alias("unchecked"))
    return rows.join(counts, "crawl_id", "left").withColumn("unchecked", F.coalesce("unchecked", F.lit(0)))


def summary(findings: DataFrame) -> DataFrame:
    """(crawl_id, category, pattern_label, findings, high, suspect): by category, by pattern, and in all."""
    counts = [F.count("*").alias("findings"), F.count_if(F.col("level") == "high").alias("high"), F.count_if(F.col("level") == "suspect").alias("suspect")]
    return findings.groupingSets([["crawl_id", "category"], ["crawl_id", "pattern_label"], ["crawl_id"]], "crawl_id", "category", "pattern_label").agg(*counts)


def type_counts(elements: DataFrame) -> DataFrame:
    """How many elements of each type a crawl has."""
    return elements.groupBy("crawl_id", "type").agg(F.count("*").alias("n"))
