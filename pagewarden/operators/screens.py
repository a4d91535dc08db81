"""What a crawl's pages say about the crawl: error pages, repeated screens, throttling, gates, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions import urls

# Wordings of error pages, throttling, bot blocks and standing links, and the bounds of judgements.
ERROR_TEXT = (
    r"(?iu)404|찾을\s*수\s*없|존재하지\s*않|길을\s*(?:잠깐\s*|잠시\s*)?잃|이동되었|없는\s*페이지|페이지가\s*없|"
    r"잘못된\s*(?:주소|경로|접근)|not\s*found|page\s*not|does\s*not\s*exist"
)
RATE_TEXT = (
    r"(?iu)요청\s*(?:속도|횟수)?\s*제한|too\s*many\s*requests|rate\s*limit|과도한\s*(?:요청|접속)|잠시\s*후\s*다시\s*(?:시도|접속)|접속이\s*(?:차단|제한)"
)
BOT_TEXT = (
    r"(?iu)브라우저\s*보안|VPN\s*(?:사용\s*)?(?:제한|차단|금지)|봇\s*(?:차단|탐지|감지|방지)|자동화\s*(?:프로그램|도구|브라우저)|"
    r"(?:비정상|자동)\s*(?:적인\s*)?(?:접근|접속|트래픽)|캡[차챠]|로봇이\s*아닙니다|사람인지\s*확인|captcha|checking\s+your\s+browser|"
    r"verify\s+(?:that\s+)?you\s+are\s+(?:a\s+)?human|are\s+you\s+a\s+robot|bot\s+(?:detection|protection)|unusual\s+traffic"
)
STANDING_TEXT = (
    r"(?iu)개인\s*정보|처리\s*방침|이용\s*약관|약관|서비스\s*(?:안내|소개)|이용\s*안내|저작권|이메일\s*(?:무단)?\s*수집|청소년\s*보호|사이트\s*맵|"
    r"오시는\s*길|찾아\s*오시는|제휴|광고\s*문의|고객\s*센터|회사\s*소개|통계|책임\s*한계|privacy|terms|policy|copyright|sitemap|contact|about\s*us|disclaimer"
)
SHORT_PAGE, SCREEN_TEXT, LEAST_SCREEN, REPEATED = 800, 5000, 20, 3
SCREEN_PARTS = 1024
BACKOFF_LEAST, BACKOFF_MOST, STOP_AFTER, FORBIDDEN_RUN = 2.0, 30.0, 3, 3


def main_text(frames: Column | str = "frames") -> Column:
    """The text of the main frame."""
    return F.coalesce(F.get(F.filter(frames, lambda f: f["is_main"]), F.lit(0))["text"], F.lit(""))


def spaceless(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def error_reason(status: Column, title: Column, text: Column) -> Column:
    """Why a page is an error page; empty if it isn't."""
    said = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    soft = (F.length(spaceless(text)) < SHORT_PAGE) & said.rlike(ERROR_TEXT)
    return (
        F.when(F.coalesce(status, F.lit(0)) >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
        .when(soft, "오류 안내 문구가 있는 짧은 페이지(소프트 404)").otherwise("")
    )


def bot_hints(text: Column) -> Column:
    """The distinct wordings of a bot block, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BOT_TEXT), F.lit(0)), lambda x: F.regexp_replace(x, r"(?U)\s+", " ")))


def standing_link(footer: Column, raw_href: Column, content: Column) -> Column:
    """Whether a link belongs to every page: in the footer, to a place in the page, or to terms and the like."""
    return F.coalesce(footer, F.lit(False)) | F.trim(F.coalesce(raw_href, F.lit(""))).startswith("#") | F.coalesce(content, F.lit("")).rlike(STANDING_TEXT)


def content_grew(before: str = "before", after: str = "after") -> Column:
    """Whether a screen (text, nodes, height, hash) holds more than before."""
    more = lambda c: F.coalesce(F.col(f"{after}.{c}"), F.lit(0)) - F.coalesce(F.col(f"{before}.{c}"), F.lit(0))
    return ~F.col(f"{after}.hash").eqNullSafe(F.col(f"{before}.hash")) & ((more("text") >= 30) | (more("nodes") >= 5) | (more("height") >= 100))


def content_changed(before: str = "before", after: str = "after") -> Column:
    """Whether a screen is another one than before."""
    moved = (F.split(F.col(f"{after}.url"), "#")[0] != F.split(F.col(f"{before}.url"), "#")[0]) & (F.col(f"{after}.text") > 0)
    text, nodes = (F.abs(F.col(f"{after}.{c}") - F.col(f"{before}.{c}")) for c in ("text", "nodes"))
    large = (text >= 1000) | (nodes >= 100)
    part = ((text >= 10) & (text >= F.col(f"{before}.text") * 0.3)) | ((nodes >= 3) & (nodes >= F.col(f"{before}.nodes") * 0.3))
    return moved | (~F.col(f"{after}.hash").eqNullSafe(F.col(f"{before}.hash")) & (large | part))


def shrunk(before: str = "before", after: str = "after") -> Column:
    """Whether little is left of a screen."""
    return (F.col(f"{after}.text") < 300) & (F.col(f"{after}.text") < F.col(f"{before}.text") * 0.3)


def same_screens(pages: DataFrame) -> DataFrame:
    """(crawl_id, title, urls, count, kind): screens that several addresses of a crawl show.

    ``pages``: crawl_id, page_ord, url, final_url, title, text, regated. A screen is suspect if it is the home
    screen, or some page of it moved or had its gate clicked again: ``repeated`` from three addresses on. Others
    are ``duplicate`` from two on.
    """
    dense = F.substring(spaceless(F.col("text")), 1, SCREEN_TEXT)
    rows = pages.where(F.length(dense) >= LEAST_SCREEN).withColumn("screen", F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), dense), 256))
    home = rows.groupBy("crawl_id").agg(F.min_by("screen", "page_ord").alias("home"))
    moved = (F.coalesce("final_url", F.lit("")) != "") & ~urls.normalized("final_url").isin("") & (urls.normalized("final_url") != urls.normalized("url"))
    per_url = rows.groupBy("crawl_id", "screen", "url").agg(
        F.min("page_ord").alias("page_ord"), F.bool_or(moved | F.coalesce("regated", F.lit(False))).alias("odd"), F.min_by(F.coalesce("title", F.lit("")), "page_ord").alias("title")
    )
    part = F.pmod(F.xxhash64("url"), F.lit(SCREEN_PARTS)).alias("part")  # no list of all addresses of a screen is ever made
    some = per_url.groupBy("crawl_id", "screen", part).agg(
        F.count("*").alias("n"), F.bool_or("odd").alias("odd"), F.min_by("title", "page_ord").alias("title"), F.min("page_ord").alias("first"),
        F.slice(F.array_sort(F.collect_list(F.struct("page_ord", "url"))), 1, 10).alias("some"),
    )
    groups = some.groupBy("crawl_id", "screen").agg(
        F.sum("n").alias("count"), F.bool_or("odd").alias("odd"), F.min_by("title", "first").alias("title"), F.min("first").alias("first"),
        F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, 10).alias("some"),
    )
    suspect = F.col("odd") | (F.col("screen") == F.col("home"))
    kind = F.when(suspect & (F.col("count") >= REPEATED), "repeated").when(~suspect & (F.col("count") >= 2), "duplicate")
    judged = groups.join(home, "crawl_id").withColumn("kind", kind).where("kind is not null")
    return judged.select("crawl_id", "title", F.transform("some", lambda x: x["url"]).alias("urls"), "count", "kind", "first")


def runs(rows: DataFrame, keys: list[str], order: str, inside: Column, name: str = "run") -> DataFrame:
    """The rows with how many in a row, this one included, have been inside; 0 outside."""
    by = Window.partitionBy(*keys).orderBy(order)
    island = F.sum(F.when(inside, 0).otherwise(1)).over(by)
    marked = rows.withColumn("_inside", inside).withColumn("_island", island)
    place = F.sum(F.col("_inside").cast("int")).over(Window.partitionBy(*keys, "_island").orderBy(order))
    return marked.withColumn(name, F.coalesce(place, F.lit(0)).cast("int")).drop("_inside", "_island")


def throttled(visits: DataFrame) -> DataFrame:
    """Visits (site, seq, url, final_url, status, retry_after, title, text) with the reason of a throttling, or none."""
    rows = runs(visits, ["site"], "seq", F.coalesce(F.col("status") == 403, F.lit(False)), "forbidden_run")
    said = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, 2000))
    moved = (F.coalesce("final_url", F.lit("")) != "") & (urls.path("final_url") != urls.path("url")) & said.rlike(RATE_TEXT)
    reason = (
        F.when(F.col("status") == 429, "HTTP 429 요청이 너무 많음")
        .when((F.col("status") == 503) & (F.coalesce("retry_after", F.lit("")) != ""), "HTTP 503 일시적으로 사용할 수 없음")
        .when(F.col("forbidden_run") >= FORBIDDEN_RUN, "HTTP 403 접근 거부가 연속 3회")
        .when(moved, "요청 제한 안내 페이지로 이동됨").otherwise("")
    )
    return rows.withColumn("reason", reason)


def backed_off(visits: DataFrame, delay: float = 1.0) -> DataFrame:
    """Throttled visits with the delay and the wait that follow, and whether the crawl stops there.

    ``visits`` is the result of ``throttled``. Delays double with every throttling of a site, within bounds.
    """
    by = Window.partitionBy("site").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = runs(visits, ["site"], "seq", F.col("reason") != "", "streak").withColumn("times", F.sum((F.col("reason") != "").cast("int")).over(by))
    first = max(2 * delay, BACKOFF_LEAST)
    grown = F.least(F.lit(BACKOFF_MOST), F.lit(first) * F.pow(F.lit(2.0), F.least("times", F.lit(30)) - 1))
    asked = F.when(F.trim("retry_after").rlike(r"^\d+$"), F.trim("retry_after").cast("double"))
    rows = rows.where("reason <> ''").withColumn("delay_sec", grown)
    wait = F.when(asked.isNotNull(), F.least(F.lit(2 * BACKOFF_MOST), F.greatest("delay_sec", asked))).otherwise(F.col("delay_sec"))
    return rows.withColumn("wait_sec", wait).withColumn("stops", F.col("streak") >= STOP_AFTER).drop("times")


def cloaking_reason(page_ord: Column, offsite: Column, hidden_links: Column, heavy_words: Column, words: Column, contact: Column, mode: str = "suspect") -> Column:
    """Why a page is opened under other profiles as well; empty if it isn't."""
    found = F.when(F.coalesce(offsite, F.lit(False)), "다른 사이트로 이동").when(hidden_links, "숨김 링크·자동 이동").when(heavy_words | (words & contact), "광고 키워드")
    rest = found.when(page_ord == 0, "첫 페이지")
    return F.lit("") if mode == "off" else rest.otherwise("모든 페이지 검사" if mode == "all" else "")


def notes(crawls: DataFrame) -> DataFrame:
    """(crawl_id, notes): advice on how complete a crawl is.

    ``crawls`` has one row each: crawl_id, mode, pages, max_pages, max_depth, stopped_by_user, blocked_reason,
    delay_sec, start_error, repeated array<struct<title,count>>, linked (pages that content links lead to),
    from_sitemap, sitemap_urls, gate struct<links_after,text_before,text_after,incomplete>, gate_hints, first_links.
    """
    gate, pages, most = F.col("gate"), F.col("pages"), F.col("max_pages")
    number = lambda c: F.col(c).cast("string")
    blocked = F.when(
        F.col("blocked_reason") != "",
        F.concat(F.lit("사이트가 요청을 계속 제한해("), "blocked_reason", F.lit(") "), number("pages"), F.lit("페이지까지만 점검하고 멈췄습니다. 요청 간격("),
                 number("delay_sec"), F.lit("초)을 늘리거나 잠시 뒤 다시 점검해 보세요.")),
    )
    open_ended = (F.col("mode") == "site") & ~F.col("stopped_by_user") & (pages > 0) & (most > 1) & (F.col("max_depth") > 0) & blocked.isNull()
    standing = open_ended & (pages >= 2) & (F.col("linked") == 0) & gate.isNull()
    source = (
        F.when(F.col("from_sitemap") == pages - 1, "sitemap.xml에 있는 주소").when(F.col("from_sitemap") > 0, "sitemap.xml과 약관·안내 같은 고정 링크")
        .otherwise("약관·안내 같은 고정 링크")
    )
    few = open_ended & ~standing & (pages <= most * 0.2) & (most - pages >= 5) & (F.coalesce("sitemap_urls", F.lit(0)) == 0)
    passed = (F.col("gate.links_after") >= 3) | (F.coalesce("gate.text_after", F.lit(0)) > F.coalesce("gate.text_before", F.lit(0)))
    behind = few & gate.isNotNull() & ~F.coalesce(passed, F.lit(False))
    missed = few & gate.isNull() & (F.col("first_links") < 3)
    parts = F.array(
        F.when(F.coalesce("gate.incomplete", F.lit(False)) & (F.size("gate_hints") > 0),
               F.concat(F.lit("봇 차단으로 보입니다. 보안 안내 문구: "), F.array_join(F.slice("gate_hints", 1, 3), ", "))),
        F.when(F.col("start_error") != "", F.concat(F.lit("시작 주소가 오류 페이지입니다("), "start_error", F.lit(")."))),
    )
    screens = F.transform(
        F.coalesce("repeated", F.array().cast("array<struct<title:string,count:bigint>>")),
        lambda s: F.concat(F.lit("같은 화면이 반복 점검되었습니다: '"), s["title"], F.lit("' "), s["count"].cast("string"), F.lit("곳")),
    )
    last = F.array(
        blocked,
        F.when(standing, F.concat(source, F.lit("로만 "), number("pages"), F.lit("페이지를 점검했습니다."))),
        F.when(behind, F.concat(F.lit("입장 버튼을 누른 뒤에도 발견한 링크가 적어 "), number("pages"), F.lit("페이지만 점검했습니다."))),
        F.when(missed, F.concat(F.lit("발견한 링크가 적어 "), number("pages"), F.lit("페이지만 점검했습니다."))),
    )
    return crawls.select("crawl_id", F.filter(F.concat(parts, screens, last), lambda n: n.isNotNull()).alias("notes"))
