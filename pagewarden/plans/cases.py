"""Queries over worked cases: what the engine's operators must make of known inputs.

The test tables hold no Korean text, no hidden elements, no sitemaps. So each of these queries deals a list of
inputs over the whole pages table, page p getting input p % n (``{p}`` in it stands for the page's number), and runs
the engine's own operator on all of them at once. The SQL deals the rows that are expected (``expected.py``) over the
same table.
"""

from __future__ import annotations

import gzip
import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.functions import contacts, domains, matching, reflection, urls
from pagewarden.functions.charmap import CharMap, read_confusables
from pagewarden.functions.matching import Matcher
from pagewarden.operators import frontier, screens, sidereports, stuffing
from pagewarden.plans import detect
from pagewarden.plans.expected import ROWS
from pagewarden.sources import crawl, exports, html, sitemap, url_list

QUERIES: dict = {}
#: Number of inputs and the columns of each query.
SHAPES: dict[str, tuple[int, str]] = {}
SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(inputs: list, columns: str):
    """Register a function of (spark, sf_dir) that gives page_id and the named columns for so many inputs."""

    def put(f):
        kinds = [c.split() for c in columns.split(", ")]

        def run(spark, sf_dir):
            return f(spark, sf_dir).select("page_id", *[F.col(n).cast(t).alias(n) for n, t in kinds])

        run.__doc__ = f.__doc__
        QUERIES[f.__name__], SHAPES[f.__name__] = run, (len(inputs), columns)
        return run

    return put


def literal(value, kind: str) -> str:
    if value is None:
        return f"NULL::{SQL_TYPES[kind]}"
    if kind == "string":
        text = "'" + value.replace("'", "''") + "'"
        return f"replace({text}, '{{p}}', page_id::VARCHAR)" if "{p}" in value else text
    return f"{str(value).lower() if kind == 'boolean' else repr(value)}::{SQL_TYPES[kind]}"


def oracle(name: str) -> str:
    """SQL: the expected rows of every input, for every page that got it."""
    n, columns = SHAPES[name]
    kinds = [c.split() for c in columns.split(", ")]
    parts = [f"SELECT page_id, {', '.join(f'{literal(v, t)} AS {c}' for v, (c, t) in zip(row, kinds))} FROM pages WHERE page_id % {n} = {k}" for k, *row in ROWS.get(name, [])]
    return "\nUNION ALL ".join(parts)


def dealt(spark: SparkSession, sf_dir: str, inputs: list, columns: str) -> DataFrame:
    """(page_id, k, columns): the inputs, one for each page."""
    rows = [(k, *(x if isinstance(x, tuple) else (x,))) for k, x in enumerate(inputs)]
    given = F.broadcast(spark.createDataFrame(rows, f"k int, {columns}"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.pmod("page_id", F.lit(len(rows))).cast("int").alias("k")).join(given, "k")
    fill = lambda c: F.replace(F.col(c), F.lit("{p}"), F.col("page_id").cast("string"))
    return pages.withColumns({c: fill(c) for c, t in pages.dtypes if t == "string"})


TEXTS = [
    "카지노 바카라 추천", "토.토.사.이.트 주소", "먹 튀 없는 곳", "카​지노", "саsino 바로가기", "ｐｏｒｎ", "ⓟⓞⓡⓝ", "𝐩𝐨𝐫𝐧 보기", "vîågrà", "바7라 가입", "슬-롯", "밖콰라 바로", "카찌노 안내",
    "ㅋㅈㄴ 추천", "㉥㉪㉣ 쿠폰", "zkwlsh go", "qkzkfk", "스포츠토토 토토", "오피스 건물 안내", "대마도 여행", "야바위꾼", "① 접수 ② 심사", "café naïve", "도토리묵", "빠른 대출, 급전 상담", "무 료 영 상",
    "입금보너스와 가입코드", "카지노 카지노 밖카라", "", "casino CASINO mycasino", "인생 성인 용품", "토토", "바.카.라 먹튀", "불법환전 환전",
]


@case(TEXTS, "word string, category string, kind string, method string, original string, reading string, weight int, label string")
def matcher_hits(spark, sf_dir):
    """Dictionary words and their disguised spellings, with the default dictionary."""
    rows = dealt(spark, sf_dir, TEXTS, "text string")
    return rows.select("page_id", F.explode(matching.hits(Matcher(), F.col("text"))).alias("h")).select("page_id", "h.*")


@case(TEXTS, "word string, start int, stop int")
def matcher_spans(spark, sf_dir):
    """Places of words as they are; shorter ones inside longer ones don't count."""
    rows = dealt(spark, sf_dir, TEXTS, "text string")
    return rows.select("page_id", F.explode(matching.spans(Matcher(), F.col("text"))).alias("s")).select("page_id", "s.word", "s.start", "s.stop")


@case(TEXTS, "words string")
def matcher_words(spark, sf_dir):
    """The distinct words of a text, in the order of their rank."""
    rows = dealt(spark, sf_dir, TEXTS, "text string")
    words = F.array_distinct(F.transform(matching.spans(Matcher(), F.col("text")), lambda s: s["word"]))
    return rows.select("page_id", F.array_join(words, ",").alias("words")).where("words <> ''")


READINGS = ["x㈎ｙ́é", "Ⓐ①❷⓿ 🅰🇰", "ᴀʙ ª²ₓ", "Straße Øre łódź", "ПОРНО ρорn", "Ꭺ ㉠ ᄀ", "a​b﻿c", "㊙⑴⒜", "plain ASCII", "가나다 ㄱㄴ"]


@case(READINGS, "view string, styles string, given string")
def text_readings(spark, sf_dir):
    """What disguised characters read as, how they are disguised, and the reading with a table of confusable letters."""
    given = Matcher(charmap=CharMap(read_confusables("13AA ;\t0047 ;\tMA\t# CHEROKEE\n4E00 ; 0061 ; MA\n0430 ; 0061 ; MA")))
    rows, text = dealt(spark, sf_dir, READINGS, "text string"), F.col("text")
    return rows.select("page_id", matching.normalized(Matcher(), text).alias("view"), F.array_join(matching.styles(Matcher(), text), ",").alias("styles"), matching.normalized(given, text).alias("given"))


CONTACTS = [
    "텔레그램 @win7777 문의", "텔레 아이디: abcd12", "t.me/joinchat+1", "카톡 vip777 주세요", "라인 아이디 : line_77", "문의 @agent_01 바람", "mail a.b@agent.kr", "010-1234-5678", "전화 02-123-4567",
    "도박 중독 예방 캠페인", "불법 사이트 신고하세요", "tg: king777", "호텔 telegram", "평범한 안내문", "수사 결과 텔레그램 @cop_1234",
]


@case(CONTACTS, "kind string, value string, warns boolean")
def contact_cases(spark, sf_dir):
    """Contacts in a text and whether it warns of offences."""
    rows = dealt(spark, sf_dir, CONTACTS, "text string").withColumn("c", contacts.contact(F.col("text")))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c.rpartition(".")[2])
    return rows.select("page_id", empty("c.kind"), empty("c.value"), contacts.prevention(F.col("text")).alias("warns"))


LINKS = [
    ("../a?x=1#y", "https://www.p{p}.kr/board/list"), ("//f.kr", "https://a.kr/"), ("javascript:go()", "https://a.kr/"), ("#top", "https://a.kr/"), ("", "https://a.kr/"), ("HTTP://A.kr:80/B?q=1", ""),
    ("https://a.kr:443", ""), ("http://a.kr:8080/x", "http://b.kr"), ("?page=2", "https://a.kr/list?page=1"), ("mailto:x@a.kr", "https://a.kr/"), ("/logout", "https://a.kr/x"),
    ("ftp://a.kr/x", "https://a.kr/"), (" /trim ", "https://a.kr/x/y"), ("/file.PDF", "https://a.kr/"), ("/board?mode=delete&id=1", "https://a.kr"), ("/%EA%B8%80+1?q=%EA%B8%80+2", "https://a.kr/"),
]


@case(LINKS, "resolved string, followed boolean, shown string")
def url_cases(spark, sf_dir):
    """Addresses as they read on a page, whether a crawl of its site follows them, and how people read them."""
    rows = dealt(spark, sf_dir, LINKS, "url string, base string").withColumn("resolved", urls.resolved("url", "base"))
    return rows.select("page_id", "resolved", frontier.followed(F.col("resolved"), F.col("base")).alias("followed"), urls.displayed("url").alias("shown"))


SCRIPTS = [
    ("<script>location.href = 'https://x{p}.kr/a'</script>", "0; url='http://y.kr/b'"), ("window.open(\"http://a.kr/1\");location.replace('http://b.kr/2');location='http://a.kr/1'", "5;URL=http://c.kr/;"),
    ("location = '/own'", "5"), ("", ""),
]


@case(SCRIPTS, "scripts string, refresh string")
def redirect_cases(spark, sf_dir):
    """Where scripts and refreshes send a visitor."""
    rows = dealt(spark, sf_dir, SCRIPTS, "page string, content string")
    return rows.select("page_id", F.array_join(urls.script_redirects("page"), " ").alias("scripts"), urls.refresh_target("content").alias("refresh"))


STANDING = [
    (True, "/x", "공지"), (False, "#a", "공지"), (False, "/x", "개인정보 처리방침"), (None, "/x", "Privacy Policy"), (False, "/x", "공지사항"), (False, None, "오시는 길"), (False, " # ", "x"), (None, "/b/1", None),
]


@case(STANDING, "standing boolean, hints string")
def standing_links(spark, sf_dir):
    """Links that stand on every page; wordings of bot blocks."""
    rows = dealt(spark, sf_dir, STANDING, "footer boolean, raw_href string, content string")
    said = F.concat_ws(" ", "content", F.when(F.col("k") % 2 == 0, "캡차  확인, 봇 차단. Checking  your browser, 캡차"))
    return rows.select("page_id", screens.standing_link(F.col("footer"), F.col("raw_href"), F.col("content")).alias("standing"), F.array_join(screens.bot_hints(said), "|").alias("hints"))


ECHOES = [
    ("https://a.kr/s?q=카지노", "", "'카지노' 검색 결과"), ("https://a.kr/s?q=%B9%D9%C4%AB%B6%F3", "", "바 카 라 결과"), ("https://a.kr/s?q=공지&u=http%3A%2F%2Fmy-casino.kr", "https://a.kr/s?q=공지", "공지 http://my-casino.kr 로"),
    ("https://a.kr/s?q=x&w=먹튀", "https://a.kr/t?w=먹튀&v=토토사이트", "토토사이트 먹튀 먹 튀"), ("https://a.kr/", "", "카지노"), ("https://a.kr/?a=&b=슬롯사이트+보기", "", "슬롯사이트보기"), ("https://a.kr/?s=카", "", "카"),
]


@case(ECHOES, "given string, echoed string, outside string, searched boolean")
def echoed_params(spark, sf_dir):
    """Parameters of a page's addresses, those that its text echoes, and the text without them."""
    rows = dealt(spark, sf_dir, ECHOES, "url string, final_url string, text string").withColumn("params", reflection.params(Matcher(), F.array("url", "final_url")))
    rows = rows.withColumn("echo", reflection.reflected(F.col("params"), F.col("text")))
    named = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat(p["name"], F.lit("="), p["value"], F.when(p["bad"], "!").otherwise(""))), "&")
    searched = F.forall("echo", lambda p: urls.search_param(p["name"]))
    return rows.select("page_id", named(F.col("params")).alias("given"), named(F.col("echo")).alias("echoed"), reflection.stripped(F.col("text"), F.transform("echo", lambda p: p["value"])).alias("outside"), searched.alias("searched"))


HOSTS = ["my-casino.kr", "toto777.com", "sexy.co.kr", "alphabet.com", "totorial.kr", "www.city.go.kr", "youtube.com.", "notyoutube.com", "BET365.net", "*.example.org/", "https://Trusted.kr/", "# comment", "jav-av.tv", ""]


@case(HOSTS, "category string, trusted boolean, cleaned string")
def host_cases(spark, sf_dir):
    """Suspicious and trusted hosts, and lines of a list of domains."""
    rows, host = dealt(spark, sf_dir, HOSTS, "host string"), F.lower("host")
    return rows.select("page_id", F.coalesce(domains.suspicion(host), F.lit("")).alias("category"), urls.listed(host, domains.TRUSTED).alias("trusted"), domains.cleaned(F.col("host")).alias("cleaned"))


SITE = "https://www.city.go.kr/"


def rec(type_, content, selector="div", **more):
    return {"type": type_, "content": content, "selector": selector, "frame_path": [], "frame_url": SITE, **more}


def page(*elements, url=SITE + "a", **more):
    return {"url": url, "final_url": more.pop("final_url", url), "elements": list(elements), **more}


def crawl_of(*pages, skipped=(), **meta):
    return {"meta": {"start_url": SITE, "seed_urls": [SITE], "started_at": "2024-01-01T00:00:00", "finished_at": "2024-01-01T00:01:30", **meta}, "pages": list(pages), "skipped": list(skipped)}


HIDDEN = rec("hidden", "바카라 텔레그램 @win7777", "div.x", links=["http://win-toto.invalid/"], hidden_reasons=["display:none"])
PROFILE = {"links": [], "redirects": [], "hidden": []}
CRAWLS = [
    crawl_of(page(HIDDEN, rec("link", "바카라", "div.x > a", href="http://win-toto.invalid/", hidden=True)), page(HIDDEN, url=SITE + "b")),
    crawl_of(page(rec("text", "먹튀 없는 놀이터", "#p"), rec("link", "가기", "#p > a", href="http://bet365.invalid/"))),
    crawl_of(page(rec("link", "바로가기", "#l", href="http://my-toto.invalid/"), title="목록", listed_title="글 목록")),
    crawl_of(page(rec("text", "카지노", "#t"), rec("text", "안내문", "#u"))),
    crawl_of(page(rec("text", "도박 중독 예방: 카지노 바카라 먹튀", "#t"))),
    crawl_of(page(rec("text", "먹튀 예방 카지노 텔레그램 @win7777", "#t"))),
    crawl_of(page(rec("text", "'카지노' 검색 결과", "#t"), url=SITE + "s?q=카지노")),
    crawl_of(page(rec("text", "카지노 바카라 추천", "#t"), url=SITE + "s?q=카지노 바카라")),
    crawl_of(page(rec("text", "카지노 글", "#t"), url=SITE + "s?id=카지노")),
    crawl_of(page(rec("iframe", "", "#f", src=SITE + "f", hidden=True), rec("text", "먹튀 검증 안내", "#t", frame_path=["#f"]), rec("text", "먹튀 검증 안내", "#t2"))),
    crawl_of(page(rec("text", "카지노 먹튀", "#a", links=["http://x.invalid/"]), rec("hidden", "바카라 카지노 먹튀", "#a > b", links=["http://bet.invalid/"]))),
    crawl_of(page(url=SITE + "r", final_url="http://evil-casino.invalid/", offsite_redirect=True)),
    crawl_of(page(rec("redirect", "0; url='http://slot-king.invalid/'", "meta"))),
    crawl_of(page(rec("link", "먹튀", "#k", href=SITE + "q", search_widget="인기 검색어", context_title="검색어"))),
    crawl_of(page(rec("meta", "카지노 바카라", 'meta[name="keywords"]', field="keywords"), rec("alt", "카지노 바카라", "#i"), rec("noscript", "카지노 바카라", "#n"))),
    crawl_of(page(rec("text", "카지노 바카라", "#t"), frames=[{"is_main": True, "title": "글", "frame_url": SITE, "text": "\n".join(["카지노 바카라 먹튀 토토사이트"] * 8), "frame_path": []}])),
    crawl_of(page(rec("link", "casino", "#y", href="https://www.youtube.com/watch"))),
    crawl_of(page(rec("link", "바.카.라 추천", "#s1", href="http://ads.invalid/", hidden=True), rec("text", "바.카.라 추천", "#s1"))),
    crawl_of(page(cloaking={"profiles": [
        {**PROFILE, "key": "pc", "label": "일반 PC", "title": "안내", "text": "시청 안내"},
        {**PROFILE, "key": "googlebot", "label": "구글봇", "only_in": "구글봇에게만", "title": "카지노", "text": "바카라 먹튀\n시청 안내", "links": ["http://casino.invalid/"]},
        {**PROFILE, "key": "mobile", "label": "모바일", "only_in": "모바일에서만", "title": "안내", "text": "시청 안내 그리고 더 긴 글"},
        {**PROFILE, "key": "google_referer", "label": "구글 검색 경유", "only_in": "구글 검색으로 들어올 때만", "title": "안내", "text": "시청 안내", "final_url": "http://jump-bet.invalid/", "redirects": ["http://jump-bet.invalid/"]},
    ]})),
    crawl_of(page(rec("link", "casino", "#z", href="http://other.kr/x")), seed_urls=[SITE, "http://other.kr/"]),
    crawl_of(page(rec("text", "ⓟⓞⓡⓝ 밖콰라", "#v", links=["http://a.invalid/", "http://b.invalid/"])), page(rec("text", "빈 글", "#w"), url=SITE + "b")),
]


def crawls(spark: SparkSession, sf_dir: str, inputs: list = CRAWLS) -> DataFrame:
    """A crawl for each page: crawl_id is the page's number."""
    rows = dealt(spark, sf_dir, [json.dumps(c, ensure_ascii=False) for c in inputs], "j string")
    return crawl.from_json(rows, "page_id", "j")


def by_page(rows: DataFrame) -> DataFrame:
    return rows.withColumn("page_id", F.col("crawl_id").cast("long"))


@case(CRAWLS, "id int, level string, level_label string, score int, pattern string, pattern_label string, category string, type string, content string, selector string, page_count int, urls string, "
              "evidence string, page_title string, post_title string, location_label string, advice string")  # fmt: skip
def detected_findings(spark, sf_dir):
    """The whole detection: elements, pages, stuffing, cloaking; reduced by place, grouped over pages, ranked."""
    rows = by_page(detect.grouped(detect.page_findings(crawls(spark, sf_dir))))
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["kind"], e["label"], e["points"])), "; ")
    return rows.withColumns({"urls": F.array_join("urls", " "), "evidence": evidence})


@case(CRAWLS, "id int, page_ord int, page_url string")
def finding_pages(spark, sf_dir):
    """The pages of each finding."""
    found = detect.page_findings(crawls(spark, sf_dir))
    return by_page(detect.finding_pages(found, detect.grouped(found)))


@case(CRAWLS, "id int, place string, hiding string, echo string, url_lines string, evidence_lines string")
def report_texts(spark, sf_dir):
    """What reports show of a finding's arrays."""
    return by_page(exports.shown_findings(detect.grouped(detect.page_findings(crawls(spark, sf_dir)))))


@case(CRAWLS, "category string, pattern_label string, findings long, high long, suspect long")
def findings_by_kind(spark, sf_dir):
    """Summary of each crawl: by category, by pattern, and in all."""
    return by_page(sidereports.summary(detect.grouped(detect.page_findings(crawls(spark, sf_dir)))))


@case(CRAWLS, "host string, count long, whitelisted boolean, place int")
def outside_hosts(spark, sf_dir):
    """Hosts outside of a crawl's sites, the most frequent first."""
    return by_page(detect.external_domains(crawls(spark, sf_dir)))


@case(CRAWLS, "type string, n long")
def element_types(spark, sf_dir):
    """Elements of each type, with the main frame's title."""
    return by_page(sidereports.type_counts(crawl.elements(crawl.pages(crawls(spark, sf_dir)))))


@case(CRAWLS, "profile string, label string, only_in string, similarity double, new_keywords string, redirects string, new_hosts string, title string, base_title string, content string")
def cloaked_pages(spark, sf_dir):
    """What a page shows some visitors only."""
    rows = by_page(detect.page_findings(crawls(spark, sf_dir)).where("type = 'cloaking'")).select("page_id", "content", "cloaking.*")
    return rows.withColumns({c: F.array_join(c, " ") for c in ("new_keywords", "redirects", "new_hosts")})


@case(CRAWLS, "count int, kinds int, density double, list_lines int, top string, merged int, examples string")
def stuffed_pages(spark, sf_dir):
    """Pages that repeat words, with the visible findings that they take in."""
    rows = by_page(detect.page_findings(crawls(spark, sf_dir)).where("type = 'page_stuffing'")).select("page_id", "stuffing.*")
    return rows.withColumns({"top": F.array_join("top", " "), "examples": F.array_join("examples", "|")})


STUFFED = [
    "카지노 바카라 먹튀 " * 10, "카지노 바카라 먹튀 " * 5, "카지노 " * 30, "\n".join(["카지노 바카라 먹튀"] * 8) + "\n" + "평범한 안내 글이 길게 이어집니다 " * 80,
    "평범한 안내 글이 길게 이어집니다 " * 80 + "카지노 바카라 먹튀 " * 9, "대출 급전 환전 룰렛 " * 6, None,
]


@case(STUFFED, "count int, kinds int, density double, list_lines int, top string")
def stuffing_cases(spark, sf_dir):
    """How a text is stuffed with dictionary words."""
    rows = dealt(spark, sf_dir, STUFFED, "text string").select("page_id", stuffing.stats(Matcher(), F.col("text")).alias("s")).where("s.count is not null")
    return rows.select("page_id", "s.count", "s.kinds", "s.density", "s.list_lines", F.array_join("s.top", " ").alias("top"))


MAIN = {"is_main": True, "frame_path": []}
SIDES = [
    crawl_of(
        page(error="timeout", url=SITE + "1"), page(error_page="HTTP 404", url=SITE + "2", frames=[{**MAIN, "frame_url": SITE + "2", "scanned": 5, "total_elements": 9}]),
        page(rec("iframe", "", "#f", src="http://f.kr/"), url=SITE + "3", frames=[
            {**MAIN, "frame_url": SITE + "3", "scanned": 7, "total_elements": 7}, {"is_main": False, "loaded": False, "frame_path": ["#f"], "error": "x"},
            {"is_main": False, "frame_path": ["#g"], "frame_url": "http://g.kr/", "scanned": 2}]),
        page(url=SITE + "4", frames=[{"is_main": False, "loaded": False, "frame_path": ["#f"], "frame_url": "http://f.kr/", "error": "y"}], frames_skipped=[{"frame_url": "http://h.kr/", "reason": "too many"}]),
        repeated_screens=[{"title": "", "count": 3, "urls": [SITE + "x", SITE + "y", SITE + "z"]}], duplicate_screens=[{"title": "t", "count": 3, "urls": []}], skipped=[{"url": SITE + "secret", "reason": "robots"}],
    ),
    crawl_of(page(url=SITE, frames=[{**MAIN, "frame_url": SITE, "scanned": 12345, "total_elements": 12345}]), stopped_by_user=True, finished_at="2024-01-01T00:00:45"),
    crawl_of(page(url=SITE, frames=[{**MAIN, "frame_url": SITE, "timed_out": True, "error": "slow"}, {"is_main": False, "frame_path": ["#y"], "frame_url": "https://youtube.com/x", "error": "boom"}]), finished_at=None),
]


@case(SIDES, "kind string, kind_label string, url string, frame_path string, reason string, host string, trusted_domain boolean, page_count int, line string")
def unchecked_areas(spark, sf_dir):
    """What a crawl has left unseen, once for all pages."""
    return by_page(exports.shown_areas(sidereports.unchecked(crawls(spark, sf_dir, SIDES)))).withColumn("frame_path", F.array_join("frame_path", ">"))


@case(SIDES, "pages int, page_errors int, frames int, iframes int, elements_scanned long, duplicate_pages int, duration_sec long, stopped_by_user boolean, unchecked long, lines string")
def crawl_figures(spark, sf_dir):
    """Counts of each crawl, and in words."""
    found = crawls(spark, sf_dir, SIDES)
    stats = sidereports.stats(found, sidereports.unchecked(found))
    return by_page(stats.join(exports.figures(stats), "crawl_id")).withColumn("lines", F.array_join("lines", "\n"))


SCREEN = {"hash": "a", "url": "http://a/", "text": 100, "nodes": 50, "height": 900}
GATES = [
    (SCREEN, {**SCREEN, "url": "http://a/#x"}), (SCREEN, {**SCREEN, "hash": "b", "text": 200}), ({**SCREEN, "text": 1000}, {**SCREEN, "hash": "b", "text": 20, "nodes": 10}),
    (SCREEN, {**SCREEN, "hash": "b", "text": 105, "nodes": 51, "height": 1100}), (SCREEN, {**SCREEN, "url": "http://b/"}), (SCREEN, {**SCREEN, "hash": "b", "text": 2000}),
]


@case(GATES, "changed boolean, grew boolean, little boolean")
def gate_cases(spark, sf_dir):
    """Whether a screen is another one, holds more, or hardly anything after a click."""
    kind = "struct<hash:string,url:string,text:int,nodes:int,height:int>"
    rows = dealt(spark, sf_dir, [(json.dumps(a), json.dumps(b)) for a, b in GATES], "b string, a string")
    rows = rows.select("page_id", F.from_json("b", kind).alias("before"), F.from_json("a", kind).alias("after"))
    return rows.select("page_id", screens.content_changed().alias("changed"), screens.content_grew().alias("grew"), screens.shrunk().alias("little"))


TARGETS = [(3, True, False, False, False, False, "suspect"), (3, False, True, False, False, False, "suspect"), (3, False, False, True, False, False, "suspect"), (3, False, False, False, True, True, "suspect"),
           (3, False, False, False, True, False, "suspect"), (0, False, False, False, False, False, "suspect"), (3, None, False, False, False, False, "all"), (0, True, True, True, True, True, "off")]


@case(TARGETS, "reason string")
def cloaking_targets(spark, sf_dir):
    """Why a page is opened under other profiles."""
    rows = dealt(spark, sf_dir, TARGETS, "page_ord int, offsite boolean, hidden boolean, heavy boolean, words boolean, contact boolean, mode string")
    reason = lambda mode: screens.cloaking_reason(*map(F.col, ("page_ord", "offsite", "hidden", "heavy", "words", "contact")), mode=mode)
    return rows.select("page_id", F.when(F.col("mode") == "all", reason("all")).when(F.col("mode") == "off", reason("off")).otherwise(reason("suspect")).alias("reason"))


def visit(status=200, retry_after=None, title="", text="글", url=SITE + "v", final_url=None):
    return page(url=url, final_url=final_url or url, status=status, retry_after=retry_after, title=title, frames=[{**MAIN, "text": text}])


VISITS = [
    crawl_of(visit(), visit(429), visit(), visit(429, "120"), visit(429)),
    crawl_of(visit(503), visit(503, "7"), visit(503, "Wed, 21 Oct 2026 07:28:00 GMT"), visit(503, "9999")),
    crawl_of(visit(403), visit(403), visit(403), visit(), visit(403)),
    crawl_of(visit(title="요청 제한", text="잠시 후 다시 시도", final_url=SITE + "notice"), visit(text="too many requests", final_url=SITE + "v"), visit(title="Rate limit", final_url=SITE + "limit")),
]


@case(VISITS, "seq long, reason string, delay_sec double, wait_sec double, stops boolean")
def throttled_visits(spark, sf_dir):
    """Throttlings in stored crawls, and the delays that follow."""
    pages = crawl.pages(crawls(spark, sf_dir, VISITS))
    visits = pages.select(F.col("crawl_id").alias("site"), "crawl_id", F.col("page_ord").cast("long").alias("seq"), "url", "final_url", "status", "retry_after", "title", screens.main_text().alias("text"))
    return by_page(screens.backed_off(screens.throttled(visits)))


GATE = {"links_after": 1, "text_before": 10, "text_after": 5, "incomplete": False}
NOTE = {"mode": "site", "pages": 3, "max_pages": 100, "max_depth": 3, "stopped_by_user": False, "blocked_reason": "", "delay_sec": 2.0, "start_error": "", "repeated": [], "linked": 1, "from_sitemap": 0,
        "sitemap_urls": 0, "gate": None, "gate_hints": [], "first_links": 5}
NOTES = [
    NOTE, {**NOTE, "blocked_reason": "HTTP 429"}, {**NOTE, "linked": 0}, {**NOTE, "linked": 0, "from_sitemap": 2}, {**NOTE, "linked": 0, "from_sitemap": 1}, {**NOTE, "first_links": 1},
    {**NOTE, "gate": GATE}, {**NOTE, "gate": {**GATE, "incomplete": True}, "gate_hints": ["캡차", "봇 차단"]}, {**NOTE, "start_error": "HTTP 404", "repeated": [{"title": "홈", "count": 4}]},
    {**NOTE, "mode": "list", "linked": 0}, {**NOTE, "gate": {**GATE, "text_after": 50}}, {**NOTE, "pages": 60, "first_links": 0},
]


@case(NOTES, "notes string")
def crawl_notes(spark, sf_dir):
    """Advice on how complete a crawl is."""
    kind = ("struct<mode:string,pages:int,max_pages:int,max_depth:int,stopped_by_user:boolean,blocked_reason:string,delay_sec:double,start_error:string,repeated:array<struct<title:string,count:bigint>>,"
            "linked:int,from_sitemap:int,sitemap_urls:int,gate:struct<links_after:int,text_before:int,text_after:int,incomplete:boolean>,gate_hints:array<string>,first_links:int>")  # fmt: skip
    rows = dealt(spark, sf_dir, [json.dumps(n, ensure_ascii=False) for n in NOTES], "j string")
    rows = rows.select(F.col("page_id").cast("string").alias("crawl_id"), F.from_json("j", kind).alias("c")).select("crawl_id", "c.*")
    return by_page(screens.notes(rows)).withColumn("notes", F.array_join("notes", "\n"))


HREFS = [
    ["/a", "b?x=1#y", "/a", "http://other.kr/", "javascript:x()", "/f.pdf", "/member/logout", "http://sub.p{p}.kr/z"], ["#top", "", "../up", "//www.p{p}.kr/q"], [],
]


def linked_pages(spark, sf_dir):
    """A page of a site for each of the test pages, and its links."""
    rows = dealt(spark, sf_dir, [json.dumps(h) for h in HREFS], "hrefs string")
    site = F.format_string("http://p%d.kr/", "page_id")
    rows = rows.select("page_id", F.col("page_id").cast("string").alias("crawl_id"), site.alias("site"), F.concat(site, F.lit("dir/page")).alias("url"), F.lit("").alias("final_url"), F.from_json("hrefs", "array<string>").alias("hrefs"))
    links = rows.select("crawl_id", "url", F.posexplode("hrefs").alias("ord", "href")).withColumns({"raw_href": F.col("href"), "content": F.when(F.col("ord") == 1, "이용약관").otherwise("글"), "footer": F.lit(False)})
    return rows, links


@case(HREFS, "next string, ord int")
def next_links(spark, sf_dir):
    """Addresses that a crawl would go on to, once each."""
    rows, links = linked_pages(spark, sf_dir)
    return frontier.next_links(rows, links.select("url", "ord", "href")).join(rows.select("url", "page_id"), "url")


@case(HREFS, "next string")
def content_links(spark, sf_dir):
    """Where links of the content lead, without those that stand on every page."""
    return by_page(frontier.content_links(*linked_pages(spark, sf_dir)))


@case(HREFS, "url string, depth int, found_on string, k int")
def planned_frontier(spark, sf_dir):
    """Seeds, listed addresses and links together, each where it was first found; the first five are planned."""
    rows, links = linked_pages(spark, sf_dir)
    seeds = rows.select("site", F.col("site").alias("url"), F.lit(0).alias("ord"))
    listed = rows.select("site", F.posexplode(F.array(F.concat("site", F.lit("a")), F.concat("site", F.lit("s.pdf")), F.lit("http://other.kr/"), F.concat("site", F.lit("listed")))).alias("ord", "url"))
    linked = frontier.next_links(rows, links.select("url", "ord", "href")).join(rows.select("url", "site"), "url")
    merged = frontier.merged(seeds, listed, linked.select("site", F.col("next").alias("url"), F.col("url").alias("found_on"), F.lit(1).alias("depth"), "ord"))
    planned = frontier.planned(merged.select("site", "url", "depth", "ord"), 5)
    return planned.join(merged.select("site", "url", "found_on"), ["site", "url"]).join(rows.select("site", "page_id"), "site")


@case(HREFS, "linked int, fresh string, titled string, refused string")
def crawl_joins(spark, sf_dir):
    """Pages that content links lead to, links that are new, listed titles, addresses that robots.txt refuses."""
    rows, links = linked_pages(spark, sf_dir)
    found = frontier.content_links(rows, links)
    pages = rows.select("crawl_id", F.posexplode(F.array("url", F.concat("site", F.lit("a")), F.concat("site", F.lit("zz")), F.concat("site", F.lit("dir/b?x=1")))).alias("page_ord", "url"), F.lit("").alias("final_url"))
    linked = frontier.content_linked(pages, found).groupBy("crawl_id").agg(F.count("*").alias("linked"))
    after, own = found.select("crawl_id", F.col("next").alias("url")), rows.select("crawl_id", F.concat("site", F.lit("up")).alias("url"))
    fresh = frontier.new_links(after, pages.where("page_ord = 1"), own).groupBy("crawl_id").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("fresh"))
    names = rows.select("crawl_id", F.posexplode(F.array(F.lit(""), F.lit("첫 글"), F.lit("둘째"))).alias("ord", "title"), F.concat("site", F.lit("a#x")).alias("url"))
    titled = frontier.titled(pages, names).where("listed_title <> ''").groupBy("crawl_id").agg(F.max(F.concat_ws("=", "url", "listed_title")).alias("titled"))
    robots = rows.select("site", F.when(F.pmod("page_id", F.lit(len(HREFS))) != 1, "User-agent: *\nDisallow: /dir/").alias("robots"))
    refused = frontier.skipped(pages.join(rows.select("crawl_id", "site"), "crawl_id").select("site", "url"), robots).groupBy("site").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("refused"))
    every = rows.select("page_id", "crawl_id", "site").join(linked, "crawl_id", "left").join(fresh, "crawl_id", "left").join(titled, "crawl_id", "left").join(refused, "site", "left")
    return every.select("page_id", F.coalesce("linked", F.lit(0)).alias("linked"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("fresh", "titled", "refused")])


def xml(body):
    return f'<?xml version="1.0" encoding="UTF-8"?>{body}'.encode()


SPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
URLSET = xml(f"<urlset {SPACE}><url><loc>http://a.kr/1</loc></url><url><loc> /2 </loc></url><url><loc>ftp://x</loc></url></urlset>")
DOCUMENTS = [
    xml(f"<sitemapindex {SPACE}><sitemap><loc>/s1.xml</loc></sitemap><sitemap><loc>http://a.kr/i.xml</loc></sitemap></sitemapindex>"), URLSET, gzip.compress(URLSET, mtime=0),
    xml('<rss><channel><item><title>제목</title><link>http://a.kr/2</link></item><item><guid isPermaLink="false">x</guid></item><item><guid>http://a.kr/3</guid></item></channel></rss>'),
    xml('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link rel="self" href="/no"/><link href="/4"/></entry></feed>'), b"<html/>", b"no xml", b"\x1f\x8bbroken", b"",
]


@case(DOCUMENTS, "kind string, items string, children string")
def sitemap_documents(spark, sf_dir):
    """Sitemaps, indexes and feeds, plain or packed; and what is none of these."""
    rows = dealt(spark, sf_dir, DOCUMENTS, "body binary").select("page_id", sitemap.parsed(F.col("body"), F.lit("http://a.kr/x")).alias("p"))
    items = F.array_join(F.transform("p.items", lambda i: F.concat_ws("|", i["url"], i["title"])), " ")
    return rows.select("page_id", "p.kind", items.alias("items"), F.array_join("p.children", " ").alias("children"))


ROBOTS = [
    ("User-agent: *\nDisallow: /secret\nSitemap: /s.xml\nsitemap:http://b.kr/t.xml\nSITEMAP: /s.xml", "http://a.kr/secret/1"), ("User-agent: *\nDisallow: /secret\nAllow: /", "http://a.kr/open"),
    ("User-agent: bad\nDisallow: /", "http://a.kr/x"), ("", "http://a.kr/x"), (None, "http://a.kr/x"), ("User-agent: *\nDisallow: /", "http://a.kr/x"),
]


@case(ROBOTS, "allowed boolean, sitemaps string")
def robots_cases(spark, sf_dir):
    """What robots.txt lets be fetched, and the sitemaps that it names."""
    rows = dealt(spark, sf_dir, ROBOTS, "robots string, url string")
    return rows.select("page_id", sitemap.allowed(F.col("url"), F.col("robots")).alias("allowed"), F.array_join(sitemap.locations(F.col("robots"), F.lit("http://a.kr/")), " ").alias("sitemaps"))


ORIGINS = [
    ("Sitemap: /i.xml", {"/i.xml": DOCUMENTS[0].decode().replace("http://a.kr", "http://p{p}.kr"), "/s1.xml": URLSET.decode().replace("http://a.kr", "http://p{p}.kr"), "/rss": DOCUMENTS[3].decode().replace("http://a.kr", "http://p{p}.kr")}),
    (None, {"/sitemap.xml": URLSET.decode().replace("http://a.kr", "http://p{p}.kr")}), (None, {"/feed": DOCUMENTS[4].decode()}),
]


def discovered(spark, sf_dir):
    rows = dealt(spark, sf_dir, [(r, json.dumps(f)) for r, f in ORIGINS], "robots string, files string").withColumn("origin", F.format_string("http://p%d.kr", "page_id"))
    files = rows.select("origin", F.explode(F.from_json("files", "map<string,string>")).alias("path", "text"))
    bodies = files.select(F.concat("origin", "path").alias("url"), F.encode("text", "UTF-8").alias("body"))
    return rows, *sitemap.discover(bodies, rows.select("origin", "robots"))


@case(ORIGINS, "ord int, url string, title string")
def discovered_pages(spark, sf_dir):
    """Addresses that sitemaps and feeds of a site list, in order, once each."""
    rows, pages, _ = discovered(spark, sf_dir)
    return pages.join(rows.select("origin", "page_id"), "origin")


@case(ORIGINS, "url string, kind string, source string, urls long")
def discovered_files(spark, sf_dir):
    """The sitemaps and feeds of a site, and how many addresses each added."""
    rows, _, sources = discovered(spark, sf_dir)
    return sources.join(rows.select("origin", "page_id"), "origin")


def packed(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


LISTS = [
    "# 주석\nwww.a.kr/x\nhttp://b.kr/\nnot a url\nwww.a.kr/x\n".encode(), "주소,이름\nhttp://c.kr/,가\n\"https://D.kr\",나\n".encode("cp949"), "http://e.kr/?a=1,2\t이름\nhttp://f.kr\t둘\n".encode("utf-16"),
    packed({"other.csv": "http://no.kr/", "pages.csv": "﻿http://yes.kr/,1"}), packed({"a.txt": "nothing here", "b.csv": "http://only.kr/,1"}), b"", "﻿HTTPS://g.kr/Path?q=1#z\nhttp://g.kr:80\n".encode(),
]


@case(LISTS, "ord long, url string")
def url_lists(spark, sf_dir):
    """Distinct addresses of lists in any charset, by commas or tabs, plain or packed."""
    rows = dealt(spark, sf_dir, LISTS, "data binary").select(F.col("page_id").cast("string").alias("name"), "data")
    return url_list.listed(rows).withColumn("page_id", F.col("list").cast("long"))


STYLES = ["display:none", "visibility: hidden", "opacity:0.01", "clip: rect(0, 0, 0, 0)", "position:absolute; left:-9999px", "width:1px;height:1px;overflow:hidden", "text-indent:-9999px", "font-size:0",
          "color:transparent", "color:#fefefe", "color:#fff;background:#fff", "color:#333", "left:-5px;position:relative"]
HTML = [
    *[f'<div style="{s}">숨은 글 <a href="/x">링크</a></div>' for s in STYLES], '<div hidden>a b<iframe src="f.html"></iframe><p>c d</p></div>',
    '<meta http-equiv="Refresh" content="0; url=http://x.kr/"><meta name="Description" content="설명 글"><meta property="og:title" content="제목"><meta name="viewport" content="w">',
    '<ul><li><a href="../a?x=1#y" target="_blank">가 <b>나</b></a></li><li><a href="#"><img src="i.png" alt="그림"></a></li></ul><img src="/k.png" alt="대체 글"><iframe src="//f.kr/" width="1" height="1" title="t"></iframe>',
    '<button onclick="location.href=\'/go\'">이동</button><div data-href="/d">상자</div><footer><a href="/f">끝</a></footer>',
    '<noscript>광고 <a href="http://x.kr/">x</a></noscript><article><h2>글 제목</h2><p>본문 글</p></article>',
    '<div><h3>인기 검색어</h3><ul><li><a href="/1">하나</a></li><li><a href="/2">둘</a></li></ul></div>', '<div id="a"><p>하나<p>둘둘 <span>셋</span></div><div id="b"></div><div id="b">넷 다섯</div>',
    "<table><tr><td>가나<td>다라</table><!-- x", "<title> A  b </title><p>a  b</p><div>c<br>d</div><script>x</script>", "",
]


def html_pages(spark, sf_dir):
    rows = dealt(spark, sf_dir, HTML, "html string").withColumn("url", F.lit("https://www.city.go.kr/board/list"))
    return html.pages_from_html(rows)


@case(HTML, "ord int, type string, selector string, content string, href string, src string, hidden boolean, footer boolean, hidden_reasons string, links string, field string, source string, context_title string, search_widget string")
def html_records(spark, sf_dir):
    """Records of pages: links, hidden elements, frames, images, search engine fields, redirects, texts."""
    rows = html_pages(spark, sf_dir).select("page_id", F.posexplode("elements").alias("ord", "e")).select("page_id", "ord", "e.*")
    rows = rows.withColumns({"hidden_reasons": F.array_join("hidden_reasons", ","), "links": F.array_join("links", " ")})
    return rows.na.fill("")


@case(HTML, "title string, text string")
def html_texts(spark, sf_dir):
    """Titles and visible texts of pages, a line for each block."""
    return html_pages(spark, sf_dir)


MERGES = [([("a", "x"), ("b", "y")], [("a", "x"), ("c", "z")]), ([("a", "x"), ("a", "x")], []), ([], [("q", "w")])]


@case(MERGES, "selector string, content string, elem_ord int")
def merged_records(spark, sf_dir):
    """Records of two extractions of a page, each once."""
    rows = dealt(spark, sf_dir, [(json.dumps(a), json.dumps(b)) for a, b in MERGES], "a string, b string")

    def records(c):
        parts = rows.select("page_id", F.posexplode(F.from_json(c, "array<array<string>>")).alias("elem_ord", "r"))
        return parts.select("page_id", "elem_ord", F.lit("").alias("frame_path"), F.col("r")[0].alias("selector"), F.lit("text").alias("type"), F.col("r")[1].alias("content"), F.lit("").alias("href"), F.lit("").alias("src"))

    return frontier.merged_records(records("a"), records("b"), ["page_id"])


FIRSTS = [
    [(0, "", None), (1, "", 2), (2, "HTTP 404", 1)], [(0, "HTTP 500", None), (1, "", None)], [(0, "", 5)],
]


@case(FIRSTS, "gate int, start_error string")
def crawl_firsts(spark, sf_dir):
    """The first gate that was opened, and why the start page is an error page."""
    rows = dealt(spark, sf_dir, [json.dumps(f) for f in FIRSTS], "j string").select(F.col("page_id").cast("string").alias("crawl_id"), F.explode(F.from_json("j", "array<array<string>>")).alias("r"))
    pages = rows.select("crawl_id", F.col("r")[0].cast("int").alias("page_ord"), F.col("r")[1].alias("error_page"), F.col("r")[2].cast("int").alias("gate"))
    return by_page(frontier.firsts(pages))


SHAPES["streamed_findings"] = len(CRAWLS), "page_ord int, type string, selector string, score int, level string, pattern string"
