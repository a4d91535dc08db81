import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewarden.sources import html, sitemap, url_list

BASE = "https://www.city.go.kr/board/list"


def records(body, head="", **only):
    found = html.extract(f"<html><head><title> A  b </title>{head}</head><body>{body}</body></html>", BASE)[2]
    return [r for r in found if all(r.get(k) == v for k, v in only.items())]


@pytest.mark.parametrize(
    "style,reason",
    [
        ("display:none", "display:none"), ("visibility: hidden", "visibility:hidden"), ("opacity:0.01", "opacity:0"), ("clip: rect(0, 0, 0, 0)", "clip"),
        ("position:absolute; left:-9999px", "off-screen"), ("width:1px;height:1px;overflow:hidden", "zero-size"), ("text-indent:-9999px", "text-indent"),
        ("font-size:0", "tiny-font"), ("color:transparent", "transparent-text"), ("color:#fefefe", "same-color-as-background"),
        ("color:#fff;background:#fff", "same-color-as-background"),
    ],
)
def test_inline_hiding(style, reason):
    (r,) = records(f'<div style="{style}">숨은 글 <a href="/x">링크</a></div>', type="hidden")
    assert r["hidden_reasons"] == [reason] and r["content"] == "숨은 글 링크" and r["links"] == ["https://www.city.go.kr/x"]
    assert [x["hidden"] for x in records(f'<div style="{style}">t <a href="/x">링크</a></div>', type="link")] == [True]


@pytest.mark.parametrize("style", ["color:#333", "opacity:.9", "left:-5px;position:relative", "font-size:12px", "color:#fff;background:#000", "background:url(x.png);color:#fff"])
def test_visible_styles(style):
    assert records(f'<div style="{style}">보이는 글</div>', type="hidden") == []
    assert [r["content"] for r in records(f'<div style="{style}">보이는 글</div>', type="text")] == ["보이는 글"]


def test_hidden_attribute_and_what_is_inside():
    got = records('<div hidden>a b<iframe src="f.html"></iframe><p>c d</p></div>')
    assert [(r["type"], r.get("hidden_reasons")) for r in got] == [("hidden", ["display:none"]), ("iframe", ["inside-hidden-element"])]


def test_head_records():
    head = '<meta http-equiv="Refresh" content="0; url=http://x.kr/"><meta name="Description" content="설명 글"><meta property="og:title" content="제목"><meta name="viewport" content="w">'
    got = [(r["type"], r["selector"], r["content"]) for r in records("", head)]
    assert got[0][0] == "redirect" and got[0][2] == "0; url=http://x.kr/"
    assert got[1:] == [("meta", 'meta[name="description"]', "설명 글"), ("meta", 'meta[property="og:title"]', "제목")]


def test_links_frames_images_and_navigation():
    body = (
        '<ul><li><a href="../a?x=1#y" target="_blank">가 <b>나</b></a></li><li><a href="#"><img src="i.png" alt="그림"></a></li></ul>'
        '<img src="/k.png" alt="대체 글"><iframe src="//f.kr/" width="1" height="1" title="t"></iframe><button onclick="location.href=\'/go\'">이동</button>'
        '<div data-href="/d">상자</div><footer><a href="/f">끝</a></footer>'
    )
    links = records(body, type="link")
    assert [(x["href"].removeprefix("https://www.city.go.kr"), x["content"], x["footer"]) for x in links] == [
        ("/a?x=1#y", "가 나", False), ("/board/list", "그림", False), ("/go", "이동", False), ("/d", "상자", False), ("/f", "끝", True),
    ]
    assert links[0]["selector"] == "html > body > ul > li:nth-of-type(1) > a"
    assert [r["content"] for r in records(body, type="alt")] == ["대체 글"]
    assert [(r["src"], r["hidden_reasons"]) for r in records(body, type="iframe")] == [("https://f.kr/", ["tiny-size"])]


def test_noscript_context_and_search_lists():
    body = (
        '<noscript>광고 <a href="http://x.kr/">x</a></noscript><article><h2>글 제목</h2><p>본문 글</p></article>'
        '<div><h3>인기 검색어</h3><ul><li><a href="/1">하나</a></li><li><a href="/2">둘</a></li></ul></div>'
    )
    assert [(r["content"], r["links"]) for r in records(body, type="noscript")] == [("광고 x", ["http://x.kr/"])]
    assert [r["context_title"] for r in records(body, type="text", content="본문 글")] == ["글 제목"]
    assert {r["content"]: r.get("search_widget") for r in records(body, type="link")} == {"하나": "인기 검색어", "둘": "인기 검색어"}


def test_selectors_texts_and_limits():
    body = '<div id="a"><p>하나<p>둘둘 <span>셋</span></div><div id="b"></div><div id="b">넷 다섯</div>' + "<p>" + "가" * 600
    texts = records(body, type="text")
    assert [t["selector"] for t in texts][:3] == ["#a > p:nth-of-type(1)", "#a > p:nth-of-type(2)", "html > body > div:nth-of-type(3)"]
    assert texts[1]["content"] == "둘둘 셋" and len(texts[-1]["content"]) == 600
    assert len([t for t in html.extract(body, BASE, html.PARITY)[2] if t["type"] == "text"][-1]["content"]) == 501
    page = "<p>ab</p>" * 4000 + '<div style="display:none">x</div>'
    many, bounded = html.extract(page, BASE)[2], html.extract(page, BASE, html.PARITY)[2]
    assert [sum(r["type"] == "text" for r in x) for x in (many, bounded)] == [4000, 3000] and sum(r["type"] == "hidden" for r in bounded) == 1


@pytest.mark.parametrize("page,n", [("<div>" * 100_000 + "x y", 1), ("<p>ab</p>" * 50_000, 50_000), ("<div>" * 50_000 + "</span>" * 50_000, 0), ("<div>a b" * 2000, 2000)])
def test_deep_and_wide_pages(page, n):
    assert len(html.extract(page, BASE)[2]) == n


@pytest.mark.parametrize("text", [None, "", "<", "<div", "</p></div>", "<b><i>x</b></i>", "<table><tr><td>a<td>b</table>", "<!-- x", "<script>var a='<p>'</script>"])
def test_broken_html(text):
    title, page_text, found = html.extract(text, None)
    assert isinstance(found, list) and title == ""


def test_page_text():
    assert html.extract("<title>t</title><p>a  b</p><div>c<br>d</div><script>x</script><div style='display:none'>no</div>", BASE)[1] == "a b\nc\nd"


def test_table_of_pages(spark):
    rows = spark.createDataFrame([(1, BASE, "<p>글 하나"), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.pages_from_html(rows).collect()}
    assert got[1].elements[0].content == "글 하나" and got[1].elements[0].frame_url == BASE and got[2].elements == []


def test_url_lists(spark, tmp_path):
    lists = {
        "a.txt": "# 주석\nwww.a.kr/x\nhttp://b.kr/\nnot a url\nwww.a.kr/x\n".encode(), "b.csv": "주소,이름\nhttp://c.kr/,가\n\"https://D.kr\",나\n".encode("cp949"),
        "c.tsv": "http://e.kr/?a=1,2\t이름\nhttp://f.kr\t둘\n".encode("utf-16"),
    }
    for name, data in lists.items():
        (tmp_path / name).write_bytes(data)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("other.csv", "http://no.kr/")
        z.writestr("pages.csv", "﻿http://yes.kr/,1")
    (tmp_path / "d.zip").write_bytes(packed.getvalue())
    got = {}
    for r in url_list.read(spark, str(tmp_path)).orderBy("list", "ord").collect():
        got.setdefault(r.list[-5:], []).append(r.url)
    assert got == {
        "a.txt": ["http://www.a.kr/x", "http://b.kr/"], "b.csv": ["http://c.kr/", "https://d.kr/"], "c.tsv": ["http://e.kr/?a=1,2", "http://f.kr/"], "d.zip": ["http://yes.kr/"],
    }


def xml(body):
    return f'<?xml version="1.0" encoding="UTF-8"?>{body}'.encode()


INDEX = xml('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>/s1.xml</loc></sitemap><sitemap><loc>http://a.kr/i.xml</loc></sitemap></sitemapindex>')
URLS = xml('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://a.kr/1</loc></url><url><loc> /2 </loc></url><url><loc>ftp://x</loc></url></urlset>')
RSS = xml('<rss><channel><item><title>제목</title><link>http://a.kr/2</link></item><item><guid isPermaLink="false">x</guid></item><item><guid>http://a.kr/3</guid></item></channel></rss>')
ATOM = xml('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link rel="self" href="/no"/><link href="/4"/></entry></feed>')


def test_documents():
    parse = lambda b: sitemap.parse(b, "http://a.kr/x")
    assert parse(INDEX)["children"] == ["http://a.kr/s1.xml", "http://a.kr/i.xml"]
    assert [i["url"] for i in parse(gzip.compress(URLS))["items"]] == ["http://a.kr/1", "http://a.kr/2"]
    assert [(i["url"], i["title"]) for i in parse(RSS)["items"]] == [("http://a.kr/2", "제목"), ("http://a.kr/3", "")]
    assert parse(ATOM)["items"] == [{"url": "http://a.kr/4", "title": "t"}] and parse(ATOM)["kind"] == "atom"
    assert [parse(b)["kind"] for b in (b"<html/>", b"no xml", None, b"\x1f\x8bbroken")] == ["", "", "", ""]


def test_indexes_of_any_depth(spark):
    index = lambda k: xml(f"<sitemapindex><sitemap><loc>http://a.kr/i{k}.xml</loc></sitemap></sitemapindex>")
    files = [("http://a.kr/sitemap.xml", index(1)), *[(f"http://a.kr/i{k}.xml", index(k + 1)) for k in range(1, 8)], ("http://a.kr/i8.xml", URLS)]
    bodies = spark.createDataFrame([(u, bytearray(b)) for u, b in files], "url string, body binary")
    pages, sources = sitemap.discover(bodies, spark.createDataFrame([("http://a.kr", None)], "origin string, robots string"))
    assert pages.count() == 2 and sources.count() == 9


def test_discovery_follows_indexes_without_circles(spark):
    bodies = spark.createDataFrame(
        [("http://a.kr/i.xml", bytearray(INDEX)), ("http://a.kr/s1.xml", bytearray(URLS)), ("http://a.kr/rss", bytearray(RSS))], "url string, body binary"
    )
    origins = spark.createDataFrame([("http://a.kr", "User-agent: *\nSITEMAP: /i.xml\nDisallow: /secret\n")], "origin string, robots string")
    pages, sources = sitemap.discover(bodies, origins)
    assert [(r.url, r.title) for r in pages.orderBy("ord").collect()] == [("http://a.kr/1", ""), ("http://a.kr/2", "제목"), ("http://a.kr/3", "")]
    assert {(r.url, r.kind, r.source, r.urls) for r in sources.collect()} == {
        ("http://a.kr/i.xml", "sitemap", "robots.txt", 0), ("http://a.kr/s1.xml", "sitemap", "robots.txt", 2), ("http://a.kr/rss", "rss", "자동 탐색", 1),
    }
    asked = origins.select(F.explode(F.array(F.lit("http://a.kr/secret/x"), F.lit("http://a.kr/open"))).alias("u"), "robots")
    assert [r.a for r in asked.select("u", sitemap.allowed(F.col("u"), F.col("robots")).alias("a")).orderBy("u").collect()] == [True, False]


def test_source_title_reads_the_references_of_markup_only(spark):
    import duckdb

    from pagewarden.plans import catalog

    heads = ["a &quot;b&quot;", "a &amp;amp; &amp", "&lt;i&gt;&amp;lt;", " a\t b\n\x0b c\f ", "x y", ""]
    pages = [(k, f"<html><title>{t}</title><p>&quot;</p>") for k, t in enumerate(heads)] + [(10, "<title>a<b></title>"), (11, "<TITLE>a</TITLE>"), (12, ""), (13, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    found = spark.createDataFrame(pages, "page_id long, html string").select("page_id", html.source_title("html").alias("title"))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalog.ORACLE_SQL["html_title"]).fetchall())
    assert html.extract("<title>a &quot;b&quot; &amp</title>", None)[0] == 'a "b" &'


def test_html_title_of_larger_table(spark):
    import duckdb

    from pagewarden.plans import catalog

    data = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{data}/pages.parquet')")
    assert sorted(map(tuple, catalog.QUERIES["html_title"](spark, data).collect())) == sorted(con.execute(catalog.ORACLE_SQL["html_title"]).fetchall())
