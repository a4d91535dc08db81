from pyspark.sql import functions as F

from pagewarden.operators import frontier, screens


def test_error_pages_hints_and_links(value):
    assert value(screens.error_reason(F.col("s"), F.col("t"), F.col("x")), s=404, t="", x="") == "HTTP 404"
    assert value(screens.error_reason(F.col("s"), F.col("t"), F.col("x")), s=200, t="페이지를 찾을 수 없습니다", x="짧은 글").startswith("오류")
    assert value(screens.error_reason(F.col("s"), F.col("t"), F.col("x")), s=200, t="404 공지", x="긴 글" * 500) == ""
    assert value(screens.bot_hints(F.col("t")), t="캡차 확인, 캡차 다시. Checking  your browser") == ["캡차", "Checking your browser"]
    assert value(screens.standing_link(F.lit(False), F.lit("/x"), F.col("t")), t="개인정보 처리방침") is True
    assert value(screens.standing_link(F.lit(None).cast("boolean"), F.lit("/x"), F.col("t")), t="공지") is False


def metrics(spark, before, after):
    kind = "text int, nodes int, height int, hash string, url string"
    return spark.createDataFrame([(before, after)], f"before struct<{kind.replace(' int', ':int').replace(' string', ':string')}>, after struct<{kind.replace(' int', ':int').replace(' string', ':string')}>")


def test_gate_metrics(spark):
    of = lambda b, a: metrics(spark, b, a).select(screens.content_changed(), screens.content_grew(), screens.shrunk()).first()
    assert tuple(of((100, 50, 900, "a", "http://a"), (100, 50, 900, "a", "http://a#x"))) == (False, False, False)
    assert tuple(of((100, 50, 900, "a", "http://a"), (200, 50, 900, "b", "http://a"))) == (True, True, False)
    assert tuple(of((1000, 50, 900, "a", "http://a"), (20, 10, 900, "b", "http://a"))) == (True, False, True)
    assert tuple(of((100, 50, 900, "a", "http://a"), (105, 51, 1100, "b", "http://a"))) == (False, True, False)
    assert of((100, 50, 900, "a", "http://a"), (100, 50, 900, "a", "http://b"))[0] is True


def test_same_screens(spark):
    long = "같은 화면의 글입니다 아주 길게 계속해서 이어집니다 "
    rows = [("c", i, f"http://a.kr/{i}", f"http://a.kr/{i}", "t", long, False) for i in range(3)]
    rows += [("c", i, f"http://a.kr/{i}", f"http://a.kr/{i}", "q", long + "질문", False) for i in (3, 4)]
    rows += [("c", i, f"http://a.kr/{i}", "http://a.kr/login", "m", long + "로그인", False) for i in (5, 6, 7)] + [("c", 8, "http://a.kr/8", None, "s", "짧음", False)]
    pages = spark.createDataFrame(rows, "crawl_id string, page_ord int, url string, final_url string, title string, text string, regated boolean")
    got = {(r.title, r.kind, r["count"]) for r in screens.same_screens(pages).collect()}
    assert got == {("t", "repeated", 3), ("q", "duplicate", 2), ("m", "repeated", 3)}


def visits(spark, rows):
    kind = "site string, seq long, url string, final_url string, status int, retry_after string, title string, text string"
    return spark.createDataFrame([(s, i, "http://a/x", f, c, r, "", t) for s, i, f, c, r, t in rows], kind)


def test_throttling_and_backoff(spark):
    v = visits(spark, [
        ("a", 1, None, 200, None, ""), ("a", 2, None, 429, "7", ""), ("a", 3, None, 403, None, ""), ("a", 4, None, 403, None, ""), ("a", 5, None, 403, None, ""),
        ("a", 6, None, 503, "100", ""), ("b", 1, "http://a/busy", 200, None, "잠시 후 다시 시도"), ("b", 2, "http://a/x", 200, None, "잠시 후 다시 시도"), ("b", 3, None, 503, None, ""),
    ])
    reasons = {(r.site, r.seq): r.reason for r in screens.throttled(v).collect()}
    assert [bool(reasons["a", i]) for i in range(1, 7)] == [False, True, False, False, True, True]
    assert [bool(reasons["b", i]) for i in (1, 2, 3)] == [True, False, False]
    got = [(r.site, r.seq, r.delay_sec, r.wait_sec, r.stops) for r in screens.backed_off(screens.throttled(v)).orderBy("site", "seq").collect()]
    assert got == [("a", 2, 2.0, 7.0, False), ("a", 5, 4.0, 4.0, False), ("a", 6, 8.0, 60.0, False), ("b", 1, 2.0, 2.0, False)]


def test_reachable_ends_in_circles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "url string, next string")
    got = {r.url: r.depth for r in frontier.reachable(spark.createDataFrame([("a",)], "url string"), edges, 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_next_links_and_plans(spark):
    pages = spark.createDataFrame([("http://a.kr/x/", None, "http://www.a.kr/")], "url string, final_url string, site string")
    hrefs = ["y", "../z?p=1", "y#top", "file.pdf", "/logout", "http://other.kr/", "http://sub.a.kr/", "javascript:x"]
    links = spark.createDataFrame([("http://a.kr/x/", i, h) for i, h in enumerate(hrefs)], "url string, ord int, href string")
    assert [r.next for r in frontier.next_links(pages, links).orderBy("ord").collect()] == ["http://a.kr/x/y", "http://a.kr/z?p=1", "http://sub.a.kr/"]
    found = spark.createDataFrame([("s", "b", 1, 5), ("s", "a", 0, 9), ("s", "b", 2, 0), ("s", "c", 1, 6)], "site string, url string, depth int, ord int")
    assert [(r.url, r.k) for r in frontier.planned(found, 2).orderBy("k").collect()] == [("a", 1), ("b", 2)]


def test_merged_records_keep_the_first(spark):
    kind = "page int, frame_path array<string>, selector string, type string, content string, href string, src string, elem_ord int"
    old = spark.createDataFrame([(1, [], "a", "link", "x", "h", None, 0)], kind)
    new = spark.createDataFrame([(1, [], "a", "link", "x", "h", None, 5), (1, [], "b", "link", "x", "h", None, 6)], kind)
    assert sorted((r.selector, r.elem_ord) for r in frontier.merged_records(old, new, ["page"]).collect()) == [("a", 0), ("b", 6)]


def test_notes(spark):
    kind = (
        "crawl_id string, mode string, pages int, max_pages int, max_depth int, stopped_by_user boolean, blocked_reason string, delay_sec double, start_error string,"
        "repeated array<struct<title:string,count:bigint>>, linked int, from_sitemap int, sitemap_urls int,"
        "gate struct<links_after:int,text_before:int,text_after:int,incomplete:boolean>, gate_hints array<string>, first_links int"
    )
    base = ["x", "site", 1, 30, 3, False, "", 1.0, "", None, 0, 0, 0, None, [], 0]
    change = lambda **c: tuple(c.get(n.split()[0], v) for n, v in zip(NAMES, base))
    NAMES = ["crawl_id", "mode", "pages", "max_pages", "max_depth", "stopped_by_user", "blocked_reason", "delay_sec", "start_error", "repeated", "linked", "from_sitemap", "sitemap_urls", "gate", "gate_hints", "first_links"]
    rows = [
        change(crawl_id="few"), change(crawl_id="fine", pages=29, linked=3), change(crawl_id="blocked", blocked_reason="HTTP 429"),
        change(crawl_id="standing", pages=4, from_sitemap=3), change(crawl_id="list", mode="list"), change(crawl_id="repeated", pages=29, linked=1, repeated=[("t", 3)]),
        change(crawl_id="gate", gate=(1, 5, 5, True), gate_hints=["캡차"]), change(crawl_id="start", start_error="HTTP 404", first_links=9),
    ]
    got = {r.crawl_id: r.notes for r in screens.notes(spark.createDataFrame(rows, kind)).collect()}
    assert [len(got[k]) for k in ("few", "fine", "blocked", "standing", "list", "repeated", "gate", "start")] == [1, 0, 1, 1, 0, 1, 2, 1]
    assert got["standing"][0].startswith("sitemap.xml에 있는 주소로만 4페이지")
