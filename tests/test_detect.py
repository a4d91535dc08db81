import json

import pytest

from pagewarden.operators import sidereports
from pagewarden.operators.evidence import Settings
from pagewarden.plans import detect
from pagewarden.sources import crawl, exports

SITE = "https://www.city.go.kr/"


def rec(type_, content, selector="div", **more):
    return {"type": type_, "content": content, "selector": selector, "frame_path": [], "frame_url": SITE, **more}


def page(*elements, url=SITE + "a", **more):
    return {"url": url, "final_url": more.pop("final_url", url), "elements": list(elements), **more}


def crawl_of(*pages, **meta):
    return {"meta": {"start_url": SITE, "seed_urls": [SITE], "started_at": "2024-01-01T00:00:00", "finished_at": "2024-01-01T00:01:30", **meta}, "pages": list(pages),
            "skipped": meta.pop("skipped", [])}


OBFUSCATED = rec("link", "바.카.라 추천", "#s1", href="http://ads.invalid/", hidden=True)
STUFFED = "\n".join(["카지노 바카라 먹튀 토토사이트"] * 8)
CRAWLS = {
    "hidden": crawl_of(
        page(rec("hidden", "바카라 텔레그램 @win7777", "div.x", links=["http://win-toto.invalid/"], hidden_reasons=["display:none"]),
             rec("link", "바카라", "div.x > a", href="http://win-toto.invalid/", hidden=True)),
        page(rec("hidden", "바카라 텔레그램 @win7777", "div.x", links=["http://win-toto.invalid/"], hidden_reasons=["display:none"]), url=SITE + "b"),
    ),
    "paragraph": crawl_of(page(rec("text", "먹튀 없는 놀이터", "#p"), rec("link", "가기", "#p > a", href="http://bet365.invalid/"))),
    "link": crawl_of(page(rec("link", "바로가기", "#l", href="http://my-toto.invalid/"))),
    "alone": crawl_of(page(rec("text", "카지노", "#t"), rec("text", "안내문", "#u"))),
    "prevention": crawl_of(page(rec("text", "도박 중독 예방: 카지노 바카라 먹튀", "#t"))),
    "prevention_contact": crawl_of(page(rec("text", "먹튀 예방 카지노 텔레그램 @win7777", "#t"))),
    "surface": crawl_of(page(rec("text", "'카지노' 검색 결과", "#t"), url=SITE + "s?q=카지노")),
    "reflected": crawl_of(page(rec("text", "카지노 바카라 추천", "#t"), url=SITE + "s?q=카지노 바카라")),
    "frame": crawl_of(page(rec("iframe", "", "#f", src=SITE + "f", hidden=True), rec("text", "먹튀 검증 안내", "#t", frame_path=["#f"]), rec("text", "먹튀 검증 안내", "#t2"))),
    "child": crawl_of(page(rec("text", "카지노 먹튀", "#a", links=["http://x.invalid/"]), rec("hidden", "바카라 카지노 먹튀", "#a > b", links=["http://bet.invalid/"]))),
    "redirect": crawl_of(page(url=SITE + "r", final_url="http://evil-casino.invalid/", offsite_redirect=True)),
    "refresh": crawl_of(page(rec("redirect", "0; url='http://slot-king.invalid/'", "meta"))),
    "search": crawl_of(page(rec("link", "먹튀", "#k", href=SITE + "q", search_widget="인기 검색어"))),
    "meta": crawl_of(page(rec("meta", "카지노 바카라", 'meta[name="keywords"]', field="keywords"))),
    "stuffing": crawl_of(page(rec("text", "카지노 바카라", "#t"), frames=[{"is_main": True, "title": "글", "frame_url": SITE, "text": STUFFED, "frame_path": []}])),
    "trusted": crawl_of(page(rec("link", "casino", "#y", href="https://www.youtube.com/watch"))),
    "spot": crawl_of(page(OBFUSCATED, rec("text", "바.카.라 추천", "#s1"))),
    "cloaking": crawl_of(page(cloaking={"profiles": [
        {"key": "pc", "label": "일반 PC", "title": "안내", "text": "시청 안내", "links": [], "redirects": [], "hidden": []},
        {"key": "googlebot", "label": "구글봇", "only_in": "구글봇에게만", "title": "카지노", "text": "바카라 먹튀\n시청 안내", "links": ["http://casino.invalid/"], "redirects": [], "hidden": []},
        {"key": "mobile", "label": "모바일", "only_in": "모바일에서만", "title": "안내", "text": "시청 안내 그리고 더 긴 글", "links": [], "redirects": [], "hidden": []},
    ]})),
    "seeds": crawl_of(page(rec("link", "casino", "#z", href="http://other.kr/x")), seed_urls=[SITE, "http://other.kr/"]),
}


@pytest.fixture(scope="module")
def crawls(spark):
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in CRAWLS.items()], "k string, j string")
    return crawl.from_json(rows, "k", "j")


@pytest.fixture(scope="module")
def found(crawls):
    grouped = detect.grouped(detect.page_findings(crawls))
    out = {k: [] for k in CRAWLS}
    for r in grouped.orderBy("crawl_id", "id").collect():
        out[r.crawl_id].append(r.asDict(recursive=True))
    return out


def kinds(finding):
    return {e["kind"] for e in finding["evidence"]}


def test_hidden_ad_on_two_pages_is_one_finding_without_its_child(found):
    (f,) = found["hidden"]
    assert (f["level"], f["score"], f["pattern"], f["page_count"], f["type"]) == ("high", 11, "hidden", 2, "hidden")
    assert kinds(f) == {"keyword", "domain", "hidden", "external", "contact"} and f["location_label"] == "2개 페이지에서 발견"


def test_text_takes_the_links_inside(found):
    (f,) = found["paragraph"]
    assert f["selector"] == "#p" and f["urls"] == ["http://bet365.invalid/"] and f["category"] == "도박" and f["level"] == "high"


def test_levels_and_thresholds(found):
    assert [(f["level"], f["score"]) for f in found["link"]] == [("suspect", 4)]
    assert found["alone"] == [] and found["trusted"] == []


def test_prevention_excuses_only_without_contact(found):
    assert found["prevention"] == []
    assert found["prevention_contact"][0]["level"] == "high"


def test_reflection_surface_and_advertisement(found):
    (s,) = found["surface"]
    assert (s["pattern"], s["level"], s["reflected_params"]) == ("reflection_surface", "suspect", [{"name": "q", "value": "카지노"}])
    (r,) = found["reflected"]
    assert (r["pattern"], r["level"]) == ("param_reflection", "high")


def test_hidden_frame_counts_for_what_is_inside(found):
    (f,) = found["frame"]
    assert f["selector"] == "#t" and any(e["label"] == "숨겨진 iframe 내부" for e in f["evidence"])


def test_stronger_child_survives_its_wrapper(found):
    assert [f["selector"] for f in found["child"]] == ["#a > b"]


def test_redirects(found):
    (f,) = found["redirect"]
    assert (f["type"], f["pattern"], f["score"], f["category"]) == ("page_redirect", "redirect", 4, "도박")
    (g,) = found["refresh"]
    assert g["pattern"] == "redirect" and g["urls"] == ["http://slot-king.invalid/"] and kinds(g) == {"domain", "redirect", "external"}


def test_search_lists_and_search_engine_fields(found):
    assert [(f["pattern"], f["score"]) for f in found["search"]] == [("search_list", 5)]
    assert found["meta"][0]["evidence"][-1]["label"] == "검색엔진용 정보(keywords)에만 들어 있음"


def test_stuffing_takes_in_visible_words(found):
    (f,) = found["stuffing"]
    assert f["pattern"] == "stuffing" and f["score"] == 7
    assert (f["stuffing"]["count"], f["stuffing"]["kinds"], f["stuffing"]["list_lines"], f["stuffing"]["merged"]) == (32, 4, 8, 1)


def test_one_finding_per_place_prefers_the_stronger(found):
    (f,) = found["spot"]
    assert f["type"] == "link"


def test_cloaking_is_told_by_profile(found):
    (f,) = found["cloaking"]
    assert f["pattern_label"] == "클로킹(구글봇)" and f["cloaking"]["new_keywords"] == ["카지노", "바카라", "먹튀"] and f["cloaking"]["new_hosts"] == ["casino.invalid"]
    assert f["content"] == "카지노" and f["level"] == "high"


def test_all_seeds_are_inside(found):
    assert found["seeds"] == []


def test_thresholds_only_take_away(crawls):
    strict = detect.page_findings(crawls, Settings(suspect_score=6, high_score=8)).select("crawl_id", "selector", "type").distinct()
    loose = detect.page_findings(crawls, Settings(suspect_score=3)).select("crawl_id").distinct()
    assert strict.select("crawl_id").distinct().join(loose, "crawl_id", "left_anti").count() == 0


def test_partitions_don_t_matter(crawls, found):
    again = detect.grouped(detect.page_findings(crawls.repartition(7)))
    assert sorted((r.crawl_id, r.id, r.content) for r in again.collect()) == sorted((k, f["id"], f["content"]) for k, fs in found.items() for f in fs)


SIDE = crawl_of(
    page(error="timeout", url=SITE + "1"),
    page(error_page="HTTP 404", url=SITE + "2", frames=[{"is_main": True, "frame_path": [], "frame_url": SITE + "2", "scanned": 5, "total_elements": 9}]),
    page(url=SITE + "3", frames=[
        {"is_main": True, "frame_path": [], "frame_url": SITE + "3", "scanned": 7, "total_elements": 7},
        {"is_main": False, "loaded": False, "frame_path": ["#f"], "error": "x"}, {"is_main": False, "frame_path": ["#g"], "frame_url": "http://g.kr/", "scanned": 2}],
        elements=None) | {"elements": [rec("iframe", "", "#f", src="http://f.kr/")]},
    page(url=SITE + "4", frames=[{"is_main": False, "loaded": False, "frame_path": ["#f"], "frame_url": "http://f.kr/", "error": "y"}],
         frames_skipped=[{"frame_url": "http://h.kr/", "reason": "too many"}]),
    repeated_screens=[{"title": "", "count": 3, "urls": [SITE + "x", SITE + "y", SITE + "z"]}], duplicate_screens=[{"title": "t", "count": 3, "urls": []}],
) | {"skipped": [{"url": SITE + "secret", "reason": "robots"}]}


def test_side_reports_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([("c", json.dumps({**CRAWLS["hidden"], "skipped": SIDE["skipped"]})), ("d", json.dumps(SIDE))], "k string, j string")
    crawls = crawl.from_json(rows, "k", "j")
    areas = sidereports.unchecked(crawls)
    got = {(r.kind, r.url): (r.page_count, r.reason) for r in areas.where("crawl_id = 'd'").collect()}
    assert got[("iframe", "http://f.kr/")][0] == 2 and got[("robots", SITE + "secret")][0] == 1
    assert got[("page", SITE + "1")][1] == "페이지를 열지 못함: timeout" and ("page", SITE + "y") in got and ("page", SITE + "x") not in got
    assert "요소 9개 중 5개" in [r.reason for r in areas.where("kind = 'page'").collect() if "일부만" in r.reason][0]
    s = sidereports.stats(crawls, areas).where("crawl_id = 'd'").first()
    assert (s.pages, s.page_errors, s.frames, s.iframes, s.elements_scanned, s.duplicate_pages, s.duration_sec, s.unchecked) == (4, 1, 5, 1, 14, 2, 90, len(got) + 1)
    report = exports.report(crawls, "c")
    assert report["summary"]["high"] == 1 and report["findings"][0]["pages"] == [SITE + "a", SITE + "b"]
    assert report["external_domains"] == [{"host": "win-toto.invalid", "count": 3, "whitelisted": False}]
    assert json.loads(exports.to_json(report))["summary"]["by_pattern"] == {"숨김 광고": 1}
    data = exports.to_csv(report)
    assert data.startswith(b"\xef\xbb\xbf") and "번호,판정" in data.decode("utf-8-sig") and "(+3)" in data.decode("utf-8-sig")
    report["findings"][0]["content"] = "<script>"
    page_text = exports.to_html(report)
    assert "<script>" not in page_text and "&lt;script&gt;" in page_text
    assert exports.to_console(report)[-1] == "외부 도메인: win-toto.invalid"


def test_texts_for_durations(spark):
    rows = spark.createDataFrame([(5, 0, 5, 1.0), (30, 37, 1200, 111.0), (1000, 1, 3601, 1.0)], "n int, done int, total int, elapsed double")
    found = rows.orderBy("n").select(exports.estimate(rows.n).alias("e"), exports.remaining(rows.done, rows.total, rows.elapsed).alias("r")).collect()
    assert [r.e for r in found] == ["1분 이내", "약 2분", "약 1시간 23분"]
    assert [r.r for r in found] == ["", " · 남은 시간 약 58분 9초", " · 남은 시간 약 1시간"]


def test_empty_crawl(spark):
    rows = spark.createDataFrame([("e", json.dumps({"meta": {}, "pages": []}))], "k string, j string")
    assert detect.page_findings(crawl.from_json(rows, "k", "j")).count() == 0
