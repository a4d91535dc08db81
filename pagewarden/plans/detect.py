"""Detection: crawl documents in, findings and side reports out.

The plan: pages are exploded into elements that carry what they need of their page; evidence is put together
row by row; rows with enough of it become findings; page-level detectors add theirs; findings of one page
are reduced by place and by containment; what is left is grouped over the pages of a crawl.
Shuffles: one by page for links below an element and one for the reduction, then one by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.functions import contacts, domains, matching, reflection, urls
from pagewarden.operators import cloaking, stuffing
from pagewarden.operators.evidence import (
    EVIDENCE, POINTS, SURFACE, SUSPECT, VOTES, Settings, advice, enough, ev, external, from_hits, gathered, has, labels, one, only, rated, untrusted,
    votes_of,
)
from pagewarden.plans.shared import stored
from pagewarden.sources import crawl
from pagewarden.sources.batches import bounded_batches

MAX_CHILD_LINKS = 20
# Kinds of elements that can be excused as prevention, and where text is out of sight by its kind.
EXCUSABLE = ("text", "title", "link", "meta", "alt")
OUT_OF_SIGHT = {
    "meta": ("검색엔진용 정보(", ")에만 들어 있음"), "alt": ("이미지 대체 텍스트(alt)에 들어 있음", None), "noscript": ("noscript 안(스크립트가 꺼진 환경·검색엔진에만 보임)", None),
}
NO_STRINGS = "array<string>"
PLACE = ["crawl_id", "page_ord"]


def prepared_pages(pages: DataFrame, settings: Settings) -> DataFrame:
    """Pages with the distinct hosts of their crawl's seeds, their parameters, and whether they warn of offences."""
    titles = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("listed_title", F.lit("")))
    frame_places = F.filter("elements", lambda e: (e["type"] == "iframe") & F.coalesce(e["hidden"], F.lit(False)))
    none = F.array().cast(NO_STRINGS)
    return pages.withColumns({
        "seed_hosts": F.array_distinct(F.transform("seeds", urls.host)),
        "page_params": reflection.params(settings.matcher, F.array("url", "final_url")),
        "warns": contacts.prevention(titles),
        "hidden_frames": F.transform(frame_places, lambda e: F.concat(F.coalesce(e["frame_path"], none), F.array(e["selector"]))),
        "final_or_url": F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.col("url")),
    })


def page_elements(pages: DataFrame) -> DataFrame:
    """Elements with what they need of their page."""
    needed = pages.select(
        *PLACE, "url", "title", "listed_title", "seed_hosts", "subdomains", "page_params", "warns", "hidden_frames", "frames", "elements"
    )
    carried = {c: F.col(c) for c in ("seed_hosts", "subdomains", "page_params", "warns", "hidden_frames")}
    page = F.struct(F.col("url").alias("page_url"), F.col("title").alias("page_title"), "listed_title", *[c.alias(n) for n, c in carried.items()])
    rows = crawl.elements(needed.withColumn("_page", page), keep=["_page"])
    return rows.select(*[c for c in rows.columns if c != "_page"], "_page.*").withColumn("urls", element_urls())


def element_urls() -> Column:
    """The addresses of an element, in order."""
    text = F.col("content")
    at = F.instr(F.lower(text), "url=")
    refresh = F.when((F.col("type") == "redirect") & (at > 0), F.trim(F.substring(text, at + 4, F.length(text)), F.lit(" '\"")))
    own = F.array(F.when(F.col("type") == "link", F.col("href")), F.when(F.col("type") == "iframe", F.col("src")), refresh)
    return F.array_distinct(F.filter(F.concat(own, "links"), lambda u: u.isNotNull() & u.startswith("http")))


def with_links_below(elements: DataFrame) -> DataFrame:
    """Text elements with the first visible links inside of them as their own."""
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(F.split("selector", " > ")) - 1), lambda i: F.array_join(F.slice(F.split("selector", " > "), F.lit(1), i), " > ")
    )
    below = elements.where("type = 'link' and href <> '' and not hidden").where(F.size(F.split("selector", " > ")) > 1)
    below = below.select(*PLACE, "frame_path", F.explode(ancestors).alias("selector"), F.struct("elem_ord", "href").alias("link"))
    below = below.groupBy(*PLACE, "frame_path", "selector").agg(F.array_sort(F.collect_list("link")).alias("inner"))
    inner = F.transform(F.slice("inner", 1, MAX_CHILD_LINKS), lambda x: x["href"])
    below = below.select(*PLACE, "frame_path", "selector", F.lit("text").alias("type"), inner.alias("inner"))
    joined = elements.join(below, [*PLACE, "frame_path", "selector", "type"], "left")
    return joined.withColumn("links", F.coalesce("inner", "links")).drop("inner").withColumn("urls", element_urls())


def scored(elements: DataFrame, settings: Settings) -> DataFrame:
    """Elements with their evidence; those without any core evidence, or excused as prevention, are gone."""
    matcher, text = settings.matcher, F.col("content")
    in_frame = reflection.params(matcher, F.when(F.size("frame_path") > 0, F.array("frame_url")))
    rows = elements.withColumns({"hits": matching.hits(matcher, text), "in_frame": in_frame})
    rows = rows.withColumn("foreign", F.filter("urls", lambda u: untrusted(u, settings)))
    named = F.transform("foreign", lambda u: F.struct(urls.host(u).alias("host"), domains.suspicion(urls.host(u)).alias("category")))
    rows = rows.withColumn("bad", F.get(F.filter(named, lambda x: x["category"].isNotNull()), F.lit(0)))
    domain = F.when(F.col("bad").isNotNull(), ev("domain", F.concat(F.lit("의심 도메인: "), F.col("bad.host")), POINTS["domain"]))
    redirect = F.when((F.col("type") == "redirect") & (F.size("foreign") > 0), ev("redirect", "meta refresh 자동 이동", POINTS["redirect"]))
    rows = rows.withColumn("core", gathered(from_hits(F.col("hits")), one(domain), one(redirect)).cast(EVIDENCE)).where(F.size("core") > 0)

    rows = rows.withColumn("contact", contacts.contact(text))
    widget = F.coalesce("search_widget", F.lit(""))
    warned = F.col("warns") | contacts.prevention(text)
    excused = (
        F.col("contact").isNull() & warned & only(F.col("core"), "keyword", "variant") & F.col("type").isin(*EXCUSABLE) & ~F.col("hidden") & (widget == "")
    )
    rows = rows.where(~excused)

    rows = rows.withColumn("params", F.array_distinct(F.concat("page_params", "in_frame")))
    rows = rows.withColumn("reflected", reflection.reflected(F.col("params"), text))
    rows = rows.withColumn("outside", reflection.outside(matcher, text, F.when(F.size("reflected") > 0, F.transform("reflected", lambda p: p["value"]))))

    searched = F.when(widget != "", ev("search_list", F.concat(F.lit("사이트 검색어 목록("), widget, F.lit(")에 올라 있음")), POINTS["search_list"]))
    by_kind = F.coalesce(*[
        F.when(F.col("type") == k, F.concat(F.lit(a), F.coalesce("field", F.lit("")), F.lit(b)) if b else F.lit(a)) for k, (a, b) in OUT_OF_SIGHT.items()
    ])
    reasons = F.array_join("hidden_reasons", ", ")
    concealed = F.when(
        (F.col("type") == "hidden") | F.col("hidden"), F.concat(F.lit("숨김 처리 ("), F.when(reasons == "", "숨김 영역 안").otherwise(reasons), F.lit(")"))
    )
    path_heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size("frame_path"), F.lit(1))), lambda i: F.slice("frame_path", F.lit(1), i))
    framed = F.when(
        (F.size("frame_path") > 0) & F.exists(path_heads, lambda h: F.array_contains("hidden_frames", h)), F.lit("숨겨진 iframe 내부")
    )
    hidden_label = F.coalesce(by_kind, concealed, framed)
    hidden = F.when(hidden_label.isNotNull(), ev("hidden", hidden_label, POINTS["hidden"]))
    foreign_frame = F.coalesce(untrusted(F.col("frame_url"), settings), F.lit(False))
    outward = F.when((F.size("foreign") > 0) | foreign_frame, ev("external", "화이트리스트에 없는 외부 도메인", POINTS["external"]))
    by_telegram = F.col("contact.kind") == "telegram"
    contact_label = F.concat(F.when(by_telegram, "텔레그램 ID 포함 (").otherwise("연락처·메신저 ID 포함 ("), F.col("contact.value"), F.lit(")"))
    reached = F.when(F.col("contact").isNotNull(), ev("contact", contact_label, F.when(by_telegram, POINTS["telegram"]).otherwise(POINTS["contact"])))
    listed = F.array_join(F.transform("reflected", lambda p: F.concat(p["name"], F.lit("="), p["value"])), ", ")
    mirrored = F.when(F.size("reflected") > 0, ev("reflection", F.concat(F.lit("URL 파라미터 반사 ("), listed, F.lit(")")), POINTS["reflection"]))
    before = gathered(F.col("core"), one(searched), one(hidden), one(outward), one(reached)).cast(EVIDENCE)
    surface = (
        (F.size("reflected") > 0)
        & F.forall("reflected", lambda p: urls.search_param(p["name"]))
        & ~has(before, "domain", "hidden", "redirect")
        & (F.col("outside.words") == 0)
        & contacts.contact(F.col("outside.text")).isNull()
        & (F.size(F.array_distinct(F.flatten(F.transform("reflected", lambda p: p["words"])))) < 2)
        & ~F.exists("reflected", lambda p: contacts.contact(p["value"]).isNotNull())
    )
    by_domain = F.when(F.col("bad").isNotNull(), F.struct(F.col("bad.category").alias("category"), F.lit(POINTS["domain"]).alias("weight")))
    return rows.withColumns({
        "evidence": gathered(before, one(mirrored)).cast(EVIDENCE),
        "votes": F.filter(F.concat(votes_of(F.col("hits")), F.array(by_domain)), lambda v: v.isNotNull()).cast(VOTES),
        "surface": surface,
    })


#: The columns of a finding before grouping, and their types.
FINDING = {
    "crawl_id": "string", "page_ord": "int", "elem_ord": "int", "page_url": "string", "page_title": "string", "post_title": "string", "level": "string",
    "score": "int", "pattern": "string", "pattern_label": "string", "category": "string", "type": "string", "content": "string", "selector": "string",
    "frame_path": NO_STRINGS, "frame_url": "string", "context_title": "string", "urls": NO_STRINGS, "hidden_reasons": NO_STRINGS,
    "rect": "struct<x:int,y:int,w:int,h:int>", "evidence": EVIDENCE, "reflected_params": "array<struct<name:string,value:string>>",
    "stuffing": stuffing.DETAIL, "cloaking": cloaking.DETAIL,
}


def shaped(rows: DataFrame) -> DataFrame:
    """Findings with all columns; what a row doesn't have is null or empty."""
    empty = {"frame_path": F.array(), "urls": F.array(), "hidden_reasons": F.array(), "reflected_params": F.array(), "selector": F.lit(""), "context_title": F.lit("")}
    return rows.select(*[(F.col(c) if c in rows.columns else empty.get(c, F.lit(None))).cast(t).alias(c) for c, t in FINDING.items()])


def element_findings(elements: DataFrame, settings: Settings) -> DataFrame:
    rows = scored(elements, settings).where(enough(settings))
    rows = rows.withColumns(rated(settings))
    pattern = F.when(F.col("surface"), SURFACE[0]).otherwise(F.col("pattern"))
    found_in = F.coalesce("listed_title", F.lit(""))
    return shaped(
        rows.withColumns({
            "level": F.when(F.col("surface"), SUSPECT).otherwise(F.col("level")), "pattern": pattern, "pattern_label": labels(pattern),
            "reflected_params": F.transform("reflected", lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"))),
            "page_title": F.when(found_in != "", found_in).otherwise(F.coalesce("page_title", F.lit(""))),
            "post_title": F.when(F.coalesce("context_title", F.lit("")) != "", F.col("context_title")).otherwise(found_in),
        })
    )


def redirect_findings(pages: DataFrame, settings: Settings) -> DataFrame:
    """Pages that took the visitor to an untrusted site."""
    rows = pages.where("offsite_redirect and final_url <> ''").where(untrusted(F.col("final_url"), settings))
    target, category = urls.host("final_url"), domains.suspicion(urls.host("final_url"))
    rows = rows.withColumns({
        "evidence": F.array(
            ev("redirect", F.concat(F.lit("다른 사이트로 자동 이동: "), target), POINTS["redirect"]), ev("external", "화이트리스트에 없는 외부 도메인", POINTS["external"])
        ).cast(EVIDENCE),
        "votes": F.filter(F.array(F.struct(category.alias("category"), F.lit(1).alias("weight"))), lambda v: v["category"].isNotNull()).cast(VOTES),
    })
    rows = rows.where(enough(settings)).withColumns(rated(settings))
    return shaped(rows.select(
        *PLACE, F.lit(1 << 20).alias("elem_ord"), F.col("url").alias("page_url"), F.lit("page_redirect").alias("type"), F.col("final_url").alias("content"),
        F.col("url").alias("frame_url"), "evidence", "score", "level", "pattern", labels(F.col("pattern")).alias("pattern_label"), "category",
    ))


def with_stuffing(found: DataFrame, pages: DataFrame, settings: Settings) -> DataFrame:
    """Findings with those of stuffed pages; on such a page these take in visible findings of words alone."""
    stuffed = stored(stuffing.findings(pages, settings).withColumn("elem_ord", F.lit((1 << 20) + 1)), "stuffed")
    absorbed = (F.col("pattern") == "visible") & only(F.col("evidence"), "keyword", "variant")
    marked = found.join(stuffed.select(*PLACE, F.lit(True).alias("_stuffed")), PLACE, "left")
    absorbed = F.coalesce("_stuffed", F.lit(False)) & absorbed
    taken = marked.where(absorbed).groupBy(*PLACE).agg(
        F.count("*").cast("int").alias("merged"), F.slice(F.array_sort(F.collect_list(F.struct("elem_ord", F.substring("content", 1, 80).alias("text")))), 1, 5).alias("texts")
    )
    joined = stuffed.join(taken, PLACE, "left")
    detail = F.col("stuffing").withField("merged", F.coalesce("merged", F.lit(0))).withField(
        "examples", F.coalesce(F.transform("texts", lambda t: t["text"]), F.array().cast(NO_STRINGS))
    )
    return marked.where(~absorbed).drop("_stuffed").unionByName(shaped(joined.withColumn("stuffing", detail)))


def strongest_by_place(found: DataFrame) -> DataFrame:
    """Of the findings at one place the strongest, a link before others, then the first."""
    blank = F.col("selector") == ""
    key = [*PLACE, "frame_path", "selector", F.when(blank, F.col("elem_ord"))]  # findings without a place stay, each by itself
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.desc(F.col("type") == "link"), "elem_ord")
    first = F.min("elem_ord").over(Window.partitionBy(*key))
    ranked = found.where("selector is not null").withColumns({"_k": F.row_number().over(order), "ord": first})
    return ranked.where(blank | (F.col("_k") == 1)).drop("_k")


def without_descendants(found: DataFrame) -> DataFrame:
    """Drop what lies inside a finding at least as strong, and what only wraps a stronger one."""
    parts = F.split("selector", " > ")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), " > "))
    inner = found.where(F.size(parts) > 1).select(*PLACE, "frame_path", F.col("selector").alias("inner"), "score", F.explode(heads).alias("outer"))
    outer = found.where("selector <> ''").select(*PLACE, "frame_path", F.col("selector").alias("outer"), F.col("score").alias("outer_score"))
    nested = inner.join(outer, [*PLACE, "frame_path", "outer"])
    gone = nested.select(*PLACE, "frame_path", F.when(F.col("outer_score") >= F.col("score"), F.col("inner")).otherwise(F.col("outer")).alias("selector"))
    return found.join(gone.distinct(), [*PLACE, "frame_path", "selector"], "left_anti")


def page_findings(crawls: DataFrame | None, settings: Settings | None = None, pages: DataFrame | None = None) -> DataFrame:
    """All findings, page by page, of crawl documents or of pages that are stored apart (see ``crawl.read_pages``).

    Pages are stored once, in columns: five branches read what each needs of them, and none parses documents again.
    """
    settings = settings or Settings()
    bounded_batches((pages if crawls is None else crawls).sparkSession)
    pages = stored(prepared_pages(crawl.pages(crawls) if pages is None else pages, settings), "pages")
    found = element_findings(with_links_below(page_elements(pages)), settings).unionByName(redirect_findings(pages, settings))
    found = with_stuffing(stored(found, "scored"), pages, settings)
    found = found.unionByName(shaped(cloaking.findings(pages, settings)))
    return without_descendants(strongest_by_place(stored(found, "findings")))


GROUP = ["crawl_id", "frame_path", "selector", "content", "type"]


def grouped(found: DataFrame) -> DataFrame:
    """One row per finding of a crawl, with the attributes of its first page and the number of its pages."""
    rest = [c for c in FINDING if c not in (*GROUP, "page_ord", "elem_ord")]
    per_page = found.groupBy(*GROUP, "page_url").agg(F.min_by(F.struct(*rest), F.struct("page_ord", "ord")).alias("f"), F.min(F.struct("page_ord", "ord")).alias("first"))
    groups = per_page.groupBy(*GROUP).agg(F.min_by("f", "first").alias("f"), F.min("first").alias("first"), F.count("*").alias("page_count"))
    groups = groups.select(*GROUP, "first", "page_count", *[F.col(f"f.{c}").alias("first_page" if c == "page_url" else c) for c in rest])
    order = Window.partitionBy("crawl_id").orderBy(F.col("level") != "high", F.desc("score"), F.desc("page_count"), "first")
    where = F.when(F.col("page_count") > 1, F.concat(F.col("page_count").cast("string"), F.lit("개 페이지에서 발견"))).otherwise(F.col("first_page"))
    return groups.withColumns({
        "id": F.row_number().over(order), "level_label": F.when(F.col("level") == "high", "불법광고 의심").otherwise("검토 필요"),
        "advice": advice(F.col("pattern")), "location_label": where,
    }).drop("first")


def finding_pages(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(crawl_id, id, page_ord, page_url): the pages of each finding, however many."""
    pages = found.groupBy(*GROUP, "page_url").agg(F.min("page_ord").alias("page_ord"))
    return groups.select(*GROUP, "id").join(pages, GROUP).select("crawl_id", "id", "page_ord", "page_url")


def external_domains(crawls: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(crawl_id, host, count, whitelisted): how often elements point outside, most often first."""
    settings = settings or Settings()
    elements = page_elements(prepared_pages(crawl.pages(crawls), settings))
    rows = elements.select(*PLACE, "elem_ord", "seed_hosts", "subdomains", F.posexplode("urls").alias("url_ord", "u")).where(external(F.col("u")))
    counted = rows.groupBy("crawl_id", urls.host("u").alias("host")).agg(F.count("*").alias("count"), F.min(F.struct("page_ord", "elem_ord", "url_ord")).alias("first"))
    order = Window.partitionBy("crawl_id").orderBy(F.desc("count"), "first")
    return counted.select("crawl_id", "host", "count", urls.listed(F.col("host"), settings.trusted).alias("whitelisted"), F.row_number().over(order).alias("place"))
