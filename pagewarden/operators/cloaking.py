"""Pages that show some visitors what they don't show others.

Each snapshot of a page under another profile is compared with the ordinary one of the same row, so nothing
is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import contacts, domains, matching, urls
from pagewarden.operators.evidence import EVIDENCE, POINTS, VOTES, Settings, enough, ev, from_hits, gathered, one, rated, untrusted, votes_of

# Below which similarity a snapshot is another page, and short names of profiles.
SIMILAR = 0.5
SHORT = {"googlebot": "구글봇", "google_referer": "구글 경유", "mobile": "모바일"}
DETAIL = (
    "struct<profile:string,label:string,only_in:string,similarity:double,new_keywords:array<string>,redirects:array<string>,"
    "new_hosts:array<string>,title:string,base_title:string>"
)
NONE = "array<string>"


def text_of(snapshot: str) -> Column:
    """Title, text and hidden texts of a snapshot, on lines of their own."""
    lines = F.array(F.coalesce(F.col(f"{snapshot}.title"), F.lit("")), F.coalesce(F.col(f"{snapshot}.text"), F.lit("")))
    return F.array_join(F.concat(lines, F.coalesce(F.col(f"{snapshot}.hidden"), F.array().cast(NONE))), "\n")


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w{2,}"), F.lit(0)))


def shared_words(a: Column, b: Column) -> Column:
    """Of two sets of words the share that both have; 1 if there are none."""
    both, every = F.size(F.array_intersect(a, b)).cast("double"), F.size(a) + F.size(b)
    return F.when(every == 0, 1.0).otherwise(both / (every - both))


def similarity(a: Column, b: Column) -> Column:
    """Shared words of all words of two texts; 1 if there are none."""
    return shared_words(words(a), words(b))


def toward(word: Column) -> Column:
    """A noun with the Korean particle for a direction, which follows its last sound."""
    last = F.ascii(F.substring(word, -1, 1))
    final = (last - 0xAC00) % 28
    syllable = last.between(0xAC00, 0xD7A3)
    return F.concat(word, F.when(syllable & final.isin(0, 8), "로").when(syllable, "으로").otherwise("(으)로"))


def findings(pages: DataFrame, settings: Settings) -> DataFrame:
    """A finding for each profile that is shown advertisements of its own."""
    of = lambda c: F.coalesce(c, F.array().cast(NONE))
    base = F.get(F.filter("cloaking.profiles", lambda p: p["key"] == "pc"), F.lit(0))
    rows = pages.withColumn("base", base).where("base is not null and coalesce(base.error, '') = ''")
    rows = rows.withColumns({
        "base_text": text_of("base"), "base_hosts": F.transform(F.concat(of(F.col("base.links")), of(F.col("base.redirects"))), urls.host),
        "base_contact": contacts.contact(text_of("base")),
    }).withColumn("base_words", F.transform(matching.hits(settings.matcher, F.col("base_text")), lambda h: h["word"]))
    carried = ["crawl_id", "page_ord", "url", "final_or_url", "seed_hosts", "subdomains", "base", "base_text", "base_hosts", "base_contact", "base_words"]
    rows = rows.select(*carried, F.posexplode("cloaking.profiles").alias("profile_ord", "snap")).where("snap.key <> 'pc' and coalesce(snap.error, '') = ''")
    rows = rows.withColumn("text", text_of("snap"))
    rows = rows.withColumn("hits", F.filter(matching.hits(settings.matcher, F.col("text")), lambda h: ~F.array_contains("base_words", h["word"])))
    elsewhere = lambda u: untrusted(u, settings) & ~F.array_contains("base_hosts", urls.host(u))
    final = F.coalesce("snap.final_url", F.lit(""))
    moved = (urls.host(final) != "") & (urls.host(final) != urls.host("final_or_url")) & untrusted(final, settings)
    first = F.when(moved, F.array(final)).otherwise(F.array().cast(NONE))
    rows = rows.withColumns({
        "redirects": F.array_distinct(F.concat(first, F.filter(of(F.col("snap.redirects")), elsewhere))),
        "new_links": F.filter(of(F.col("snap.links")), elsewhere),
        "contact": F.when(F.col("base_contact").isNull(), contacts.contact(F.col("text"))),
        "similarity": similarity(F.col("base_text"), F.col("text")),
    })
    rows = rows.withColumn("new_hosts", F.array_distinct(F.transform("new_links", urls.host)))
    bad = lambda hosts: F.filter(hosts, lambda h: domains.suspicion(h).isNotNull())
    rows = rows.withColumn("bad_hosts", F.concat(bad(F.transform("redirects", urls.host)), bad(F.col("new_hosts"))))
    telegram = F.coalesce(F.col("contact.kind") == "telegram", F.lit(False))
    rows = rows.where((F.size("hits") > 0) | (F.size("redirects") > 0) | (F.size(bad(F.col("new_hosts"))) > 0) | telegram)

    label, bad_host = F.col("snap.label"), F.get("bad_hosts", F.lit(0))
    named = F.array_join(F.transform(F.slice("hits", 1, 5), lambda h: h["word"]), ", ")
    shown = F.when(F.size("hits") > 0, ev("cloaking", F.concat("snap.only_in", F.lit(": 광고 키워드 "), named), POINTS["cloaking"]))
    sent = F.when(
        F.size("redirects") > 0, ev("cloaking", F.concat(label, F.lit(" 접속일 때만 다른 사이트로 이동: "), urls.host(F.get("redirects", F.lit(0)))), POINTS["cloaking"])
    )
    domain = F.when(bad_host.isNotNull(), ev("domain", F.concat(F.lit("의심 도메인: "), bad_host), POINTS["domain"]))
    linked = F.when(
        F.size("new_hosts") > 0,
        ev("external", F.concat(toward(label), F.lit(" 볼 때만 외부 링크: "), F.array_join(F.slice("new_hosts", 1, 3), ", ")), POINTS["external"]),
    )
    reached = F.when(
        F.col("contact").isNotNull(),
        ev("contact", F.concat(toward(label), F.lit(" 볼 때만 연락처: "), F.col("contact.value")), F.when(telegram, POINTS["telegram"]).otherwise(POINTS["contact"])),
    )
    share = F.format_string("%.0f%%", F.col("similarity") * 100)
    other = F.when(
        F.col("similarity") < SIMILAR, ev("cloaking", F.concat(F.lit("일반 PC 화면과 내용이 크게 다름 (같은 단어 "), share, F.lit(")")), POINTS["difference"])
    )
    by_host = F.when(bad_host.isNotNull(), F.struct(domains.suspicion(bad_host).alias("category"), F.lit(POINTS["domain"]).alias("weight")))
    rows = rows.withColumns({
        "evidence": gathered(one(shown), from_hits(F.col("hits")), one(sent), one(domain), one(linked), one(reached), one(other)).cast(EVIDENCE),
        "votes": F.filter(F.concat(votes_of(F.col("hits")), F.array(by_host)), lambda v: v.isNotNull()).cast(VOTES),
    }).where(enough(settings))
    rows = rows.withColumns(rated(settings))

    known = F.transform(F.split("base_text", "\n"), contacts.squeezed)
    lines = F.concat(F.array(F.coalesce("snap.title", F.lit(""))), F.split(F.coalesce("snap.text", F.lit("")), "\n"), of(F.col("snap.hidden")))
    fresh = F.filter(F.transform(lines, contacts.squeezed), lambda x: (x != "") & ~F.array_contains(F.col("known"), x))
    rows = rows.withColumn("known", known).withColumn("fresh", fresh)
    said = F.filter(F.flatten(F.transform("hits", lambda h: F.array(h["original"], h["word"]))), lambda w: w != "")
    telling = F.filter(
        "fresh", lambda x: F.exists(said, lambda w: F.contains(F.lower(x), F.lower(w))) | contacts.contact(x).isNotNull()
    )
    plain = F.substring(contacts.squeezed(F.col("text")), 1, 160)
    content = F.coalesce(
        F.substring(F.get(telling, F.lit(0)), 1, 200),
        F.when(F.size("hits") > 0, F.substring(F.get("fresh", F.lit(0)), 1, 200)),
        F.when(F.size("redirects") > 0, F.concat(F.lit("다른 사이트로 이동: "), F.get("redirects", F.lit(0)))),
        plain,
    )
    short = F.coalesce(*[F.when(F.col("snap.key") == k, F.lit(v)) for k, v in SHORT.items()], label)
    detail = F.struct(
        F.col("snap.key").alias("profile"), label.alias("label"), F.col("snap.only_in").alias("only_in"), F.bround("similarity", 2).alias("similarity"),
        F.transform("hits", lambda h: h["word"]).alias("new_keywords"), "redirects", "new_hosts", F.coalesce("snap.title", F.lit("")).alias("title"),
        F.coalesce("base.title", F.lit("")).alias("base_title"),
    )
    links = F.slice(F.concat("redirects", "new_links"), 1, 10)
    return rows.select(
        "crawl_id", "page_ord", ((1 << 20) + 2 + F.col("profile_ord")).alias("elem_ord"), F.col("url").alias("page_url"), F.lit("cloaking").alias("type"),
        content.alias("content"), F.concat(F.lit("["), label, F.lit("]")).alias("selector"), F.col("final_or_url").alias("frame_url"),
        F.array_distinct(F.filter(links, lambda u: u.startswith("http"))).alias("urls"), "evidence", "score", "level", "pattern",
        F.concat(F.lit("클로킹("), short, F.lit(")")).alias("pattern_label"), "category", detail.alias("cloaking"),
    )
