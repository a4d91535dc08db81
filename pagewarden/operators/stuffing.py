"""Pages that repeat dictionary words out of all proportion."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pagewarden.functions.arrow import once
from pagewarden.functions.matching import Matcher
from pagewarden.operators.evidence import EVIDENCE, POINTS, VOTES, Settings, enough, ev, gathered, labels, one, rated

# From when on words are too many.
LEAST_COUNT, LEAST_KINDS, LEAST_REPEAT, DENSITY, LIST_LINES, LINE_SHARE = 20, 3, 2.0, 0.2, 3, 0.5
DETAIL = "struct<count:int,kinds:int,density:double,list_lines:int,top:array<string>,merged:int,examples:array<string>>"
STATS = f"struct<count:int,kinds:int,density:double,list_lines:int,top:array<string>,votes:{VOTES}>"


def _letters(text: str) -> int:
    return sum(map(str.isalnum, text))


def stats_of(matcher: Matcher, text: str | None) -> dict | None:
    """How a text is stuffed, or None if it isn't."""
    read = matcher.charmap.view(text or "")
    found = matcher.spans(read)
    counts = Counter(k for k, *_ in found)
    if len(found) < LEAST_COUNT or len(counts) < LEAST_KINDS or len(found) < LEAST_REPEAT * len(counts):
        return None
    density = sum(_letters(read[a:b]) for _, a, b in found) / max(_letters(read), 1)
    lists = 0
    for line in read.splitlines():
        inside = matcher.spans(line)
        lists += len(inside) >= 3 and sum(_letters(line[a:b]) for _, a, b in inside) >= LINE_SHARE * max(_letters(line), 1)
    if density < DENSITY and lists < LIST_LINES:
        return None
    return {
        "count": len(found), "kinds": len(counts), "density": round(density, 3), "list_lines": lists,
        "top": [k.word for k, _ in counts.most_common(5)], "votes": [{"category": k.category, "weight": n * k.weight} for k, n in counts.items()],
    }


def stats(matcher: Matcher, text: Column) -> Column:
    """The struct of ``stats_of``; null where a text isn't stuffed. ``count`` is null for those."""

    @pandas_udf(STATS)
    def measured(texts: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(("count", "kinds", "density", "list_lines", "top", "votes"))
        found = pd.DataFrame([stats_of(matcher, t) or empty for t in texts], columns=list(empty))
        return found.astype({"count": "Int32", "kinds": "Int32", "list_lines": "Int32", "density": "float64"})

    return once(measured)(text)


def findings(pages: DataFrame, settings: Settings) -> DataFrame:
    """A finding for each stuffed page, from the text of its frames and of what is hidden."""
    frames = F.filter(F.transform("frames", lambda f: f["text"]), lambda t: t.isNotNull() & (t != ""))
    hidden = F.transform(F.filter("elements", lambda e: (e["type"] == "hidden") & (F.coalesce(e["content"], F.lit("")) != "")), lambda e: e["content"])
    none = F.array().cast("array<string>")
    text = F.array_join(F.concat(F.coalesce(frames, none), F.coalesce(hidden, none)), "\n")
    rows = pages.select("crawl_id", "page_ord", "url", stats(settings.matcher, text).alias("s")).where("s.count is not null")
    number = lambda c: F.col(c).cast("string")
    repeated = ev("stuffing", F.concat(F.lit("광고 키워드 "), number("s.kinds"), F.lit("종이 "), number("s.count"), F.lit("회 반복됨")), POINTS["stuffing"])
    share = F.format_string("%.0f%%", F.col("s.density") * 100)
    dense = F.when(F.col("s.density") >= DENSITY, ev("stuffing", F.concat(F.lit("본문 글자의 "), share, F.lit("가 광고 키워드")), POINTS["density"]))
    listing = F.when(
        F.col("s.list_lines") >= LIST_LINES,
        ev("stuffing", F.concat(F.lit("의미 없이 키워드만 나열한 줄 "), number("s.list_lines"), F.lit("개")), POINTS["list"]),
    )
    rows = rows.withColumns({"evidence": gathered(one(repeated), one(dense), one(listing)).cast(EVIDENCE), "votes": F.col("s.votes")})
    rows = rows.where(enough(settings)).withColumns(rated(settings))
    content = F.concat(
        F.lit("키워드 도배(해킹 생성 페이지 의심): "), F.array_join("s.top", ", "), F.lit(" 등 "), number("s.kinds"), F.lit("종 "), number("s.count"), F.lit("회")
    )
    detail = F.struct(
        "s.count", "s.kinds", "s.density", "s.list_lines", "s.top", F.lit(0).alias("merged"), F.array().cast("array<string>").alias("examples")
    )
    return rows.select(
        "crawl_id", "page_ord", F.col("url").alias("page_url"), F.lit("page_stuffing").alias("type"), content.alias("content"), F.lit("").alias("selector"),
        F.col("url").alias("frame_url"), "evidence", "score", "level", "pattern", labels(F.col("pattern")).alias("pattern_label"), "category",
        detail.alias("stuffing"),
    )
