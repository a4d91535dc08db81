"""Evidence: what speaks for an element being an illegal advertisement, and how much.

Evidence is an array column of (kind, label, points), put together by native expressions on each row, so
scoring needs no shuffle. Findings are rows with enough of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.functions import domains, urls
from pagewarden.functions.dictionary import OTHER_CATEGORY
from pagewarden.functions.matching import Matcher

# Points, labels and the order in which kinds of evidence name the pattern of a finding.
POINTS = {
    "hidden": 2, "domain": 3, "redirect": 3, "external": 1, "contact": 1, "telegram": 2, "reflection": 2, "search_list": 2,
    "cloaking": 3, "difference": 1, "stuffing": 3, "density": 2, "list": 2,
}
HIGH, SUSPECT = "high", "suspect"
LEVELS = {HIGH: "불법광고 의심", SUSPECT: "검토 필요"}
PATTERNS = {
    "reflection": ("param_reflection", "URL 파라미터 반사"), "cloaking": ("cloaking", "클로킹 의심"), "redirect": ("redirect", "자동 이동"),
    "stuffing": ("stuffing", "키워드 도배"), "search_list": ("search_list", "검색어 목록 오염"), "hidden": ("hidden", "숨김 광고"),
}
VISIBLE, SURFACE = ("visible", "노출 광고"), ("reflection_surface", "악용 가능 지점")
ADVICE = {
    "param_reflection": "주소 파라미터가 화면에 그대로 나타납니다. 출력 전에 값을 걸러 내고 검색엔진에 해당 주소 삭제를 요청하세요.",
    "reflection_surface": "입력값이 그대로 출력됩니다. 지금은 광고가 아니지만 악용될 수 있으므로 출력을 막으세요.",
    "redirect": "방문자를 다른 사이트로 보내는 코드가 있습니다. 소스와 서버 파일이 바뀌었는지 확인하세요.",
    "hidden": "보이지 않게 넣은 광고입니다. 요소를 지우고 편집기 필터와 계정을 점검하세요.",
    "visible": "화면에 보이는 광고입니다. 글을 지우고 작성 경로의 스팸 차단을 점검하세요.",
    "search_list": "검색어 목록에 광고가 올라 있습니다. 검색어를 지우고 금칙어와 자동 노출을 점검하세요.",
    "stuffing": "광고 키워드만 되풀이하는 페이지입니다. 생성 이력과 관리자 계정을 확인하고 페이지를 삭제하세요.",
    "cloaking": "접속 방식에 따라 내용이 달라집니다. 서버 설정과 스크립트의 변조 여부를 확인하세요.",
}
EVIDENCE = "array<struct<kind:string,label:string,points:int>>"
VOTES = "array<struct<category:string,weight:int>>"


@dataclass
class Settings:
    """Thresholds, trusted domains and the dictionary of a detection."""

    high_score: int = 5
    suspect_score: int = 4
    min_evidence: int = 2
    extra_trusted: list[str] = field(default_factory=list)
    matcher: Matcher = field(default_factory=Matcher)

    @property
    def trusted(self) -> list[str]:
        return [*domains.TRUSTED, *(d.strip().lower() for d in self.extra_trusted if d.strip())]


def ev(kind: str | Column, label: str | Column, points: int | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(kind).alias("kind"), as_column(label).alias("label"), as_column(points).cast("int").alias("points"))


def gathered(*parts: Column) -> Column:
    """An array of the structs among the parts that aren't null; arrays are taken in whole."""
    return F.filter(F.concat(*parts), lambda e: e.isNotNull())


def one(item: Column) -> Column:
    return F.array(item)


def from_hits(hits: Column) -> Column:
    return F.transform(hits, lambda h: ev(h["kind"], h["label"], h["weight"])).cast(EVIDENCE)


def votes_of(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(h["category"].alias("category"), h["weight"].alias("weight"))).cast(VOTES)


def voted(votes: Column) -> Column:
    """The category of the largest total weight; of equal ones the first named."""
    names = F.array_distinct(F.transform(votes, lambda v: v["category"]))
    total = lambda c: F.aggregate(F.filter(votes, lambda v: v["category"] == c), F.lit(0), lambda s, v: s + v["weight"])
    ranked = F.transform(names, lambda c, i: F.struct(total(c).alias("weight"), (-i).alias("place"), c.alias("category")))
    return F.coalesce(F.array_max(ranked)["category"], F.lit(OTHER_CATEGORY))


def has(evidence: Column, *kinds: str) -> Column:
    return F.exists(evidence, lambda e: e["kind"].isin(*kinds))


def only(evidence: Column, *kinds: str) -> Column:
    return F.forall(evidence, lambda e: e["kind"].isin(*kinds))


def external(url: Column) -> Column:
    """Whether a URL leaves the sites of the crawl (columns seed_hosts and subdomains)."""
    inside = F.exists("seed_hosts", lambda s: urls.same_site(urls.host(url), s, F.col("subdomains")))
    return url.startswith("http") & (urls.host(url) != "") & ~inside


def untrusted(url: Column, settings: Settings) -> Column:
    return external(url) & ~urls.listed(urls.host(url), settings.trusted)


def rated(settings: Settings, evidence: str = "evidence", votes: str = "votes") -> dict[str, Column]:
    """Score, level, pattern and category columns."""
    e = F.col(evidence)
    score = F.aggregate(e, F.lit(0), lambda s, x: s + x["points"])
    level = F.when(score >= settings.high_score, HIGH).otherwise(SUSPECT)
    pattern = F.coalesce(*[F.when(has(e, k), F.lit(p)) for k, (p, _) in PATTERNS.items()], F.lit(VISIBLE[0]))
    return {"score": score, "level": level, "pattern": pattern, "category": voted(F.col(votes))}


def enough(settings: Settings, evidence: str = "evidence") -> Column:
    """Whether there is enough evidence for a finding."""
    score = F.aggregate(evidence, F.lit(0), lambda s, x: s + x["points"])
    return (F.size(evidence) >= settings.min_evidence) & (score >= settings.suspect_score)


def labels(pattern: Column) -> Column:
    named = {**dict(PATTERNS.values()), **dict([VISIBLE, SURFACE])}
    return F.coalesce(*[F.when(pattern == p, F.lit(t)) for p, t in named.items()])


def advice(pattern: Column) -> Column:
    return F.coalesce(*[F.when(pattern == p, F.lit(t)) for p, t in ADVICE.items()])
