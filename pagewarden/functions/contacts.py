"""Contacts and public-service wording in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How messenger ids and telephone numbers are given, and how prevention notices are worded.
TELEGRAM = (
    r"(?:(?<![가-힣])(?:텔레그램|텔레|텔그|텔렘|텔)|(?<![a-z])telegram)"
    r"\s*(?:아이디|id|문의|주소|연락)?\s*[:：]?\s*@?[a-z][a-z0-9_]{3,31}(?![a-z0-9_])"
    r"|(?<![a-z])tg\s*(?:id\s*[:：]?|[:：@])\s*@?[a-z][a-z0-9_]{3,31}(?![a-z0-9_])"
    r"|(?<![a-z0-9])(?:t\.me|telegram\.me|telegram\.dog)/[a-z0-9_+]+"
)
CONTACT = (
    r"(?:카톡|카카오톡|카카오|라인|위챗|wechat|시그널|signal)\s*(?:아이디|id|문의)?\s*[:：]?\s*@?[a-z0-9_]{3,}"
    r"|(?<![\w@.])@[a-z][a-z0-9_]{4,31}(?![\w@]|\.[a-z])|01[016789][-.\s]?\d{3,4}[-.\s]?\d{4}"
)
PREVENTION = (
    r"예방|중독|근절|단속|처벌|퇴치|경각심|캠페인|사행성|사행\s*행위|치유|사범|적발|검거|수사|피해\s*(?:예방|사례|주의|신고)"
    r"|불법\s*(?:\S+\s*)?(?:도박|사이트|마약|대출|금융|광고|사금융|거래)|불법(?:이며|입니다|이므로|이에요)"
    r"|신고\s*(?:센터|방법|하세요|해\s*주세요|전화|포상)|상담\s*(?:센터|전화)|치료\s*(?:센터|기관|보호)|유의\s*사항|주의\s*(?:하세요|보|를\s*당부)"
)
FLAGS = "(?iuU)"


def squeezed(text: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def contact(text: Column) -> Column:
    """struct(kind, value) of the first telegram id, else of the first other contact; or null."""
    text = F.coalesce(text, F.lit(""))
    found = lambda kind, pattern: F.when(
        text.rlike(FLAGS + pattern), F.struct(F.lit(kind).alias("kind"), squeezed(F.regexp_extract(text, FLAGS + pattern, 0)).alias("value"))
    )
    return F.coalesce(found("telegram", TELEGRAM), found("contact", CONTACT))


def prevention(text: Column) -> Column:
    """Whether a text warns of or reports on offences."""
    return F.coalesce(text, F.lit("")).rlike("(?U)" + PREVENTION)
