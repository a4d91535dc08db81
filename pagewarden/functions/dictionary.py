"""The keyword dictionary: what to look for, of which category, with which weight.

Any dictionary can be given to the engine; the default one is below, as a plain table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

OTHER_CATEGORY = "기타"
STRONG, MEDIUM = 3, 2
#: What may stand between the characters of a strong word of three characters or more.
SEPARATOR = r"[\s·.\-_*|/]{0,2}"


@dataclass(frozen=True)
class Keyword:
    """A word. ``strict``: not right after a Hangul syllable; ``not_before``: what may not follow; ``latin``: not after a Latin letter."""

    word: str
    category: str
    weight: int
    strict: bool = False
    not_before: str = ""
    latin: bool = False

    @property
    def bare(self) -> str:
        return self.word.replace(" ", "")

    @property
    def hangul(self) -> bool:
        return all("가" <= c <= "힣" or c == " " for c in self.word)

    @property
    def source(self) -> str:
        """The regular expression, without flags; the same for Python and, under ``(?iuU)``, for Java."""
        if self.latin:
            return f"(?<![a-z]){self.word}"
        spaced = self.weight == STRONG and len(self.bare) >= 3
        letters, between = (self.bare, SEPARATOR) if spaced else (self.word.split(), r"\s*")
        guards = "(?<![가-힣])" if self.strict else "", f"(?!{self.not_before})" if self.not_before else ""
        return between.join(map(re.escape, letters)).join(guards)

    @cached_property
    def pattern(self) -> re.Pattern:
        return re.compile(self.source, re.IGNORECASE)


# Words, categories, weights and limits that results must agree on, in their order.
KEYWORDS = [
    Keyword("카지노", "도박", 3), Keyword("바카라", "도박", 3), Keyword("토토사이트", "도박", 3), Keyword("사설토토", "도박", 3), Keyword("먹튀", "도박", 3), Keyword("슬롯사이트", "도박", 3),
    Keyword("메이저놀이터", "도박", 3), Keyword("꽁머니", "도박", 3), Keyword("첫충", "도박", 3), Keyword("매충", "도박", 3), Keyword("파워볼", "도박", 3), Keyword("안전놀이터", "도박", 2),
    Keyword("베팅", "도박", 2), Keyword("배팅", "도박", 2), Keyword("홀덤", "도박", 2), Keyword("가입코드", "도박", 2), Keyword("추천코드", "도박", 2), Keyword("입금 보너스", "도박", 2),
    Keyword("사다리게임", "도박", 2), Keyword("스포츠토토", "도박", 2), Keyword("토토", "도박", 1, strict=True), Keyword("슬롯", "도박", 1, strict=True), Keyword("룰렛", "도박", 1),
    Keyword("환전", "도박", 1), Keyword("야동", "성인", 3), Keyword("성인방송", "성인", 3), Keyword("조건만남", "성인", 3), Keyword("원조교제", "성인", 3), Keyword("출장안마", "성인", 3),
    Keyword("출장마사지", "성인", 3), Keyword("섹스", "성인", 3), Keyword("립카페", "성인", 3), Keyword("키스방", "성인", 3),
    Keyword("오피", "성인", 2, strict=True, not_before="스|니|셜"), Keyword("몰카", "성인", 2), Keyword("19금", "성인", 2), Keyword("룸살롱", "성인", 2),
    Keyword("룸싸롱", "성인", 2), Keyword("성인용품", "성인", 2), Keyword("성인", "성인", 1, strict=True), Keyword("무료 영상", "성인", 1), Keyword("유흥", "성인", 1),
    Keyword("카드깡", "불법금융", 3), Keyword("휴대폰깡", "불법금융", 3), Keyword("신용카드현금화", "불법금융", 3), Keyword("소액결제현금화", "불법금융", 3), Keyword("정보이용료현금화", "불법금융", 3),
    Keyword("내구제", "불법금융", 3), Keyword("작업대출", "작업대출", 3), Keyword("대출작업", "작업대출", 3), Keyword("서류작업", "작업대출", 3), Keyword("재직작업", "작업대출", 3),
    Keyword("무직자작업", "작업대출", 3), Keyword("무직자대출", "작업대출", 2), Keyword("신불자대출", "작업대출", 2), Keyword("연체자대출", "작업대출", 2), Keyword("당일대출", "작업대출", 2),
    Keyword("급전", "작업대출", 2), Keyword("대출", "작업대출", 1), Keyword("대포통장", "대포통장", 3), Keyword("통장매입", "대포통장", 3), Keyword("통장매매", "대포통장", 3),
    Keyword("통장삽니다", "대포통장", 3), Keyword("통장구매", "대포통장", 3), Keyword("통장임대", "대포통장", 3), Keyword("법인통장매입", "대포통장", 3), Keyword("대포폰", "대포통장", 3),
    Keyword("대포유심", "대포통장", 3), Keyword("유심매입", "대포통장", 3), Keyword("통장대여", "대포통장", 2), Keyword("계좌대여", "대포통장", 2), Keyword("명의대여", "대포통장", 2),
    Keyword("체크카드매입", "대포통장", 2), Keyword("법인통장", "대포통장", 1), Keyword("환치기", "불법환전", 3), Keyword("불법환전", "불법환전", 3), Keyword("코인세탁", "불법환전", 3),
    Keyword("자금세탁 대행", "불법환전", 3), Keyword("테더매입", "불법환전", 3), Keyword("테더판매", "불법환전", 3), Keyword("환전대행", "불법환전", 2), Keyword("코인환전", "불법환전", 2),
    Keyword("테더환전", "불법환전", 2), Keyword("상품권매입", "불법환전", 2), Keyword("필로폰", "마약", 3), Keyword("물뽕", "마약", 3), Keyword("엑스터시", "마약", 3),
    Keyword("케타민", "마약", 3), Keyword("야바", "마약", 3, strict=True, not_before="바|위|간|구|외|채"), Keyword("빙두", "마약", 3), Keyword("떨액", "마약", 3),
    Keyword("액상대마", "마약", 3), Keyword("대마젤리", "마약", 3), Keyword("대마쿠키", "마약", 3), Keyword("아이스작대기", "마약", 3), Keyword("마약판매", "마약", 3),
    Keyword("마약구매", "마약", 3), Keyword("마약구입", "마약", 3), Keyword("대마초", "마약", 2), Keyword("코카인", "마약", 2), Keyword("헤로인", "마약", 2), Keyword("사티바", "마약", 2),
    Keyword("던지기 거래", "마약", 2), Keyword("좌표 거래", "마약", 2), Keyword("마약", "마약", 1, strict=True), Keyword("대마", "마약", 1, strict=True, not_before="도|을|루|디|른"),
    Keyword("비아그라", "불법의약품", 3), Keyword("시알리스", "불법의약품", 3), Keyword("레비트라", "불법의약품", 3), Keyword("낙태약", "불법의약품", 3), Keyword("미프진", "불법의약품", 3),
    Keyword("발기부전", "불법의약품", 1), Keyword("casino", "도박", 3, latin=True), Keyword("baccarat", "도박", 3, latin=True), Keyword("powerball", "도박", 3, latin=True),
    Keyword("porn", "성인", 3, latin=True), Keyword("viagra", "불법의약품", 3, latin=True), Keyword("cialis", "불법의약품", 3, latin=True),
    Keyword("ketamine", "마약", 3, latin=True), Keyword("meth", "마약", 2, latin=True), Keyword("usdt", "불법환전", 2, latin=True),
]
