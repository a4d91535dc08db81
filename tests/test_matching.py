import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewarden.functions.charmap import CharMap, read_confusables
from pagewarden.functions.dictionary import KEYWORDS
from pagewarden.functions.matching import Matcher, typed_on_korean_keyboard

MATCHER = Matcher()


def only(text):
    return {h.keyword.word: h for h in MATCHER.hits(text)}


@pytest.mark.parametrize(
    "text,word,method,original",
    [
        ("밖콰라 바로", "바카라", "sound", "밖콰라"), ("카찌노 안내", "카지노", "sound", "카찌노"), ("zkwlsh go", "카지노", "keyboard", "zkwlsh"),
        ("ㅋㅈㄴ 추천", "카지노", "chosung", "ㅋㅈㄴ"), ("카​지노", "카지노", "normalize", "카​지노"), ("саsino", "casino", "confusable", "саsino"),
        ("ｐｏｒｎ", "porn", "normalize", "ｐｏｒｎ"), ("바7라 가입", "바카라", "digits", "바7라"), ("슬-롯", "슬롯", "symbols", "슬-롯"),
        ("먹 튀", "먹튀", "exact", None), ("토.토.사.이.트", "토토사이트", "exact", "토.토.사.이.트"), ("ⓟⓞⓡⓝ", "porn", "enclosed", "ⓟⓞⓡⓝ"),
        ("𝐩𝐨𝐫𝐧", "porn", "styled", "𝐩𝐨𝐫𝐧"), ("vîågrà", "viagra", "accent", "vîågrà"), ("㉥㉪㉣", "바카라", "chosung", "㉥㉪㉣"),
    ],
)
def test_disguises_are_read(text, word, method, original):
    hits = only(text)
    if word == "먹튀":
        assert word not in hits or hits[word].method in ("exact", "spaces")
        return
    assert word in hits and hits[word].method == method
    assert original is None or hits[word].original == original


def test_weights():
    assert only("밖콰라")["바카라"].weight == 2
    assert only("카​지노")["카지노"].weight == 3
    assert only("ⓟⓞⓡⓝ")["porn"].label.endswith("(감싼 문자)")


@pytest.mark.parametrize(
    "text",
    [
        "", "오피스 건물 안내", "대마도 여행", "야바위꾼", "메서드 meeting", "① 접수 ② 심사 ③ 안내", "Copyright ⓒ 2024", "café naïve Zürich", "something ordinary",
        "도토리묵", "성스러운 인생",
    ],
)
def test_plain_text_has_no_hits(text):
    assert MATCHER.hits(text) == []


def test_longer_words_cover_shorter_ones():
    assert [(k.word, a, b) for k, a, b in MATCHER.spans("스포츠토토 토토")] == [("스포츠토토", 0, 5), ("토토", 6, 8)]
    assert [k.word for k in MATCHER.words("불법환전 환전")] == ["불법환전", "환전"]


def test_keyboard():
    assert typed_on_korean_keyboard("qkzkfk") == "바카라"
    assert typed_on_korean_keyboard("Rhcdmf") == "꽃을"
    assert typed_on_korean_keyboard("dkswk") == "안자"
    assert typed_on_korean_keyboard("ekfr") == "닭"


def test_normalization_keeps_places():
    text = "x㈎ｙ́é"
    assert CharMap().view(text) == "x가ye" and CharMap().places(text) == [0, 1, 2, 4]


def test_confusables_are_a_parameter():
    table = "0430 ;\t0061 ;\tMA\n13AA ;\t0047 ; MA # CHEROKEE\n4E00 ; 0061 ; MA\n"
    found = read_confusables(table)
    assert found == {"а": "a", "Ꭺ": "G"}
    assert Matcher(charmap=CharMap(found)).charmap.glyph("Ꭺ").reading == "G"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([k.bare for k in KEYWORDS][:60] + [" ", ".", "x", "a1"]), max_size=8))
def test_cover_equals_its_declarative_form(parts):
    text = "".join(parts)
    every = [(r, k.word, *m.span()) for r, k in enumerate(MATCHER.ranked) for m in k.pattern.finditer(text)]
    left = [m for m in every if not any((c[0], c[2]) < (m[0], m[2]) and c[2] <= m[2] and m[3] <= c[3] for c in every)]
    assert [(w, a, b) for _, w, a, b in left] == [(k.word, a, b) for k, a, b in MATCHER.spans(text)]


def test_hits_don_t_depend_on_other_texts(spark):
    from pagewarden.functions.matching import hits

    texts = ["카지노", "밖콰라", None, "", "casino 바로", "none"] * 20
    random.Random(1).shuffle(texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    found = {r.i: [(h.word, h.method) for h in r.h] for r in rows.select("i", hits(MATCHER, rows.t).alias("h")).collect()}
    assert found == {i: [(h.keyword.word, h.method) for h in MATCHER.hits(t)] for i, t in enumerate(texts)}
