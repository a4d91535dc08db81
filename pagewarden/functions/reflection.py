"""URL parameters that a page echoes."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pagewarden.functions.arrow import once
from pagewarden.functions.domains import suspicion_of
from pagewarden.functions.matching import Matcher
from pagewarden.functions.urls import params_of, query

PARAMS = "array<struct<name:string,value:string,words:array<string>,bad:boolean>>"


def params(matcher: Matcher, addresses: Column) -> Column:
    """The distinct parameters of an array of URLs, in order, with their dictionary words and whether they are bad."""

    def judged(p: dict[str, str]) -> dict:
        words = [k.word for k in matcher.words(p["value"])]
        try:
            name = urlsplit(p["value"]).hostname or p["value"]
        except ValueError:
            name = p["value"]
        return {**p, "words": words, "bad": bool(words) or suspicion_of(name) is not None}

    @pandas_udf(PARAMS)
    def found(urls: pd.Series) -> pd.Series:
        def one(us):
            if us is None:
                return []
            every = {(p["name"], p["value"]): p for u in reversed(us) for p in reversed(params_of(u))}
            return [judged(p) for p in reversed(every.values())]

        return urls.map(one)

    return once(found)(F.when(F.exists(addresses, lambda u: query(u) != ""), addresses))  # null costs nothing


def squeezed(text: Column) -> Column:
    """Lower-cased, without white space."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def reflected(params: Column, text: Column) -> Column:
    """The bad parameters whose value, of two characters or more, the text contains."""
    content = squeezed(text)
    return F.filter(params, lambda p: p["bad"] & (F.length(squeezed(p["value"])) >= 2) & F.contains(content, squeezed(p["value"])))


def _without(text: str, values) -> str | None:
    if values is None:
        return None
    for v in values:
        letters = re.sub(r"\s+", "", v).lower()
        if letters:
            text = re.sub(r"\s*".join(map(re.escape, letters)), " ", text, flags=re.IGNORECASE)
    return text


def _stripped(texts: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([_without(t or "", v) for t, v in zip(texts, values)], dtype=object)


def stripped(text: Column, values: Column) -> Column:
    """The text without the values, however they are spaced; null for null values."""
    return once(pandas_udf(_stripped, "string"))(text, values)


def outside(matcher: Matcher, text: Column, values: Column) -> Column:
    """struct(text, words): the stripped text, and how many dictionary words it holds."""

    @pandas_udf("struct<text:string,words:int>")
    def told(texts: pd.Series, values_: pd.Series) -> pd.DataFrame:
        left = [_without(t or "", v) for t, v in zip(texts, values_)]
        return pd.DataFrame({"text": pd.Series(left, dtype=object), "words": pd.Series([len(matcher.spans(t)) if t else 0 for t in left], dtype="int32")})

    return once(told)(text, values)
