"""The engine's functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from pagewarden.functions import matching, urls
from pagewarden.functions.matching import Matcher
from pagewarden.sources import html, sitemap

ELEMENTS = "ord int, type string, selector string, content string, href string, src string, hidden boolean, hidden_reasons array<string>, links array<string>"
ITEMS = "kind string, is_child boolean, ord int, url string, title string"


class ExtractElements:
    """Rows of the elements of a page."""

    def eval(self, page: str, base: str):
        for i, r in enumerate(html.extract(page, base)[2]):
            found = [r.get(c) for c in ("type", "selector", "content", "href", "src")]
            yield Row(i, *found, bool(r.get("hidden")), r.get("hidden_reasons") or [], r.get("links") or [])


class ParseFeed:
    """Rows of the addresses that a sitemap or feed lists."""

    def eval(self, body: bytes, base: str):
        found = sitemap.parse(bytes(body or b""), base or "")
        listed = [(False, i["url"], i["title"]) for i in found["items"]] + [(True, u, "") for u in found["children"]]
        for i, (below, url, title) in enumerate(listed):
            yield Row(found["kind"], below, i, url, title)


def register(spark: SparkSession, matcher: Matcher | None = None) -> list[str]:
    """Make the functions known to ``spark.sql``; returns their names.

    Scalar: ad_hits, ad_spans, ad_normalize, query_params. Tables: extract_elements(html, base), parse_feed(body, base).
    """
    matcher = matcher or Matcher()

    @pandas_udf(urls.PARAMS)
    def query_params(found: pd.Series) -> pd.Series:
        return found.map(urls.params_of)

    scalar = {"ad_hits": matching.hits_udf(matcher), "ad_spans": matching.spans_udf(matcher), "ad_normalize": matching.normalized_udf(matcher), "query_params": query_params}
    tables = {"extract_elements": udtf(ExtractElements, returnType=ELEMENTS), "parse_feed": udtf(ParseFeed, returnType=ITEMS)}
    for name, f in scalar.items():
        spark.udf.register(name, f)
    for name, f in tables.items():
        spark.udtf.register(name, f)
    return [*scalar, *tables]
