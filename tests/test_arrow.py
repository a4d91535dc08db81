"""Arrow UDFs run once for each row, in bounded batches."""

import pytest
from pyspark.sql import functions as F

from pagewarden.functions import matching, reflection, urls
from pagewarden.functions.matching import Matcher
from pagewarden.plans import cases, catalog, detect
from pagewarden.sources import sitemap
from pagewarden.sources.batches import ROWS

DATA = "/root/testdata/sf0.001"


def calls(df, name):
    """How often a UDF is called for a row."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.count(f"{name}(") for line in plan.splitlines() if "ArrowEvalPython" in line)


@pytest.mark.parametrize("query", ["evidence_score", "evidence_summary", "summary_grouping_sets", "label_confusion", "same_spot_argmax"])
def test_documents_are_matched_once(spark, query):
    assert calls(catalog.QUERIES[query](spark, DATA), "hits_of") == 1


def test_links_are_joined_once(spark):
    assert calls(catalog.QUERIES["content_links"](spark, DATA), "_joined") == 1


def test_documents_of_sitemaps_are_parsed_once(spark):
    bodies = spark.createDataFrame([("http://a.kr/x", bytearray(b"<rss/>"))], "url string, body binary")
    read = bodies.select("url", sitemap.parsed(F.col("body"), F.col("url")).alias("p")).where("p.kind <> ''").select("url", "p.*")
    assert calls(read, "one") == 1


def test_elements_are_matched_once(spark, monkeypatch):
    kept, stored = {}, detect.stored
    monkeypatch.setattr(detect, "stored", lambda df, label: kept.setdefault(label, df) and stored(df, label))
    detect.page_findings(cases.crawls(spark, DATA))
    assert calls(kept["scored"], "hits_of") == 1 and calls(kept["scored"], "told") == 1
    assert calls(kept["stuffed"], "measured") == 1
    assert calls(kept["findings"], "hits_of") == 2  # snapshots and what they are compared with
    assert calls(kept["findings"], "measured") == 0


@pytest.mark.parametrize("column", [
    lambda t: matching.hits(Matcher(), t), lambda t: sitemap.parsed(t.cast("binary"), t), lambda t: sitemap.locations(t, t), lambda t: urls.resolved(t, t),
])
def test_batches_are_bounded(spark, column):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        column(F.col("text"))
        assert int(spark.conf.get(key)) <= ROWS
    finally:
        spark.conf.set(key, before)


def test_outside_is_stripped_text_and_its_words(value):
    got = value(reflection.outside(Matcher(), F.col("text"), F.col("values")), text="카 지 노 먹튀 글", values=["카지노"])
    assert (got.text.split(), got.words) == (["먹튀", "글"], 1)
    assert tuple(value(reflection.outside(Matcher(), F.col("text"), F.lit(None).cast("array<string>")), text="먹튀")) == (None, 0)
