import json

from pyspark.sql import functions as F

from pagewarden.functions import sql
from pagewarden.operators import screens
from pagewarden.plans import detect
from pagewarden.sources import crawl
from pagewarden.streaming import jobs


def document(i):
    url = f"https://www.city.go.kr/{i}"
    element = {"type": "link", "selector": "#a", "content": f"카지노 {i}", "href": "http://my-toto.invalid/", "frame_path": [], "frame_url": url}
    return {"meta": {"start_url": url}, "pages": [{"url": url, "final_url": url, "elements": [element]}]}


def test_stream_of_crawls_equals_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(document(i), ensure_ascii=False))
    stream = jobs.crawl_stream(spark, str(tmp_path / "in"), per_trigger=1)
    jobs.detect_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((r.page_url, r.content, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = detect.page_findings(crawl.read(spark, str(tmp_path / "in")))
    assert got == sorted((r.page_url, r.content, r.score) for r in batch.collect()) and len(got) == 3


def test_throttle_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, 429 if i % 3 else 200, "9" if i == 4 else "", False) for i in range(9)] + [("b", i, 403, "", False) for i in range(5)]
    visits = spark.createDataFrame(rows, "site string, seq long, status int, retry_after string, limited boolean")
    for k in range(2):
        visits.where((F.col("seq") < 5) == (k == 0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(visits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    q = jobs.throttle_stream(stream).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.site, r.seq, r.delay_sec, r.wait_sec, r.stops) for r in spark.table("throttled").collect())
    full = visits.select("*", F.lit("http://a/x").alias("url"), F.lit("").alias("final_url"), F.lit("").alias("title"), F.lit("").alias("text"))
    assert got == sorted((r.site, r.seq, r.delay_sec, r.wait_sec, r.stops) for r in screens.backed_off(screens.throttled(full)).collect())


def test_sessions_over_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    q = jobs.sessions(timed).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r.user_id, r.start) for r in jobs.sessions(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    got = {(r.user_id, r.start) for r in spark.table("sessions").collect()}
    assert got and got <= batch  # sessions within the watermark are still open


def test_sql_names(spark):
    assert sql.register(spark) == ["ad_hits", "ad_spans", "ad_normalize", "query_params", "extract_elements", "parse_feed"]
    found = spark.sql("SELECT type, content, href FROM extract_elements('<a href=/x>글</a>', 'http://a.kr/') ORDER BY ord").collect()
    assert [tuple(r) for r in found] == [("link", "글", "http://a.kr/x")]
    feed = spark.sql("SELECT kind, url, title FROM parse_feed(CAST('<rss><item><title>t</title><link>/1</link></item></rss>' AS BINARY), 'http://a.kr/')").collect()
    assert [tuple(r) for r in feed] == [("rss", "http://a.kr/1", "t")]
    row = spark.sql("SELECT ad_hits('밖콰라')[0].method AS m, ad_normalize('ⓐ') AS n, query_params('http://a/?b=c')[0].value AS v, size(ad_spans('카지노')) AS s").first()
    assert (row.m, row.n, row.v, row.s) == ("sound", "a", "c", 1)
