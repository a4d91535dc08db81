import json

from pagewarden import __main__ as cli
from pagewarden.sources import whitelist


def test_detect_writes_tables_and_reports(spark, tmp_path, capsys):
    url = "https://www.city.go.kr/"
    elements = [{"type": "link", "selector": f"#{h}", "content": "카지노", "href": f"http://{h}.invalid/", "frame_path": [], "frame_url": url} for h in ("my-toto", "fine-toto")]
    (tmp_path / "crawl_1.json").write_text(json.dumps({"meta": {"start_url": url}, "pages": [{"url": url, "final_url": url, "elements": elements}]}, ensure_ascii=False))
    (tmp_path / "white.txt").write_text("# trusted\nhttps://fine-toto.invalid/\n\nfine-toto.invalid\n")
    cli.run(spark, cli.options(["detect", str(tmp_path / "crawl_1.json"), "--out", str(tmp_path / "out"), "--whitelist", str(tmp_path / "white.txt")]))
    report = json.loads((tmp_path / "out" / "crawl_1.json").read_text())
    assert [f["selector"] for f in report["findings"]] == ["#my-toto"] and (tmp_path / "out" / "crawl_1.html").exists()
    assert spark.read.parquet(str(tmp_path / "out" / "tables" / "findings")).count() == 1
    assert "1. [불법광고 의심]" in capsys.readouterr().out


def test_extract(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.kr/", "<p>글자 둘</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    cli.run(spark, cli.options(["extract", str(tmp_path / "p"), "--out", str(tmp_path / "e")]))
    assert spark.read.parquet(str(tmp_path / "e")).first().elements[0].content == "글자 둘"


def test_whitelist_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("B.kr/",), ("http://a.kr",), ("*.c.kr",), ("# no",), ("b.kr",)], "domain string")
    whitelist.write(rows, str(tmp_path / "w"))
    assert whitelist.read(spark, str(tmp_path / "w")) == ["a.kr", "b.kr", "c.kr"]
