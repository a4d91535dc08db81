"""Command line: ``python -m pagewarden detect CRAWL.json --out FOLDER`` and ``python -m pagewarden extract PAGES.parquet --out FOLDER``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from pagewarden.operators.evidence import Settings
from pagewarden.plans import shared
from pagewarden.sources import crawl, exports, html, whitelist


def options(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="pagewarden")
    commands = parser.add_subparsers(dest="command", required=True)
    detect = commands.add_parser("detect", help="find illegal advertising in stored crawls")
    detect.add_argument("crawls", help="crawl documents: a file, a folder or a pattern")
    detect.add_argument("--out", required=True, help="folder for the tables, and for reports of each crawl")
    detect.add_argument("--format", choices=["tables", "reports", "both"], default="both")
    detect.add_argument("--high-score", type=int, default=5)
    detect.add_argument("--suspect-score", type=int, default=4)
    detect.add_argument("--min-evidence", type=int, default=2)
    detect.add_argument("--trust", action="append", default=[], metavar="DOMAIN")
    detect.add_argument("--whitelist", help="a file of trusted domains")
    extract = commands.add_parser("extract", help="turn a table of pages (page_id, url, html) into elements")
    extract.add_argument("pages")
    extract.add_argument("--out", required=True)
    return parser.parse_args(args)


def run(spark: SparkSession, chosen: argparse.Namespace) -> None:
    if chosen.command == "extract":
        html.pages_from_html(spark.read.parquet(chosen.pages)).write.mode("overwrite").parquet(chosen.out)
        return
    trusted = chosen.trust + (whitelist.read(spark, chosen.whitelist) if chosen.whitelist else [])
    settings = Settings(chosen.high_score, chosen.suspect_score, chosen.min_evidence, trusted)
    crawls = crawl.read(spark, chosen.crawls)
    if chosen.format != "reports":
        exports.save_tables(exports.tables(crawls, settings), f"{chosen.out}/tables")
    if chosen.format != "tables":
        for row in crawls.select("crawl_id").toLocalIterator():
            report = exports.report(crawls, row.crawl_id, settings)
            name = f"{chosen.out}/{Path(row.crawl_id).stem}"
            for ending, data in ((".json", exports.to_json(report).encode()), (".csv", exports.to_csv(report)), (".html", exports.to_html(report).encode())):
                shared.write_file(spark, name + ending, data)
            print(*exports.to_console(report), *report["figures"], sep="\n")
            shared.forget(spark)


if __name__ == "__main__":
    run(SparkSession.builder.appName("pagewarden").getOrCreate(), options())
