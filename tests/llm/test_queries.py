"""The queries against their oracles, and the pipeline stage by stage."""

import hashlib
import re

import duckdb
import pytest

import corpus_pipeline
from pagewarden.llm import catalog

DATA = "/root/testdata/sf0.001"

SF = DATA.replace("0.001", "0.01")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, expected = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and len(got)
    tidy = lambda f: sorted(map(repr, (tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in f[sorted(f.columns)].itertuples(index=False))))
    assert tidy(got) == tidy(expected)


def shingle_set(text):
    words = text.encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES) == list(range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF).persist())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    assert all(t.columns == docs.columns for t in tables[:5])
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    assert len(rows[1]) >= 0.99 * len(rows[0])
    changed = [i for i in rows[2] if rows[2][i].text != rows[1][i].text]
    assert changed and all(rows[2][i].n_chars == len(rows[2][i].text) for i in changed) and all(rows[2][i] == rows[1][i] for i in set(rows[2]) - set(changed))
    sets = {i: shingle_set(r.text) for i, r in rows[2].items()}
    alike = {frozenset((i, j)) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    kept = set(rows[3])
    gone = set(rows[2]) - kept
    assert gone and not any(pair <= kept for pair in alike) and gone <= {i for pair in alike for i in pair}
    leaks = {r.doc_id for r in catalog.op4_benchmark_decontamination(spark, SF).collect()}
    assert leaks & set(rows[3]) == set(rows[3]) - set(rows[4])
    for i, r in rows[5].items():
        text = rows[4][i].text.encode()
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest() and r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()
    assert set(rows[5]) == set(rows[4])


def test_pipeline_query_is_the_stages(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and got.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, docs, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [*odd, *[(100 + i, f"the and of in to is the word {i} that was for with on as") for i in range(3)]]
    got, none = stage(spark, docs(rows), DATA), stage(spark, docs([]), DATA)
    if name == "byte_bpe":
        assert got.count() == len(rows) and none.count() == 0
        return
    assert got.columns == docs([]).columns and none.columns == got.columns and none.count() == 0
    ids = sorted((r.doc_id for r in got.collect() if r.doc_id is not None))
    if name == "language_id":
        assert not {1, 2, 3, 8} & set(ids) and {100, 101, 102} <= set(ids)
    elif name == "simhash_near_dedup":
        assert ids == sorted(set(ids)) and got.where("doc_id is null").count() == 2
    elif name == "line_dedup":
        assert {1, 2, 3, 4, 5, 6, 7, 8, 100, 101, 102} == set(ids) and got.where("doc_id = 6").first().text == "A\nB\nC"
    else:
        assert len(ids) == len([i for i, _ in rows if i is not None])
