import re

from pagewarden.llm.line_dedup import dedup_lines


def brute(rows):
    seen, out = {}, {}
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: r[:2])
    starts = {}
    for known, i, t in order:
        lines = t.split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if re.search(r"[^\x20\x09-\x0D]", "".join(w)):
                if w in seen:
                    starts.setdefault((known, i, t), set()).update(range(k, k + 3))
                seen.setdefault(w, (i, k))
    for known, i, t in order:
        gone = starts.get((known, i, t), set())
        out[(i if known else None, t)] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)
    return out


def check(docs, rows):
    df = docs(rows)
    got = dedup_lines(df)
    assert got.columns[: len(df.columns)] == df.columns
    expected, found = brute(rows), got.collect()
    assert len(found) == len(rows)
    by_result = sorted(repr((r.doc_id, r.text, r.n_removed)) for r in found)
    assert by_result == sorted(repr((i, None, 0) if t is None else (i, *expected[i, t])) for i, t in rows)
    return {r.doc_id: r for r in found}


def test_against_brute_force(docs, corpus):
    got = check(docs, corpus)
    assert sum(r.n_removed for r in got.values()) > 50


def test_odd_rows(docs, odd):
    got = check(docs, odd)
    assert got[6].text == "A\nB\nC" and got[8].n_removed == 0 and got[1].n_lines == 0


def test_overlapping_windows_merge(docs):
    got = check(docs, [(1, "x\na\na\na\na\na"), (2, "y\na\na\na\nz")])
    assert got[1].text == "x\na" and got[2].text == "y\nz"


def test_empty_table(docs):
    assert dedup_lines(docs([])).count() == 0


def test_clashing_result_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string").selectExpr("*", "5 as n_lines", "6 as N_removed")
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "N_removed", "n_lines_", "n_removed_"]
    assert [(r.text, r[2], r[5]) for r in got.orderBy("doc_id").collect()] == [("a\nb\nc", 5, 0), ("", 5, 3)]
