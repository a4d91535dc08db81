import random
import re

from pagewarden.llm import decontaminate


HAN = "[\u3040-\u30ff\u4e00-\u9fff]"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(f"({HAN})", r" \1 ", (text or "").lower()))


def shingles(text, size=5):
    found = words(text)
    return {" ".join(found[i : i + size]) for i in range(len(found) - size + 1)}


def brute(docs, items, threshold=0.8):
    out = []
    for d, t in docs:
        for i, item in items:
            size = min(5, len(words(item)))
            s = shingles(item, size) if size else set()
            shared = len(s & shingles(t, size)) if size else 0
            if s and shared >= threshold * len(s) - 1e-9:
                out.append((d, i, len(s), shared))
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 as doc_id", "'x' as lang")


def made(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(30)]
    docs = []
    for d in range(60):
        body = [word() for _ in range(rng.randint(0, 400))]
        for _, text in rng.sample(items, rng.randint(0, 2)):
            part = text.split()
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(body))
            body[at:at] = part
        text = " ".join(body)
        docs.append((d, rng.choice([text, text.upper(), text.replace(" ", "!!\n")])))
    return docs, items


def test_against_brute_force(spark, docs):
    rows, items = made()
    got = decontaminate.contained_items(docs(rows), items_of(spark, items))
    expected = brute(rows, items)
    assert sorted(map(tuple, got.collect()), key=repr) == expected and len(expected) > 15
    left = decontaminate.drop_contaminated(docs(rows), items_of(spark, items))
    assert sorted(r.doc_id for r in left.collect()) == sorted({d for d, _ in rows} - {d for d, *_ in expected}) and left.columns == docs(rows).columns


def test_blocks_of_items_add_up(spark, docs, monkeypatch):
    rows, items = made(9)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert len(list(decontaminate.blocks(items_of(spark, items), "item_id", "text"))) > 3
    assert sorted(map(tuple, decontaminate.contained_items(docs(rows), items_of(spark, items)).collect()), key=repr) == brute(rows, items)
    left = decontaminate.drop_contaminated(docs(rows), items_of(spark, items))
    assert left.count() == len(rows) - len({d for d, *_ in brute(rows, items)})


def test_odd_rows(spark, docs, odd):
    items = [(1, None), (2, ""), (3, "a b c d"), (4, "b c d e a"), (4, "b c d e a"), (None, "e a b c d e"), (5, "?!"), (6, "null id"), (7, "b a")]
    got = decontaminate.contained_items(docs(odd), items_of(spark, items)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(odd, items)
    assert sorted((r.item or 0) for r in got) == [0, 3, 4, 4, 6] and {r.id for r in got} == {5, None}


def test_short_items_and_scripts_without_spaces(spark, docs):
    rows = [(1, "say Hello,\nworld! again"), (2, "hello the world"), (3, "これは試験の問題文です。"), (4, "試験 の 問題 文"), (5, "はこれ"), (6, "x " * 70_000 + "hello world")]
    items = [(1, "hello world"), (2, "試験の問題文"), (3, "again"), (4, "です"), (5, "the")]
    got = decontaminate.contained_items(docs(rows), items_of(spark, items)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, items)
    assert {(r.id, r.item) for r in got} == {(1, 1), (1, 3), (2, 5), (3, 2), (3, 4), (4, 2), (6, 1)}


def test_empty_tables(spark, docs):
    assert decontaminate.contained_items(docs([]), items_of(spark, [(1, "a b c d e")])).count() == 0
    assert decontaminate.contained_items(docs([(1, "a b c d e")]), items_of(spark, [])).count() == 0
    assert decontaminate.drop_contaminated(docs([(1, "a b c d e")]), items_of(spark, [])).count() == 1
