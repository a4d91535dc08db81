import math
import random
from collections import Counter, defaultdict

from pagewarden.llm import lmscore

START, END = 0xFFFE, 0xFFFF


def tokens(text):
    data = (text or "").encode("utf-16-le")
    return [int.from_bytes(data[k : k + 2], "little") for k in range(0, len(data), 2)] + [END]


def model(texts, vocabulary):
    counts = defaultdict(Counter)
    for t in texts:
        padded = [START] * 3 + tokens(t)
        for i in range(3, len(padded)):
            for k in range(4):
                counts[tuple(padded[i - k : i])][padded[i]] += 1

    def probability(context, token):
        own = counts[()]
        p = (own[token] + 1) / (sum(own.values()) + len(vocabulary))
        for k in (1, 2, 3):
            seen = counts.get(tuple(context[3 - k :]))
            if seen:
                p = (seen[token] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    return probability


def brute(rows, target, folds):
    vocabulary = {x for _, t in rows for x in tokens(t)}
    out = []
    for i, t in rows:
        others = [(j, u) for j, u in rows if folds[j] != folds[i]]
        own, every = model([u for j, u in others if j in target], vocabulary), model([u for _, u in others], vocabulary)
        padded = [START] * 3 + tokens(t)
        bits = [[-math.log2(m(padded[k - 3 : k], padded[k])) for k in range(3, len(padded))] for m in (own, every)]
        n = len(padded) - 3
        out.append((i, n, sum(bits[0]) / n, sum(bits[1]) / n))
    return out


def folds_of(spark, rows):
    ids = spark.createDataFrame([(i,) for i, _ in rows], "id long")
    return {r.id: r.fold for r in ids.select("id", lmscore.fold_of(ids.id).alias("fold")).collect()}


def check(docs, spark, rows, target):
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    got = sorted(((r.id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lmscore.score(docs(rows), ids).collect()), key=repr)
    folds = folds_of(spark, rows)
    assert len(set(folds.values())) == lmscore.FOLDS
    expected = sorted(brute(rows, set(target) - {None}, folds), key=repr)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    for g, e in zip(got, expected):
        assert math.isclose(g[2], e[2], rel_tol=1e-6) and math.isclose(g[3], e[3], rel_tol=1e-6) and math.isclose(g[4], e[2] - e[3], abs_tol=1e-5)


ROWS = [(1, "the cat sat"), (2, "the bat sat 😀é"), (3, "###***###"), (4, None), (5, ""), (6, "tha\n" * 40), (6, "tha\n" * 40), (7, "中文 the 😀😁"), (None, "the sat")]


def test_against_brute_force(docs, spark):
    check(docs, spark, ROWS, [1, 2, 6, None])


def test_without_target(docs, spark):
    check(docs, spark, ROWS, [])


def test_blocks_add_up(docs, spark, monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 600)
    check(docs, spark, ROWS, [1, 3])


def test_counts_in_bounded_memory(docs, spark, monkeypatch):
    monkeypatch.setattr(lmscore, "GATHERED", 5)
    monkeypatch.setattr(lmscore, "HELD", 8)
    check(docs, spark, ROWS, [2, 7])


def test_target_documents_get_no_better_scores_for_having_been_counted(docs, spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(120))) for i in range(80)]
    found = {r.id: r.score for r in lmscore.score(docs(rows), spark.createDataFrame([(i,) for i in range(0, 80, 2)], "x long")).collect()}
    counted, others = (sorted(s for i, s in found.items() if i % 2 == k) for k in (0, 1))
    assert abs(counted[20] - others[20]) < 0.1


def test_empty_table_and_odd_rows(docs, spark, odd):
    ids = spark.createDataFrame([(5,)], "x long")
    assert lmscore.score(docs([]), ids).count() == 0
    assert lmscore.score(docs(odd), ids).count() == len(odd)
