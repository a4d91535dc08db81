import random
import time
from pathlib import Path

import numpy as np
import pytest

from pagewarden.llm import common, neardup, simhash


def shingle_set(text, size=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_components(rows):
    """By comparing all pairs of texts."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if same or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))]


def check(docs, rows):
    expected = brute_components(rows)
    got = neardup.near_duplicates(docs(rows)).collect()
    assert sorted(map(repr, ((r.id, r.component) for r in got))) == sorted(map(repr, ((i, c) for (i, _), c in zip(rows, expected))))
    return expected


def planted(seed, bases=12, copies=6):
    """Texts with copies in which one or several words are replaced: similarities around 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randint(3, 8)))
    common, out = [word() for _ in range(30)], []
    for b in range(bases):
        words = [word() for _ in range(rng.randint(20, 250))]
        if b % 2:
            words[5:5] = common
        out.append(" ".join(words))
        for _ in range(copies):
            changed = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                changed[rng.randrange(len(changed))] = word()
            out.append(" ".join(changed[rng.randint(0, 3) :]))
    rng.shuffle(out)
    return list(enumerate(out))


def test_planted_near_copies(docs):
    rows = planted(1)
    expected = check(docs, rows)
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(docs(rows)).collect()) == sorted(set(expected))
    assert len(set(expected)) < len({r.doc_id for r in simhash.drop_near_duplicates(docs(rows)).collect()}) - 10


@pytest.mark.parametrize("rounds", [0, 2])
def test_rounds_of_pivots_lose_nothing(docs, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "PAIRS", 0)
    monkeypatch.setattr(neardup, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    check(docs, planted(2, 3, 12))


def test_corpus_and_odd_rows(docs, corpus, odd):
    check(docs, corpus + [(i and i + 1000, t) for i, t in odd] + [(1, "x y z w"), (2, "x Y  z w"), (None, corpus[0][1]), (1, "v u")])


def test_empty_table(docs):
    assert neardup.near_duplicates(docs([])).count() == 0
    assert neardup.drop_near_duplicates(docs([])).count() == 0


def test_stage_of_the_pipeline(spark, docs):
    import corpus_pipeline

    rows = planted(3, 6)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(rows)))


def cluster(size, seed=9):
    """Copies of one text, each with a few words replaced: alike to the original, hardly to each other."""
    rng = random.Random(seed)
    original, out = [f"w{i}" for i in range(300)], []
    for k in range(size):
        words = list(original)
        for _ in range(rng.randint(1, 9) if k else 0):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        out.append(" ".join(words))
    return list(enumerate(out))


def test_pairs_grow_with_a_group_and_not_with_its_square(docs, monkeypatch):
    """All pairs of the group used to be verified."""
    verified, whole = [], neardup.similar

    def similar(pairs, *more):
        verified.append(pairs.count())
        return whole(pairs, *more)

    monkeypatch.setattr(neardup, "similar", similar)
    rows = cluster(80)
    check(docs, rows)
    assert sum(verified) < 80 * 79 / 2 / 3


def test_parities_drop_no_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 7, 300, 5000):
        for changed in (0, 1, n // 10, n // 2):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            b = np.unique(np.concatenate((a[changed:], rng.integers(0, 1 << 63, changed, np.uint64))))
            apart = int(np.bitwise_count((neardup.parities(a) ^ neardup.parities(b)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b))
            assert n != 300 or changed != n // 2 or apart > (len(a) + len(b)) / 9


def test_simhash_names_the_first_pairs(docs, monkeypatch):
    """The stage used to have no fingerprints."""
    verified, whole = [], neardup.similar

    def similar(pairs, *more):
        verified.append({(r.a, r.b) for r in pairs.collect()})
        return whole(pairs, *more)

    monkeypatch.setattr(neardup, "similar", similar)
    rows = [(k, " ".join(f"v{k // 3}{i * (i != 50 * (k % 3))}" for i in range(1, 1500))) for k in range(9)]
    check(docs, rows)
    sets = [(neardup.set_of(neardup.shingles(t, neardup.Hasher(5))), simhash.fingerprint(t)) for _, t in rows]
    expected = {tuple(sorted((a, b))) for a, x in sets for b, y in sets if a != b and (x ^ y).bit_count() <= 3}
    assert expected and verified[0] <= expected and {x for p in verified[0] for x in p} == {x for p in expected for x in p}


def test_what_a_round_needs_leaves_the_disk_with_it(spark, docs):
    """Shuffle files used to stay until the driver collected its garbage, tables of every round until the end of the job."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    app, key = spark.sparkContext.applicationId, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = docs(planted(6, 4))
    before, start, was = shuffled(), len(common.WRITTEN[app]), spark.conf.get(key)
    found = neardup.near_duplicates(rows)
    until = time.time() + 10  # files are deleted in the background
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(key) == was
    there = {p.name.rpartition("-")[0] for p in Path(common.shared_dir(spark).removeprefix("file://")).iterdir() if any(p.name in w for w in common.WRITTEN[app][start:])}
    assert {"sets", "similar"} <= there and not there & {"arrays", "labelled", "open"}
    left = {Path(w).name for w in common.WRITTEN[app]}
    assert not [p for p in Path(common.shared_dir(spark).removeprefix("file://")).glob("arrays-*") if p.name not in left]
    assert found.count() == rows.count()


@pytest.mark.parametrize("most", [10, 28])
def test_few_keys_make_a_small_bitmap(spark, monkeypatch, most):
    """It used to have 2**28 bits for any number of keys."""
    monkeypatch.setattr(common, "BITMAP", most)
    rng = np.random.default_rng(1)
    for n in (0, 1, 700):
        keys, others = rng.integers(-(1 << 63), 1 << 63, n), rng.integers(-(1 << 63), 1 << 63, 20_000)
        bits = common.bitmap(spark.createDataFrame([(int(k),) for k in keys], "h long"))
        assert 64 * len(bits) <= min(1 << most, max(64, 2 * common.BITS_PER_KEY * n)) and common.marked(keys, bits).all()
        assert common.marked(others, bits).mean() <= (0.015 if most == 28 else 0.6)
