import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewarden.llm import groups, simhash


def brute_fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3 or (ids[a] is not None and ids[a] == ids[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(fps)):
        if ids[k] is not None:
            groups[find(k)] = min(ids[k], groups.get(find(k), ids[k]))
    return [groups.get(find(k)) for k in range(len(fps))]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abAZ é\t\x0b\x1c\n中-", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text_is_counted_in_pieces(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def check(docs, rows):
    got = simhash.near_duplicates(docs(rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    expected = brute_components([i for i, _ in rows], fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, ((i, f, c) for (i, _), f, c in zip(rows, signed, expected))))
    return expected


def test_against_brute_force(docs, corpus):
    assert len(set(check(docs, corpus))) < len(corpus) - 15


def test_odd_rows(docs, odd):
    check(docs, odd)


def test_ids_of_several_texts(docs):
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "red green blue", "north south east west")
    check(docs, [(1, a), (5, a), (5, b), (7, b), (9, c), (3, c), (9, d), (3, a), (11, d), (12, "x y z w"), (12, "v u t s r")])


def test_rows_without_an_id_link_others(docs):
    base = "q w e r t y u i o p a s d f g h j k l z x c v b n m " * 3
    fps = {}
    for k in range(1500):  # texts within three bits of each other in a chain, the middle ones without ids
        fps.setdefault(brute_fingerprint(base + f"tail{k}"), base + f"tail{k}")
    chain = next(
        [fps[a], fps[b], fps[c]] for a in list(fps)[:60] for b in fps if 0 < (a ^ b).bit_count() <= 3 for c in fps if 0 < (b ^ c).bit_count() <= 3 < (a ^ c).bit_count()
    )
    expected = check(docs, [(9, chain[0]), (None, chain[1]), (4, chain[2]), (None, "lone text of its own kind")])
    assert expected == [4, 4, 4, None]


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.drop_near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("radius,segments", [(3, 2), (2, 2), (3, 4), (1, 1)])
def test_links_are_complete(spark, radius, segments):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(p) for p in rng.choice(64 - 1, rng.integers(0, 5), replace=False)) for b in base for _ in range(40)]
    fps = sorted({x if x < 1 << 63 else x - (1 << 64) for x in near})
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, segments)
    mask = (1 << 64) - 1
    expected = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= radius}
    assert {(r.a, r.b) for r in got.collect()} == expected


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 130), 100)}


def test_one_of_each_group_stays(docs, corpus, odd):
    rows = corpus + [(200, corpus[0][1]), (200, corpus[0][1])]
    kept = simhash.drop_near_duplicates(docs(rows))
    ids = [r.doc_id for r in kept.collect()]
    expected = brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    assert sorted(ids) == sorted(set(expected)) and kept.columns == docs(rows).columns
    left = [r.doc_id for r in simhash.drop_near_duplicates(docs(odd)).collect()]
    assert left.count(None) == 2 and left.count(4) == 1
