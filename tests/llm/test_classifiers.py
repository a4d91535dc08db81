"""Language identification, toxicity and URL filters: held-out accuracy and defined results."""

import itertools
import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from pagewarden.llm import catalog, langid, toxicity, urlfilter

DATA = "/root/testdata/sf0.001"

SF = DATA.replace("0.001", "0.01")


def held_out(spark, name, label):
    found = catalog.QUERIES[name](spark, SF)
    truth = spark.read.parquet(f"{SF}/{'labels' if label == 'toxic' else 'documents'}.parquet").select("doc_id", F.col(label).alias("truth"))
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    return found.join(truth, "doc_id").where("held_out").collect()


def test_language_accuracy(spark):
    rows = held_out(spark, "op6_language_id", "lang")
    assert sum(r.lang_pred == r.truth for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_accuracy(spark):
    rows = held_out(spark, "op5_toxicity", "toxic")
    flagged = [r for r in rows if r.predicted]
    assert all((r.score >= 0.3) == bool(r.predicted) for r in rows)
    assert sum(r.truth for r in flagged) >= 0.8 * len(flagged) and sum(r.truth for r in flagged) >= 0.4 * sum(r.truth for r in rows)


WORDS = {"x": "ba ka ra mi lo", "y": "esch ung lich heit der", "z": "ção nho lhe mente que"}


def text_in(rng, *languages, words=40):
    pick = lambda lang: "".join(rng.choice(WORDS[lang].split()) for _ in range(2))
    return " ".join(pick(rng.choice(languages)) for _ in range(words))


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(3)
    return langid.fit([(i, text_in(rng, lang), lang) for i in range(20) for lang in WORDS])


def test_mixtures(languages):
    rng = random.Random(8)
    assert list(languages.languages_of(text_in(rng, "y"))) == ["y"]
    mixed = languages.languages_of(text_in(rng, "x") + " " + text_in(rng, "z", words=120))
    assert list(mixed) == ["z", "x"] and abs(mixed["x"] - 0.25) < 0.1 and abs(sum(mixed.values()) - 1) < 1e-6


def by_brute_force(model, text):
    """The best set of up to three of all models, by plain expectation-maximisation."""
    logs = model.words(text)
    prices = [langid.PENALTY * 0.5 * math.log(len(logs) + 1)] * len(model.languages) + [langid.PENALTY * 0.5 * math.log(len(logs) + 1) + langid.NOISE_PENALTY]
    best = None
    for size in (1, 2, 3):
        for chosen in itertools.combinations(range(logs.shape[1]), size):
            if chosen == (len(model.languages),):
                continue
            shares = [1 / size] * size
            for _ in range(300):
                totals = [0.0] * size
                for row in logs[:, chosen].tolist():
                    likely = [math.exp(x - max(row)) * s for x, s in zip(row, shares)]
                    totals = [t + x / sum(likely) for t, x in zip(totals, likely)]
                shares = [t / len(logs) for t in totals]
            fit = sum(max(row) + math.log(sum(math.exp(x - max(row)) * s for x, s in zip(row, shares))) for row in logs[:, chosen].tolist())
            value = fit - sum(prices[k] for k in chosen) + min(prices[k] for k in chosen)
            if best is None or value > best[0]:
                best = value, dict(zip(chosen, shares))
    return {model.languages[k]: s for k, s in best[1].items() if k < len(model.languages)}


def test_mixtures_against_brute_force(languages):
    rng = random.Random(11)
    for mixed in (("x",), ("x", "y"), ("y", "z"), ("x", "y", "z")):
        text = " ".join(text_in(rng, lang, words=40) for lang in mixed)
        expected, got = by_brute_force(languages, text), languages.languages_of(text)
        assert set(got) == set(expected) == set(mixed) and all(abs(got[k] - expected[k]) < 0.03 for k in got)


def test_noise_is_no_language(languages, docs):
    rng = random.Random(2)
    junk = " ".join("".join(rng.choice("qjxkvwzb") for _ in range(rng.randint(3, 9))) for _ in range(60))
    assert sum(languages.languages_of(junk).values()) < 0.2 and sum(languages.languages_of("мир " * 40).values()) < 0.2
    rows = [(1, junk), (2, text_in(rng, "x")), (3, "baka"), (4, "мир " * 40), (5, text_in(rng, "y") + " " + junk[:100])]
    assert sorted(r.doc_id for r in langid.keep_identified(docs(rows), languages).collect()) == [2, 3, 5]


def test_letters_of_all_planes_and_no_other_characters(languages):
    assert languages.languages_of("😀 𝟘𝟙 ١٢ ①") == {} and languages.languages_of("𝐛𝐚𝐤𝐚") and languages.languages_of("𐐀")


def test_pieces_cut_no_word(languages, monkeypatch):
    rng = random.Random(9)
    text = text_in(rng, "x", "y", words=400)
    whole = languages.words(text)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert "".join(langid.pieces(text)) == text and len(languages.words(text)) == len(whole) == 400
    assert abs(languages.words(text) - whole).max() < 1e-3


def test_every_label_is_learnt(spark):
    rows = [(10 * k + i, f"w{chr(0x4E00 + k)}{chr(0x5E00 + k)} {i}", f"l{k}") for k in range(600) for i in range(2)]
    model = langid.train(spark.createDataFrame(rows, "id long, text string, label string"))
    assert len(model.languages) == 600 and next(iter(model.languages_of(rows[-1][1]))) == "l599"


def test_language_of_odd_texts(spark, docs, odd, languages):
    got = langid.identify(docs([*odd, (9, "123 --- 456"), (10, "BAKA miLO" * 30_000)]), languages).collect()
    und = {(r.id, r.lang_pred, r.score) for r in got if r.lang_pred == "und"}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (8, "und", 0.0), (9, "und", 0.0)} <= und and len(got) == len(odd) + 2
    assert {r.id: r.lang_pred for r in got}[10] == "x"
    kept = langid.keep_identified(docs(odd), languages)
    assert kept.columns == docs(odd).columns and not {1, 2, 3, 8} & {r.doc_id for r in kept.collect()}
    assert langid.identify(docs([]), languages).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(odd), langid.fit([])).collect()} == {"und"}


def test_training_on_odd_tables(spark, docs, odd):
    rows = docs(odd).select(F.col("doc_id").alias("id"), "text", F.lit("q").alias("label"))
    assert langid.train(rows).languages == ["q"] and langid.train(rows.limit(0)).languages == []


def toxic_sample(n=300, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("th en er an on re in st nd ou ing ly".split()) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        toxic = int(i % 4 == 0)
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["grobian", "schuft", "flegel"]) + rng.choice(["", "ly", "er"])
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity_learns_stems():
    model, test = toxicity.fit(toxic_sample()), toxic_sample(200, 77)
    hits = [(model.score(t) >= 0.3, y) for _, t, y in test]
    assert sum(a == bool(y) for a, y in hits) >= 0.93 * len(hits)


def test_copies_count_once():
    sample = toxic_sample(120)
    copied = [(1000 + i, "uncommonword ordinary tail " * 3, 1) for i in range(50)]
    seen = toxicity.contexts(t for _, t, _ in copied)
    assert seen[0][b" uncommon"] <= 4 and toxicity.contexts(t for _, t, _ in sample)[1] > 1000


def test_windows_and_lengths_by_brute_force():
    model, text = toxicity.fit(toxic_sample()), toxic_sample(3)[0][1] + " " + "again " * 5
    words = [w for k, w in enumerate(toxicity.words_of(text)) if k == 0 or w != toxicity.words_of(text)[k - 1]]
    expected, run = [], []
    for w in words:
        run.append(w)
        if sum(len(x) + 1 for x in run) >= toxicity.WINDOW:
            expected.append(b" " + b" ".join(run) + b" ")
            run = []
    expected += [b" " + b" ".join(run) + b" "] if run else []
    assert list(toxicity.windows(text)) == expected
    found = model.differences(text)
    for w, d in zip(expected, found.tolist()):
        lengths = []
        for content in (model.ordinary, model.toxic):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if model.trained else zstandard.DICT_TYPE_RAWCONTENT)
            lengths.append(len(zstandard.ZstdCompressor(dict_data=made, compression_params=toxicity.shape()).compress(w)))
        assert d == lengths[0] - lengths[1]


def test_few_and_short_texts_are_learnt_from():
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice("a note on the plain state of many small things and their uses in time".split()) for _ in range(8))
    sample = [(i, plain() + (f" you {rng.choice('utter total real'.split())} schuft {rng.choice('now then here'.split())}" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.fit(sample)
    assert model.toxic and model.score(plain() + " you utter schuft now") >= model.score(plain())
    assert toxicity.base_of(["a b"])[0] == b"" and toxicity.fit([(i, "a b", i % 2) for i in range(20)]).score("a b") <= 1


def test_toxicity_of_odd_texts(docs, odd):
    model = toxicity.fit(toxic_sample())
    got = {r.id: r.score for r in toxicity.scores(docs(odd), model).collect() if r.id is not None}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8} and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] == got[3] == got[8]
    assert toxicity.scores(docs([]), model).count() == 0
    one_class = toxicity.fit([(i, "a b c", 0) for i in range(9)])
    assert one_class.score("anything") == one_class.score(None) < 0.2


@pytest.mark.parametrize(
    "url,expected",
    [
        ("http://A.Example.com/En/x?y#z", ("a.example.com", "/En/x")), ("https://a.kr", ("a.kr", "")), ("x://a.kr?b/c", ("a.kr", "")), ("x://a.kr#/c", ("a.kr", "")),
        ("no scheme/x", ("", "")), (None, ("", "")), ("", ("", "")), ("a://b://c/d", ("b:", "//c/d")), ("http://İ.kr/", ("İ.kr", "/")), ("://h/p", ("h", "/p")),
    ],
)
def test_url_parts(url, expected):
    assert urlfilter.parts(url) == expected


@pytest.mark.parametrize(
    "url,expected",
    [
        ("http://a.com/en/1", ("com/en/", "block")), ("http://www.example.com/en/71", ("example.com/en/7", "allow")), ("http://notexample.com/en/71", ("com/en/", "block")),
        ("http://x.net/de/8", ("net/de/", "allow")), ("http://example.net/de/81", ("example.net/de/8", "block")), ("http://a.org/es/", ("org/es/", "block")),
        ("http://a.com/enx", None), ("http://com/en/", ("com/en/", "block")), ("http://com.kr/en/", None), ("http://a.org/es?x", None),
    ],
)
def test_url_rules(url, expected):
    assert urlfilter.Rules(catalog.URL_RULES).fitting(*urlfilter.parts(url)) == expected


def test_markov_probabilities_sum_to_one():
    model = urlfilter.Markov(["abcab", "abd", "bca"])
    for context in ("", "a", "ab", "\0\0\0\0a", "zzzzz"):
        context = context.rjust(5, "\0")
        total = sum(model.probability(context, chr(c)) for c in range(256))
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_url_verdicts(spark):
    rng = random.Random(1)
    good = [f"http://{rng.choice('abcdefgh')}{rng.choice(['news', 'shop', 'blog'])}{rng.randint(1, 99)}.kr/p/{i}" for i in range(300)]
    bad = [f"http://{rng.choice(['lucky', 'win', 'top'])}-casino{rng.randint(1, 99)}.kr/go/{i}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate([*good, *bad, None, "junk", "http://lucky-kasino.kr/go/1"])), "page_id long, url string").selectExpr("*", "'x' as host", "1 as rule")
    ratio = urlfilter.train(pages.where("page_id <> 362"))
    got = {r.id: r for r in urlfilter.judge(pages, [("allow", "kr/go/7")], ratio).collect()}
    assert sum(got[i].verdict == "block" for i in range(300)) <= 1
    ruled = [got[300 + i] for i in range(60) if got[300 + i].rule]
    assert ruled and all(r.verdict == "allow" for r in ruled)
    assert sum(got[300 + i].verdict == "block" for i in range(60)) >= 0.95 * (60 - len(ruled))
    assert (got[360].host, got[360].path, got[360].verdict, got[361].verdict, got[362].verdict) == ("", "", "allow", "allow", "block")
    assert urlfilter.train(pages.where("page_id < 200")) is None
    assert {r.verdict for r in urlfilter.judge(pages, [], None).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), [], ratio).count() == 0
    rules = urlfilter.Rules([("allow", "kr/a"), ("block", "kr/a")])
    assert rules.fitting("x.kr", "/ab") == ("kr/a", "allow")
    long = spark.createDataFrame([(1, "http://lucky-casino1.kr/" + "go/" * 400_000), (2, "http://anews1.kr/" + "p/" * 400_000)], "page_id long, url string")
    assert [len(r.path) for r in urlfilter.judge(long, [], ratio).orderBy("id").collect()] == [1_200_001, 800_001]


def test_url_labels_of_a_table(spark):
    urls = [(f"http://a.kr/{w}/{i}", w != "bad") for i in range(60) for w in ("fine", "good", "bad")]
    labels = spark.createDataFrame([*urls, *urls, *urls[:9] * 50, (None, True), ("http://a.kr/?", None)], "url string, accepted boolean")
    ratio = urlfilter.train(labels, labels=labels)
    assert ratio.score("a.kr/bad/99") > ratio.threshold > ratio.score("a.kr/good/99")


def urls_by_brute_force(spark, labelled):
    """Score function and threshold of plain models of all (url, accepted), which are distinct."""
    h = {r.url: r.h for r in spark.createDataFrame(labelled, "url string, accepted boolean").select("url", F.xxhash64("url").alias("h")).collect()}
    learnt, held = {}, {}
    for kind in (True, False):
        own = [u for u, a in labelled if a == kind]
        low, high = min(h[u] for u in own), max(h[u] for u in own)
        held[kind] = {u for u in own if h[u] == low or h[u] % 3 == 0 and h[u] != high}
        learnt[kind] = urlfilter.Markov(["".join(urlfilter.parts(u)) for u in own if u not in held[kind]])

    def score(url):
        padded = "\0" * urlfilter.ORDER + "".join(urlfilter.parts(url)) + "\1"
        grams = [(padded[i - urlfilter.ORDER : i], padded[i]) for i in range(urlfilter.ORDER, len(padded))]
        return sum(math.log(learnt[False].probability(*g) / learnt[True].probability(*g)) for g in grams) / len(grams)

    good, bad = ([score(u) for u in held[kind]] for kind in (True, False))
    limit = float(np.quantile(good, 1 - urlfilter.FALSE_BLOCKS, method="higher"))
    return score, max(limit, (limit + float(np.quantile(bad, 0.05))) / 2)


def test_url_models_are_of_all_urls(spark):
    """More URLs of a class than any sample had, and some longer."""
    labelled = [(f"http://{i:x}.kr/{i % 7}", True) for i in range(31_000)] + [(f"http://casino{i}.kr/" + "go/" * (i % 5 * 400), False) for i in range(60)]
    table = spark.createDataFrame(labelled, "url string, accepted boolean")
    score, threshold = urls_by_brute_force(spark, labelled)
    ratio = urlfilter.train(table, labels=table)
    assert math.isclose(ratio.threshold, threshold, abs_tol=1e-7)
    new = ["http://7f.kr/3", "http://casino999.kr/go/", "http://x\0y.kr/é😀\0", "http://ZZ.kr", *(u for u, _ in labelled[::3000])]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(new)), "page_id long, url string"), [], ratio).collect()
    assert len(got) == len(new) and all(math.isclose(r.ratio, score(new[r.id]), abs_tol=1e-7) for r in got)
    assert all((r.verdict == "block") == (r.ratio > ratio.threshold) for r in got)


def test_url_models_in_blocks(spark, monkeypatch):
    labelled = [(f"http://{w}{i}.kr/{i % 7}", w == "a") for i in range(40) for w in ("a", "casino")]
    table = spark.createDataFrame(labelled, "url string, accepted boolean")
    rows = [*enumerate(u for u, _ in labelled), (0, labelled[0][0]), (0, labelled[0][0]), (0, "http://b.kr/"), (None, None), (None, None), (90, "no host")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    judged = lambda: sorted(map(repr, urlfilter.judge(pages, catalog.URL_RULES, urlfilter.train(table, labels=table)).collect()))
    whole = judged()
    monkeypatch.setattr(urlfilter, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(urlfilter, "PIECE", 5)
    assert len(whole) == len(rows) and judged() == whole


def test_scores_at_ranks(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([rng.gauss(0, 1), 0.0, -1e-300, 5.0])) for k in (0, 1) for _ in range(500)]
    wanted = [(k, i) for k in (0, 1) for i in (0, 1, 250, 251, 498, 499)]
    by_kind = [sorted(s for k, s in rows if k == kind) for kind in (0, 1)]
    assert urlfilter.at_ranks(spark.createDataFrame(rows, "kind long, score double"), wanted) == [by_kind[k][i] for k, i in wanted]
