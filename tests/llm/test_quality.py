import math
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewarden.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def counts(docs, texts):
    rows = quality.base_counts(docs(list(enumerate(texts)))).orderBy("id").collect()
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab #*\n\t\x0b\x1c é😀\u00a0", max_size=80) | st.lists(st.sampled_from("ab"), max_size=60).map(" ".join), min_size=25, max_size=25))
def test_counts_against_brute_force(docs, texts):
    assert counts(docs, texts) == [brute(t) for t in texts]


def test_counts_of_odd_texts(docs, odd):
    texts = [t for _, t in odd if t is None or len(t) < 1000] + ["x y z w a b c d " * 5, "$|$ " * 9]
    assert counts(docs, texts) == [brute(t) for t in texts]
    (long,) = counts(docs, ["a b c d e " * 20_000])
    assert long == (100_000, 100_000, 0, 0, 100_000)
    assert counts(docs, []) == []


def test_binomial_tail(spark):
    cases = [(n, k, a) for n in (1, 20, 300, 5000) for k in (0, 1, 3, 40) for a in (0.01, 0.05)]
    rows = spark.createDataFrame([(n, k) for n, k, _ in cases], "n long, k long")
    exact = lambda n, k, a: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log1p(-a)) for i in range(k + 1))
    for a in (0.01, 0.05):
        for r in rows.distinct().select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), a).alias("p")).collect():
            expected = 1.0 if r.k > r.n * a else exact(r.n, r.k, a)
            assert math.isclose(r.p, expected, rel_tol=1e-9), (r, a)


def test_thresholds_keep_good_documents(spark):
    rows = [(i, f"w{i} " * 1 + " ".join(f"word{i}x{k}" for k in range(30)), "en" if i % 2 else None, 1) for i in range(1200)]
    rows += [(5000 + i, " ".join(f"wo{k}***" for k in range(30)), "en", 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").withColumn("n_words", F.lit("clash"))
    got = quality.judge(df.drop("quality"), df.select("doc_id", "quality")).join(df.select(F.col("doc_id").alias("id"), "quality"), "id")
    lost = {(r.stratum, r.quality): r.lost for r in got.groupBy("stratum", "quality").agg(F.avg((~F.col("kept")).cast("double")).alias("lost")).collect()}
    assert lost["en", 1] <= quality.ALPHA and lost["", 1] <= quality.ALPHA and lost["en", 0] == 1.0


def test_without_labels_only_base_rules_decide(docs, spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(docs([*odd, (20, " ".join(f"{k}###" for k in range(30)))]), none).collect()
    assert len(got) == len(odd) + 1 and all(r.kept != r.base_failed for r in got) and {r.id: r.kept for r in got}[20]
    assert quality.judge(docs([]), none).count() == 0


def test_few_labels_prove_nothing(docs, spark):
    rows = [(i, " ".join(f"w{i}{k}##" for k in range(30))) for i in range(40)]
    labels = spark.createDataFrame([(i, 1 if i < 39 else None) for i in range(40)], "doc_id long, quality int")
    assert all(r.kept for r in quality.judge(docs(rows), labels).collect())


def test_families_of_strata_lose_too_much_no_oftener_than_delta(spark):
    """Each stratum is a draw of its own: good documents whose scores exceed the cutoffs of step i with a known probability."""
    rng, draws, n = random.Random(6), 400, 150
    limits = quality.CUTOFFS["symbols"]
    rates = [0.002 * 1.6**i for i in range(len(limits))]  # crosses alpha between two steps

    def drawn():
        u = rng.random()
        first = next((i for i, r in enumerate(rates) if u < r), None)  # fails from this step on
        return 0.0 if first is None else limits[first] + 1e-6

    rows = [(str(d), 1000, int(1000 * drawn()), 0, 100, 0, 5000) for d in range(draws) for _ in range(n)]
    good = spark.createDataFrame(rows, "stratum string, n_words long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, word_chars long")
    good = good.withColumn("n_symbols", F.col("n_symbols") + F.when(F.col("n_symbols") > 0, 1).otherwise(0))
    chosen = quality.thresholds(good, {"symbols": limits}, alpha=0.05, delta=0.05 * draws).collect()
    assert len(chosen) > 0.9 * draws
    beyond = sum(rates[r.step] > 0.05 for r in chosen)
    assert beyond <= 0.05 * draws + 3 * math.sqrt(draws * 0.05 * 0.95)


def test_a_hundred_good_documents_choose_a_step(docs, spark):
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(30))) for i in range(100)] + [(500, "***bad*** " * 3 + " ".join(f"##{k}##" for k in range(40)))]
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    got = {r.id: r for r in quality.judge(docs(rows), labels).collect()}
    assert all(got[i].kept for i in range(100)) and not got[500].kept and "symbols" in got[500].failed_rules
