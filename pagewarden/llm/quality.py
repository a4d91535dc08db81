"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule scores a document (higher is worse) and has a cutoff at each of a sequence of steps from lenient to strict;
a step turns away what is above any of its cutoffs. On the labelled rows of each stratum, a step is valid if an
exact binomial test rejects, on the good documents that it would turn away, that its false rejection rate exceeds
``alpha``. Steps are tested in order until one fails (fixed sequence), and the level is divided by the number of
strata (Bonferroni). So with probability 1 - ``delta``, no stratum loses more than ``alpha`` of its good documents to
the rules. A stratum without a valid step, which has too few labels (90 good ones are the least for five strata), keeps
all that passes the base rules.

Defined results: null text has no words, fails the base rules and has zero counts. Null and empty strata are one.
Null labels aren't used. A repeated label row counts as the worst of them. Extra columns are ignored; repeated rows get
a row each. Without labels only the base rules decide.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import SPACE_RUN, stored

WINDOW = 8
ALPHA, DELTA = 0.05, 0.05
#: Thresholds are broadcast up to so many strata.
BROADCAST_STRATA = 10_000
#: Rules and their cutoffs at each step, from lenient to strict; a document fails above the cutoff.
CUTOFFS = {
    "symbols": [2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "repeats": [0.28, 0.26, 0.24, 0.22, 0.2, 0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.12],
    "long_words": [60.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0],
    "short_words": [-1.2, -1.5, -1.8, -2.0, -2.2, -2.4, -2.6, -2.8, -3.0, -3.2, -3.5, -3.8],
}


def repeated_words(hashes: Column) -> Column:
    """How many words lie in windows of ``WINDOW`` words that occur twice or more, given the words' hashes."""
    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(F.size(hashes) > WINDOW, windows)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """(id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.lit("") if stratum is None else F.coalesce(stratum.cast("string"), F.lit(""))).alias("stratum"), text.alias("t"))
    trimmed = F.btrim("t", F.lit(" \t\n\x0b\f\r"))
    words = F.when(F.length(trimmed) > 0, F.transform(F.split(trimmed, SPACE_RUN), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "id",
        "stratum",
        F.coalesce(words, F.array().cast("array<long>")).alias("words"),
        lines.alias("lines"),
        (F.char_length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("windows"),
    )
    # Only texts that repeat a window at all sort theirs: equal windows become neighbours.
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("ordered", F.when(some, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    same = lambda i: F.get("ordered", i)["h"] == F.get("ordered", i - 1)["h"]
    repeats = F.filter(
        F.transform("ordered", lambda x, i: F.when(F.coalesce(same(i), F.lit(False)) | F.coalesce(same(i + 1), F.lit(False)), x["at"])),
        lambda x: x.isNotNull(),
    )
    rows = rows.withColumn("at", F.sort_array(repeats))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, x: F.struct((s["n"] + F.least(F.lit(WINDOW), x - s["last"])).cast("long").alias("n"), x.alias("last")),
        lambda s: s["n"],
    )
    return rows.select("id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_scores() -> dict[str, Column]:
    """The rules' scores from the base counts."""
    ratio = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {
        "symbols": ratio("n_symbols", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "long_words": ratio("word_chars", "n_words"),
        "short_words": -ratio("word_chars", "n_words"),
    }


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for a binomial X with k at most ``n * rate``; 1 above that, where it can't be small."""
    odds = F.log(F.lit(rate / (1 - rate)))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + odds
        top = F.greatest(term, s["total"])
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(term, s["total"]) - top))).alias("total"))

    first = n.cast("double") * F.log1p(F.lit(-rate))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    tail = F.exp(F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda s: s["total"]))
    return F.when(k.cast("double") > n.cast("double") * rate, 1.0).otherwise(tail)


def thresholds(good: DataFrame, cutoffs: dict[str, list[float]] = CUTOFFS, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, step, one column per rule): the cutoffs of the strictest valid step of each stratum that has one.

    ``good`` holds the base counts of the labelled good documents.
    """
    steps, scores = range(len(next(iter(cutoffs.values())))), rule_scores()
    above = [reduce(or_, [scores[rule] > F.lit(values[i]) for rule, values in cutoffs.items()]) for i in steps]
    counts = stored(good.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(a).alias(f"k_{i}") for i, a in enumerate(above)]), "rejections")
    tests = F.array(*[
        F.struct(F.lit(i).alias("step"), F.col(f"k_{i}").alias("k"), *[F.lit(values[i]).alias(rule) for rule, values in cutoffs.items()]) for i in steps
    ])
    tested = counts.select("stratum", "n", F.inline(tests))
    valid = tested.where(binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / max(1, counts.count()))
    # Cutoffs never grow from step to step, so k never falls, and the valid steps are the first ones.
    return valid.groupBy("stratum").agg(F.max(F.struct("step", *cutoffs)).alias("last")).select("stratum", "last.*")


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality",
    alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """The base counts with base_failed, the names of the failed rules, and kept."""
    counts = stored(base_counts(docs, id_col, text_col, F.col(stratum_col)), "counts")
    good = labels.where(F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(good_col).alias("good")).where("good = 1")
    found = stored(thresholds(counts.where(~base_failed()).join(good, "id", "left_semi"), alpha=alpha, delta=delta), "thresholds")
    if found.count() <= BROADCAST_STRATA:
        found = F.broadcast(found)
    joined = counts.join(found, "stratum", "left")
    failed = F.filter(F.array(*[F.when(s > F.col(r), F.lit(r)) for r, s in rule_scores().items()]), lambda x: x.isNotNull())
    judged = joined.select(*counts.columns, base_failed().alias("base_failed"), failed.alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
