"""The queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pagewarden.llm import bpe, decontaminate, langid, line_dedup, lmscore, quality, simhash, toxicity, urlfilter, warc
from pagewarden.llm.common import remainder, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its oracle SQL when there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query(
    r"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    w AS (
      SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS s
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)
    ),
    later AS (
      SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k
        FROM w WHERE regexp_matches(s, '[^\x20\x09-\x0D]')
      ) WHERE k > 1
    ),
    covered AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (VALUES (0), (1), (2)) t(k)),
    kept AS (
      SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
      FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l) ANTI JOIN covered USING (doc_id, i)
      GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(n, 0))::BIGINT AS n_removed,
      CASE WHEN d.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS text_md5
    FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id)
    """
)
def op1_line_dedup(spark, sf_dir):
    """Lines of every document, how many are later occurrences, and the digest of the text without them."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def item_words(source: str) -> str:
    """SQL: the words of a text, every character of an unspaced script one of its own."""
    apart = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in decontaminate.UNSPACED)
    return rf"regexp_extract_all(regexp_replace(lower({source}), '([{apart}])', ' \1 ', 'g'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    rf"""
    WITH d AS (SELECT doc_id, {item_words("text")} AS ws FROM documents),
    b AS (SELECT item_id, ws, least(len(ws), 5) AS k FROM (SELECT item_id, {item_words("text")} AS ws FROM benchmark) WHERE len(ws) > 0),
    ds AS (
      SELECT DISTINCT doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))
    ),
    bs AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
    n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
    SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*)::DOUBLE / n_shingles AS containment
    FROM bs JOIN n USING (item_id) JOIN ds USING (k, s)
    GROUP BY doc_id, item_id, n_shingles
    HAVING count(*) >= 0.8 * n_shingles
    """
)
def op4_benchmark_decontamination(spark, sf_dir):
    """Documents that contain a benchmark item to 0.8 or more of its shingles."""
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    share = F.col("n_shared").cast("double") / F.col("n_shingles")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared", share.alias("containment"))


@query()
def op8_byte_bpe(spark, sf_dir):
    """Token count and digests of the ids and of the decoded bytes of every document."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return found.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op10_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


@query()
def op5_toxicity(spark, sf_dir):
    """Toxicity of every document, learnt from the labels of rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    model = toxicity.train(docs.select(F.col("doc_id").alias("id"), "text"), learn.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    return toxicity.scores(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(remainder(F.col("id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def language_model(docs):
    """The model that op6 and the pipeline use: learnt from rows that aren't held out."""
    learn = docs.where((remainder(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull())
    return langid.train(learn.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))


@query()
def op6_language_id(spark, sf_dir):
    """The languages of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, language_model(docs)).select(
        F.col("id").alias("doc_id"),
        F.coalesce(remainder(F.col("id"), 5) == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        F.array_join("langs", " ").alias("langs"),
    )


def op7_sql() -> str:
    """Base counts by plain SQL, and the thresholds by the exact binomial distribution."""
    names = list(quality.CUTOFFS)
    steps = " UNION ALL ".join(f"SELECT {i} AS step, " + ", ".join(f"{c}::DOUBLE AS {n}" for n, c in zip(names, row)) for i, row in enumerate(zip(*quality.CUTOFFS.values())))
    scores = {
        "symbols": "n_symbols::DOUBLE / greatest(n_words, 1)",
        "dup_lines": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
        "repeats": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
        "long_words": "word_chars::DOUBLE / greatest(n_words, 1)",
        "short_words": "-(word_chars::DOUBLE / greatest(n_words, 1))",
    }
    above, rate = " OR ".join(f"{s} > {n}" for n, s in scores.items()), quality.ALPHA
    return rf"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
    l AS (
      SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ),
    g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
    r AS (
      SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1), range(0, 8) x(k)
      GROUP BY doc_id
    ),
    c AS (
      SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
    ),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
    good AS (
      SELECT * FROM b WHERE NOT base_failed
      AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)
    ),
    steps AS ({steps}),
    tests AS (
      SELECT stratum, step, count(*) AS n, count(*) FILTER ({above}) AS k, (SELECT count(DISTINCT stratum) FROM good) AS strata
      FROM good, steps GROUP BY stratum, step
    ),
    tails AS (
      SELECT stratum, step, strata,
        CASE WHEN k > n * {rate!r} THEN 1 ELSE
          list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r}))))
        END AS p
      FROM tests
    ),
    chosen AS (SELECT stratum, max(step) AS step FROM tails WHERE p <= {quality.DELTA!r} / strata GROUP BY stratum),
    failed AS (SELECT DISTINCT doc_id FROM b JOIN chosen USING (stratum) JOIN steps USING (step) WHERE {above})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
    FROM b
    """


@query(op7_sql())
def op7_quality_rules(spark, sf_dir):
    """Base counts and verdict of every document."""
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def page_of(column: str):
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


@query()
def op9_warc(spark, sf_dir):
    """The records of all pages, read back from the archives that were written."""
    return warc.round_trip(table(spark, sf_dir, "pages")).where("reason is null").select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to")
    )


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


@query()
def op3_url_filters(spark, sf_dir):
    """The verdict on the url of every page."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, URL_RULES, urlfilter.train(pages)).withColumnRenamed("id", "page_id")


@query()
def op2_lm_scoring(spark, sf_dir):
    """Losses of every document under models of good documents and of the corpus, and their difference."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.score(table(spark, sf_dir, "documents"), good).withColumnRenamed("id", "doc_id")
