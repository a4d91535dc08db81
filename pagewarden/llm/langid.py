"""Language identification by multilingual mixture inference.

Each language has a character-trigram model over lower-cased letters (any other character is a word boundary):
trigrams and their contexts are hashed into a fixed number of buckets, and blended with the letters' own
frequencies. Beside the languages stands one model of noise, in which all letters are equally likely. A
document's words get a log-likelihood under each; expectation-maximisation then estimates the proportions of a
mixture. The set starts from the best single language and grows greedily while the log-likelihood rises by more
than a penalty (BIC: half the log of the number of words for each proportion, times ``PENALTY``).

Models are fitted on a bounded sample: ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes per language, of every
language that labels name. A model takes half a megabyte a language; one beyond ``MODEL_BYTES`` is an error.

Ids are integers (cast to long). Defined results: a text that is null or has no letter is ``und`` with score 0.
Without any labelled row everything is ``und``. A text that noise explains best still gets its likeliest
language, with a low score. Extra columns are ignored, or passed through where rows are dropped; repeated rows get
a row each.
"""

from __future__ import annotations

import sys
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import bounded_batches, filter_rows
from pagewarden.llm.sampling import labelled_sample

SAMPLE_ROWS = 400
SAMPLE_BYTES = 2 << 20
MODEL_BYTES = 1 << 30
BUCKETS = 1 << 16
#: How many occurrences the frequencies of single letters stand for.
SMOOTHING = 2.0
PENALTY = 3.0
#: How much more noise must explain to be taken in: few words never prove it.
NOISE_PENALTY = 10.0
STEPS = 25
#: Characters that are looked at in one go, and on to the end of a word; the words of all pieces are pooled.
PIECE = 1 << 16
UNDETERMINED = "und"


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter (Unicode category L)."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def pieces(text: str) -> list[str]:
    """The text in pieces of about ``PIECE`` characters; no word is cut."""
    out, start = [], 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        out.append(text[start:end])
        start = end
    return out


def numbers(alphabet: np.ndarray) -> np.ndarray:
    """The number of every code point: 0 for a boundary, 1 for a letter that the alphabet doesn't have, from 2 on for its own."""
    found = letters().astype(np.int32)
    found[alphabet] = np.arange(2, len(alphabet) + 2)
    return found


def symbols(text: str, numbered: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every letter of a word and the boundary behind it: its number, the buckets of its trigram and of the two before, and where words start."""
    number = numbered[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)]
    at = np.flatnonzero(number[1:] + number[:-1]) + 1  # letters, and what stands behind one
    last, before = number[at], number[at - 1]
    older = np.where(before > 0, number[at - 2], 0)
    pair = older.astype(np.uint64) * np.uint64(kinds) + before.astype(np.uint64)
    triple = pair * np.uint64(kinds) + last.astype(np.uint64)
    bucket = lambda code: ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    return last, bucket(triple), bucket(pair), np.flatnonzero((before == 0) & (last > 0))


class Model:
    """Languages, and what is needed for the probability of a symbol after two others in each."""

    def __init__(self, languages: list[str], alphabet: np.ndarray, triples: np.ndarray, pairs: np.ndarray, singles: np.ndarray, seen: np.ndarray):
        self.languages, self.alphabet = languages, alphabet
        self.triples, self.pairs, self.singles, self.seen = triples, pairs, singles, seen
        self.numbered: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"numbered": None}

    def words(self, text: str | None) -> np.ndarray:
        """Log-likelihood of each word (row) under each language and, last, under noise."""
        if self.numbered is None:
            self.numbered = numbers(self.alphabet)
        parts, noise = [], -np.log(len(self.alphabet) + 2.0)
        for piece in pieces(text or ""):
            number, triple, pair, starts = symbols(piece, self.numbered, len(self.alphabet) + 2)
            if len(starts):
                logs = np.full((len(number), len(self.languages) + 1), noise, np.float32)
                if self.languages:
                    found, rare = self.triples[triple], np.flatnonzero(~self.seen[triple])
                    found[rare] = self.singles[number[rare]]
                    np.subtract(found, self.pairs[pair], out=logs[:, :-1])
                parts.append(np.add.reduceat(logs, starts, axis=0).astype(np.float64))
        return np.concatenate(parts) if parts else np.empty((0, len(self.languages) + 1))

    def mixture(self, logs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the given columns by expectation-maximisation, and the log-likelihood."""
        top = logs.max(axis=1, keepdims=True)
        likely, shares = np.exp(logs - top), start
        for _ in range(STEPS):
            joint = likely * shares
            new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
            done, shares = np.abs(new - shares).max() < 1e-4, new
            if done:
                break
        return shares, float(np.log(likely @ shares).sum() + top.sum())

    def languages_of(self, text: str | None) -> dict[str, float]:
        """The selected languages and their proportions, the largest first. Noise isn't among them; what is missing to 1 is noise."""
        logs = self.words(text)
        if not len(logs) or not self.languages:
            return {}
        totals = logs[:, :-1].sum(axis=0)
        chosen, shares, best = [int(totals.argmax())], np.ones(1), float(totals.max())
        price = np.full(logs.shape[1], PENALTY * 0.5 * np.log(len(logs) + 1))
        price[-1] += NOISE_PENALTY
        while len(chosen) <= len(self.languages):
            now = logs[:, chosen].max(axis=1, keepdims=True)
            gains = np.maximum(logs - now, 0).sum(axis=0)  # no mixture gains more
            found = None
            for k in np.flatnonzero(gains > price).tolist():
                if k not in chosen:
                    tried, score = self.mixture(logs[:, [*chosen, k]], np.append(shares * 0.8, 0.2))
                    if score > best + price[k] and (found is None or score > found[0]):
                        found = score, k, tried
            if found is None:
                break
            best, k, shares = found
            chosen.append(k)
        order = sorted((-s, k) for s, k in zip(shares.tolist(), chosen) if k < len(self.languages))
        return {self.languages[k]: -s for s, k in order}


def fit(sample: list[tuple]) -> Model:
    """A model of (id, text, language) rows."""
    languages = sorted({x for *_, x in sample})
    if len(languages) * BUCKETS * 8 > MODEL_BYTES:
        raise ValueError(f"a model of {len(languages)} languages is too large")
    points = Counter()
    for _, text, _ in sample:
        points.update(set(text.lower()))
    alphabet = np.array(sorted(ord(c) for c in points if c.isalpha()), np.uint32)
    numbered, kinds = numbers(alphabet), len(alphabet) + 2
    triples, pairs = (np.zeros((BUCKETS, len(languages)), np.float32) for _ in range(2))
    singles, last = np.full((kinds, len(languages)), 0.01), np.zeros(BUCKETS, np.int64)
    for _, text, language in sample:
        column = languages.index(language)
        for piece in pieces(text):
            number, triple, pair, _ = symbols(piece, numbered, kinds)
            last[triple] = number  # the symbol that a trigram's bucket ends with
            for counts, found in ((triples, triple), (pairs, pair), (singles, number)):
                counts[:, column] += np.bincount(found, minlength=len(counts))
    own, seen = singles / singles.sum(axis=0), triples.any(axis=1)
    triples = np.log(triples + SMOOTHING * own[last]).astype(np.float32)
    return Model(languages, alphabet, triples, np.log(pairs + SMOOTHING), np.log(SMOOTHING * own).astype(np.float32), seen)


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """A model of a table (id, text, label)."""
    return fit(labelled_sample(labelled.select("id", "text"), labelled.select("id", "label"), rows, size))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, langs) of every row; score is the proportion of the first language."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["id", "lang_pred", "score", "langs"]

    def judged(batches):
        for batch in batches:
            found = [sent.value.languages_of(t.as_py()) for t in batch.column(1)]
            columns = (
                pa.array([next(iter(x), UNDETERMINED) for x in found], pa.string()),
                pa.array([max(0.0, min(1.0, next(iter(x.values()), 0.0))) for x in found], pa.float64()),
                pa.array([list(x) for x in found], pa.list_(pa.string())),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(judged, "id long, lang_pred string, score double, langs array<string>")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 1 / 4) -> DataFrame:
    """The rows whose text languages make up to at least so much of its words, with all columns.

    Texts without a letter go, and those that are noise for the most part: random characters, scripts that no label has.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, text_col, sent, lambda m: lambda text: sum(m.languages_of(text).values()) >= least)
