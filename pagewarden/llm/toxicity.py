"""Toxicity by compression distance.

Two zstandard dictionaries are made: one from toxic, one from ordinary text. Both share one base that the
library's trainer makes of ordinary text (entropy tables and common content), and each adds the class's own
segments: words and word beginnings that occur in significantly more contexts of its class than of the other, as
many as fit into ``SEGMENT_BYTES``. A context is a word with its neighbours, so copies of a document count once. A
text is cut into windows of about ``WINDOW`` bytes at word ends; each window is compressed under both
dictionaries, and the difference in length says how much better the toxic one explains it. A logistic
calibration, fitted on labelled rows that the dictionaries haven't seen, turns counts and rates of windows beyond
length thresholds into a score.

The dictionaries and the calibration are fitted on a bounded sample: ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES``
bytes per class, the base on the first ``BASE_TEXT`` bytes of its ordinary rows by the hash of their ids: a quarter
of that at most, or the text as it is where the trainer makes nothing of it. Every whole text is scored.

Ids are integers (cast to long). Defined results: null and empty texts have no window and get the score of that.
Without rows of both classes the score is the smoothed share of toxic rows. Extra columns are ignored; repeated
rows get a row each.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import bounded_batches
from pagewarden.llm.sampling import labelled_sample

SAMPLE_ROWS = 2500
SAMPLE_BYTES = 5 << 20
WINDOW = 32
SHORTEST, LONGEST = 5, 14
#: Bytes of each dictionary: own segments and base; and bytes of text that the base is made of.
SEGMENT_BYTES, BASE_BYTES, BASE_TEXT = 6000, 16384, 2 << 20
TO_SPACE = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
#: Starting repeat offsets that end the header of a trained dictionary (a fixed value of the format).
REPEATS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(TO_SPACE).split()


def windows(text: str | None, least: int = WINDOW) -> Iterable[bytes]:
    """Consecutive runs of whole words of at least so many bytes (the last may be shorter).

    A word that is said again and again counts once, or the window would compress well under anything.
    """
    run, size, last = [], 0, None
    for w in words_of(text):
        if w == last:
            continue
        last = w
        run.append(w)
        size += len(w) + 1
        if size >= least:
            yield b" " + b" ".join(run) + b" "
            run, size = [], 0
    if run:
        yield b" " + b" ".join(run) + b" "


def segments(word: bytes) -> list[bytes]:
    """Beginnings of a word, and the word itself."""
    x = b" " + word
    return [*(x[:k] for k in range(SHORTEST, min(len(x), LONGEST) + 1)), *([x + b" "] if len(x) < 2 * LONGEST else [])]


def contexts(texts: Iterable[str], only: set | None = None) -> tuple[Counter, int]:
    """In how many distinct contexts each segment occurs, and the number of contexts."""
    seen: set[int] = set()
    counts: Counter = Counter()
    for text in texts:
        words = [b"", *words_of(text), b""]
        for triple in zip(words, words[1:], words[2:]):
            key = hash(triple)
            if key not in seen:
                seen.add(key)
                counts.update(segments(triple[1]) if only is None else [s for s in segments(triple[1]) if s in only])
    return counts, len(seen)


def telling(own: Counter, n_own: int, other: Counter, n_other: int) -> list[bytes]:
    """Segments that are significantly more frequent in their own class, the most telling first."""
    least = 2 * math.log(max(len(own), 2)) + 3  # chi-square bound, corrected for the number of segments
    found = []
    for s, a in own.items():
        b = other.get(s, 0)
        if a >= 3 and a * n_other > 4 * b * n_own:
            n = a + b
            expected = n * n_own / (n_own + n_other)
            ratio = 2 * (a * math.log(a / expected) + (b * math.log(b / (n - expected)) if b else 0.0))
            if ratio >= least:
                found.append((ratio * min(len(s), 10), s))
    kept: list[bytes] = []
    for _, s in sorted(found, reverse=True):
        parents = [own[k] for k in kept if k.startswith(s)]
        if not parents or s.endswith(b" ") or own[s] >= 1.5 * max(parents):
            if sum(map(len, kept)) + len(s) > SEGMENT_BYTES:
                break
            kept.append(s)
    return kept


def shape() -> zstandard.ZstdCompressionParameters:
    """How windows are compressed: small frames without any head."""
    return zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0, window_log=17, hash_log=17, chain_log=17,
        search_log=5, target_length=48, min_match=4, strategy=zstandard.STRATEGY_BTOPT,
    )


class Model:
    """Two dictionaries, trained ones or plain content, and the calibration of their differences."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float], trained: bool = True):
        self.toxic, self.ordinary, self.weights, self.trained = toxic, ordinary, weights, trained
        self.compressors: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"compressors": None}

    def differences(self, text: str | None) -> np.ndarray:
        """Per window: bytes that the toxic dictionary saves over the ordinary one."""
        if self.compressors is None:
            kind = zstandard.DICT_TYPE_FULLDICT if self.trained else zstandard.DICT_TYPE_RAWCONTENT
            self.compressors = [
                zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), compression_params=shape()) for d in (self.ordinary, self.toxic)
            ]
        plain, toxic = (c.compress for c in self.compressors)
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], np.int64)

    def features(self, text: str | None) -> list[float]:
        d = self.differences(text)
        n = max(len(d), 1)
        hot = [int((d >= k).sum()) for k in (1, 2, 3)]
        return [1.0, *(math.log1p(h) for h in hot), *(math.sqrt(h / n) for h in hot), float(d.max(initial=0)) / 8, float(hot[1] > 0), float(hot[1] > 1)]

    def score(self, text: str | None) -> float:
        if not self.toxic:
            return self.weights[0]
        z = float(np.dot(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Ridge logistic regression by Newton steps; the first column, the constant, is hardly held."""
    w, held = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    held[0] = 0.01
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (y - p) - held * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def calibrates(doc_id: int) -> bool:
    """Whether a sampled row calibrates; the others train the dictionaries."""
    return zlib.crc32(b"calibrate " + str(doc_id).encode()) % 3 == 0


def base_of(texts: list[str]) -> tuple[bytes, bytes]:
    """Head (entropy tables) and content of a dictionary that is trained on texts; no head where they hold too little.

    It has no toxic text, or both sides would know its words.
    """
    base, held = [], 0
    for text in texts:
        for w in windows(text, 200):
            if held < BASE_TEXT:
                base.append(w)
                held += len(w)
    try:
        trained = zstandard.train_dictionary(min(BASE_BYTES, max(held // 4, 1024)), base, k=32, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"", b"".join(base)
    cut = trained.index(REPEATS) + len(REPEATS)
    return trained[:cut], trained[cut:]


def fit(sample: list[tuple], toxic_share: float | None = None) -> Model:
    """A model of (id, text, label 0 or 1) rows; ``toxic_share`` is the share of label 1 among all labelled rows."""
    texts = {k: [t for i, t, y in sample if y == k and not calibrates(i)] for k in (0, 1)}
    held = [(t, y) for i, t, y in sample if calibrates(i)]
    share = (sum(y for *_, y in sample) + 0.5) / (len(sample) + 1) if toxic_share is None else toxic_share
    if not texts[0] or not texts[1] or len({y for _, y in held}) < 2:
        return Model(b"", b"", [share])
    toxic, n_toxic = contexts(texts[1])
    plain, n_plain = contexts(texts[0], {s for s, c in toxic.items() if c >= 3})
    own = telling(toxic, n_toxic, plain, n_plain)
    plain, n_plain = contexts(texts[0])
    plain = Counter({s: c for s, c in plain.items() if c >= 3})
    others = telling(plain, n_plain, toxic, n_toxic)
    cut, content = base_of(texts[0])

    def dictionary(found: list[bytes]) -> bytes:  # of one length; what stands last is the cheapest to refer to
        return cut + b"".join(reversed(found)).rjust(SEGMENT_BYTES) + content

    model = Model(dictionary(own), dictionary(others), [], bool(cut))
    x, y = np.array([model.features(t) for t, _ in held]), np.array([float(y) for _, y in held])
    model.weights = logistic(x, y)
    drawn = min(max(y.mean(), 1e-3), 1 - 1e-3)  # the sample may hold another share of the classes than the table
    model.weights[0] += math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """A model of documents (id, text) and labels (id, label)."""
    n, toxic = labels.where("label is not null").agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return fit(labelled_sample(docs, labels, rows, size), (toxic + 0.5) / (n + 1))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            found = pa.array([sent.value.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scored, "id long, score double")
