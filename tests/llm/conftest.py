import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h1 long, `_pw_lines` string, fp string, bucket int, id string, twin string"


@pytest.fixture
def docs(spark):
    """Builds a documents table, with extra columns whose names operators might use themselves."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "x", "f", 1, "y", "z") for i, t in rows], COLUMNS)

    return build


#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "a b c d e " * 20_000), (None, "null id here"), (None, None), (6, "A\nB\nC\nA\nB\nC"), (7, "é" * 30_000), (8, "\n" * 50)]


@pytest.fixture
def odd():
    return list(ODD)


@pytest.fixture
def corpus():
    """Texts with copies, near copies, shared passages and repeated lines."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7)))
    line = lambda n=8: " ".join(word() for _ in range(n))
    passage = [line() for _ in range(4)]
    out = []
    for i in range(120):
        lines = [line(rng.randint(1, 12)) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            lines[1:1] = passage[: rng.randint(2, 4)]
        out.append("\n".join(lines))
    out += [out[i] for i in range(0, 40, 4)]
    for i in range(5, 45, 4):
        words = (out[i] * 6).split(" ")
        words[rng.randrange(len(words))] = word()
        out += [out[i] * 6, " ".join(words)]
    return list(enumerate(out))
