import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k int, fp string, size string, key string, spans string, kept string"


def prose(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append("".join(r.choices(["an", "the", "or", "re", "st", "é", "ing", "ou"], k=r.randint(1, 4))) + ("." if i % 9 == 8 else ""))
        out.append("\n" if i % 23 == 22 else " ")
    return "".join(out).strip() + "."


def build() -> list[tuple]:
    """Documents of every awkward kind: null, empty, spaces only, copies, near copies,
    shared passages, repeats, very long, null ids and columns with the operators' own names."""
    r = random.Random(11)
    texts = [prose(r, r.randint(20, 260)) for _ in range(40)]
    passage = prose(r, 60)
    texts += [texts[0], texts[0], texts[1], None, "", " \n\t ", "one", "two words", "A b\x0bc\x1cd e"]
    words = texts[2].split(" ")
    for k in range(6):
        w = list(words)
        w[5 + k] = "changed"
        texts.append(" ".join(w))
    texts += [passage + " " + texts[3], texts[4] + "\n" + passage, texts[5] + " " + passage + " " + texts[6]]
    texts += ["same word " * 60, " | ".join(prose(r, 40).split()), "WOW!! " * 70, "All rights reserved.\n" + texts[7], prose(r, 6000)]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None]), len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, texts[9], None, None, None)]
    return [x + (1, "f", "s", "k", "p", "y") for x in rows]


@pytest.fixture(scope="session")
def rows():
    return build()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
