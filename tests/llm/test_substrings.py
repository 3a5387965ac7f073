import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandspark.llm.substrings import lengths, remove_repeats, removed, repeat_digests, without, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window=35):
    ws = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[p : p + window]) for w in ws for p in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = {q for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def rows_of(df):
    return sorted(((r["doc_id"], r["sub_n_words"], r["sub_n_removed"], r["sub_kept_words"]) for r in df.collect()), key=str)


def test_against_brute_force(docs, rows):
    want = sorted(((x[0], *b) for x, b in zip(rows, brute([x[1] for x in rows]))), key=str)
    assert rows_of(remove_repeats(docs)) == want
    assert any(0 < b < a for _, a, b, _ in want)


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats(spark, seed):
    """Few different words, so that repeats of all lengths, and inside a text, abound."""
    r = random.Random(seed)
    pool = [" ".join(r.choices("abcde", k=r.randint(10, 70))) for _ in range(12)]
    texts = [" ".join(r.choices(pool, k=r.randint(1, 4)) + r.choices("abcdefgh", k=r.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert rows_of(remove_repeats(df)) == sorted(((i, *b) for i, b in enumerate(brute(texts))), key=str)


def test_small_bitmap_is_still_exact(spark, monkeypatch):
    """A full bitmap lets everything through; the last level decides."""
    import strandspark.llm.substrings as S

    r = random.Random(9)
    base = " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=120))
    texts = [base, base[:150] + " x " + base[150:], " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=300))]
    full = S.bitmap_of
    monkeypatch.setattr(S, "bitmap_of", lambda keys, n: full(keys, n) | ~S.np.uint64(0))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(remove_repeats(df)) == sorted(((i, *b) for i, b in enumerate(brute(texts))), key=str)


def test_same_id_different_texts(spark):
    text = " ".join(map(str, range(80)))
    df = spark.createDataFrame([(1, text), (1, "short one"), (2, text)], "doc_id long, text string")
    assert rows_of(remove_repeats(df)) == [(1, 2, 0, "short one"), (1, 80, 80, ""), (2, 80, 80, "")]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=" \n\tab\x0bé", max_size=40), st.randoms())
def test_without_keeps_other_words(text, rnd):
    import numpy as np

    w = WORD.findall(text)
    gone = np.array([rnd.random() < 0.4 for _ in w], bool)
    assert WORD.findall(without(text, gone)) == [x for x, g in zip(w, gone) if not g]
    assert removed(0, None, 35).size == 0


def test_empty(no_docs):
    assert remove_repeats(no_docs).collect() == []
    assert without_repeats(no_docs).collect() == [] == repeat_digests(no_docs).collect()


def test_texts_whose_32_bit_hashes_collide(spark):
    """Without ids a text is known by 128 bits: hashes of 32 bits would mix these two up."""
    from pyspark.sql import functions as F

    r = random.Random(1)
    texts = spark.range(150_000).select(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat_ws("-", "id", i)), " ")).alias("text"))
    pair = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").orderBy("h").first()
    assert pair, "some texts collide"
    a, b = pair["t"][:2]
    rows = [(None, a), (None, b), (1, a), (2, " ".join(r.choices("abc", k=20)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(remove_repeats(df)) == sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]))), key=str)


def test_many_rows_of_one_id(spark):
    """The spans of equal rows are kept once: work grows with their number, not its square."""
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(7, text)] * 20_000 + [(None, text)] * 50 + [(8, "x " + text[:200] + " y"), (9, " ".join(f"v{i}" for i in range(60)))]
    got = rows_of(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    assert [x for x in got if x[0] in (7, None)] == [(7, 90, 90, "")] * 20_000 + [(None, 90, 90, "")] * 50
    assert [x for x in got if x[0] == 9][0][2] == 0


def test_columns_with_the_operators_own_names(spark):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, text, 3, "a", 5), (2, text + " end", 4, "b", 6)], "doc_id long, text string, sub_n_removed int, _spans string, n_chars int")
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert got[1]["sub_n_removed"] == 50 and got[2]["sub_kept_words"] == "end" and got[2]["_spans"] == "b"
    assert sorted(tuple(r) for r in without_repeats(df).collect()) == [(1, "", 3, "a", 0), (2, "end", 4, "b", 3)]


def test_levels_double_up_to_the_window():
    assert lengths(35) == (9, 18) and lengths(100, 10) == (10, 20, 40, 80) and lengths(5) == (5,)


@pytest.mark.parametrize("window", [5, 12, 50])
def test_other_windows(spark, window):
    r = random.Random(window)
    pool = [" ".join(r.choices("abcdefg", k=r.randint(4, 120))) for _ in range(8)]
    texts = [" ".join(r.choices(pool, k=r.randint(1, 3)) + r.choices("abcdefgh", k=r.randint(0, 40))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert rows_of(remove_repeats(df, window=window)) == sorted(((i, *b) for i, b in enumerate(brute(texts, window))), key=str)


def test_query_digest(spark):
    from strandspark.llm.q_substrings import query

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d["doc_id"], n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in zip(docs, brute([d["text"] for d in docs])))
    assert sorted(map(tuple, query(spark, sf).collect())) == want
