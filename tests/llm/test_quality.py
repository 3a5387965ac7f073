import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from strandspark.llm.quality import LINE_SEED, Judge, LineRules, clean_lines, common_lines, judge, keep_clean, signed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_signals(docs, rows):
    got = sorted((tuple(r)[:7] for r in clean_lines(docs).collect()), key=str)
    assert got == sorted(((x[0], *base(x[1])) for x in rows), key=str)


def test_rules_and_verdicts(docs):
    by_text = {r["cleaned"]: r for r in clean_lines(docs).collect()}
    assert not any("All rights reserved" in t for t in by_text)
    rows = clean_lines(docs).collect()
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert all(r["kept"] == (100 * r["n_words_removed"] <= LineRules().max_loss_percent * r["n_words"]) for r in rows if not r["base_failed"])
    assert any(r["n_words_removed"] == r["n_words"] >= 50 for r in rows)


def test_keep_clean_keeps_columns_and_clean_texts(docs, rows):
    kept = keep_clean(docs)
    assert kept.columns == docs.columns
    want = [r["doc_id"] for r in clean_lines(docs).collect() if r["kept"]]
    got = kept.collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["n_chars"] is not None)
    by_id = {x[0]: x[1] for x in rows}
    assert sum(r["text"] == by_id[r["doc_id"]] for r in got) >= len(got) - 2


def test_empty(no_docs):
    assert clean_lines(no_docs).collect() == [] and keep_clean(no_docs).collect() == []


def hashed(lines):
    return {signed(xxhash.xxh64_intdigest(x.encode(), LINE_SEED)) for x in lines}


def found(docs, rules=LineRules()):
    return {r["line"] for r in common_lines(docs, rules=rules).collect()}


def brute_common(texts, rules=LineRules()):
    """A line's texts, each known by its smallest other line in the order of the MD5."""
    company = {}
    for t in {t for t in texts if t is not None}:
        lines = sorted((hashlib.md5(x.encode()).hexdigest(), x) for x in {x for x in t.split("\n") if WORD.search(x)})
        for h, x in lines:
            company.setdefault(x, []).append(next((g for g, _ in lines if g != h), None))
    return {x for x, v in company.items() if len(v) >= rules.common_least and 100 * len(set(v)) >= rules.company_percent * len(v)}


def test_common_lines_against_brute_force(spark):
    """A line of many unlike texts is boilerplate; the lines of a text with many copies, exact
    or near, are not, nor is a refrain inside one text or its copies."""
    r = random.Random(3)
    line = lambda n: " ".join(r.choices(["ab", "cd", "ef", "gh"], k=n)) + "."
    texts = ["\n".join([line(9), "Footer of all.", " \t", line(8)]) for _ in range(60)]
    copied = [line(9) for _ in range(6)]
    texts += ["\n".join(copied)] * 200 + ["\n".join([*copied[: i % 6], f"one {i}", *copied[i % 6 + 1 :]]) for i in range(300)]
    texts += [None, "", "\n\n", "Footer of all."] + ["x.\nHead\n" * (i + 1) for i in range(19)]
    song = "\n".join(x for _ in range(40) for x in (line(8), "And this is the refrain of the song."))
    texts += [song, song, song]
    df = spark.createDataFrame([(i if i % 50 else None, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, line int, k1 string").repartition(4)
    want = brute_common(texts)
    assert found(df) == hashed(want)
    assert "Footer of all." in want and not want & set(copied) and not want & set(song.split("\n"))
    assert found(df.limit(0)) == set()


@pytest.mark.parametrize("n", [500, 3000])
def test_small_footer_is_found_at_any_size(spark, n):
    """Fifty documents have a footer, whatever the size of the table."""
    r = random.Random(n)
    line = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(9)) + "."
    rows = [(i, "\n".join([*(line() for _ in range(7)), *(["A small site."] if i < 50 else [])])) for i in range(n)]
    got = clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_lines_removed > 0").collect()
    assert {x["doc_id"]: (x["n_lines_removed"], x["kept"]) for x in got} == {i: (1, True) for i in range(50)}


def test_joined_lines_give_the_same_results(spark):
    """Beyond ``most_broadcast`` the common lines are joined."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("common", F.lit(1)).withColumn("_k1", F.lit("x"))
    docs = docs.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    joined = LineRules(most_broadcast=0)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(clean_lines(docs, rules=joined)) == rows(clean_lines(docs))
    assert rows(keep_clean(docs, rules=joined)) == rows(keep_clean(docs))
    assert keep_clean(docs, rules=joined).columns == docs.columns


def test_refrain_stays_and_footer_goes(spark):
    """Sixty documents, one with a refrain of thirty times, all with a footer."""
    r = random.Random(5)
    line = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(9)) + "."
    plain = ["\n".join([line() for _ in range(12)] + ["Our footer stands here."]) for _ in range(59)]
    song = "\n".join(x for _ in range(30) for x in (line(), "This is the refrain of it.")) + "\nOur footer stands here."
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*plain, song])], "doc_id long, text string")
    got = {x["doc_id"]: x for x in clean_lines(df).collect()}
    assert got[59]["kept"] and got[59]["cleaned"].count("refrain") == 30
    assert all(x["n_lines_removed"] == 1 and "footer" not in x["cleaned"] for x in got.values())


def test_whole_table_of_common_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_common([r["text"] for r in docs.select("text").collect()])
    assert want and found(docs) == hashed(want)


W = "one two three four five six seven eight nine"


@pytest.mark.parametrize("line,fails", [
    (W + " ten", True), (W, False), (W + " ten.", False), (W + " ten.\r", False), (W + " ten\u2026", False), (W + "\uff01 " + "tail " * 39, False), (W + ". " + "tail " * 40, True),
    ("Home | About us | Contact", True), ("Home \u203a Shop \u203a Shoes", True), ("a and/or b", False), ("WOW!! BUY!! now!!", True), ("Cost is $5 in all of the shops here.", False),
    ("Alle Rechte vorbehalten.", True), ("Tous droits r\u00e9serv\u00e9s", True), ("(c) the footer", True), ("the footer", False),
])
def test_rules_of_lines(line, fails):
    by = Judge(LineRules(), frozenset(hashed(["(c) the footer"])))
    assert by.fails(line.encode(), line.encode().split()) == fails


def test_removed_lines_and_loss():
    by = Judge(LineRules())
    good = "This line is a sentence, and it ends. " * 6
    text = "\n".join([good.strip(), "Home | About | Contact", good.strip() + " ", "Powered by x"])
    n, *_, failed, kept, lines, lost, cleaned = judge(text, by)
    assert (failed, lines, lost) == (True, 2, 8) and cleaned == good.strip() + "\n" + good.strip() + " "  # the same sentence, over and over
    words = [f"w{i}" for i in range(70)]
    half = " ".join(words) + ".\n" + " ".join(f"v{i}" for i in range(70))
    assert judge(half, by)[5:9] == (False, False, 1, 70) and judge(" ".join(words) + ".\n" + " ".join(words[:20]), by)[5:7] == (False, True)
