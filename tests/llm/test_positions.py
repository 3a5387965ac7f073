import hashlib
import random
import re

from pyspark.sql import functions as F
from strandspark.llm.positions import build_index, contamination, dictionary, documents_of, exact_matches, near_matches, phrases, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(UP))


def windows(text, k=10):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def brute(docs, items, k=10):
    own = {}
    for i, t in items:
        own.setdefault("" if i is None else str(i), set()).update(windows(t, k))
    out = []
    for d, text in docs:
        w = tokens(text)
        hit, names = set(), set()
        for name, wins in own.items():
            for win in wins:
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        names.add(name)
        text = ",".join(sorted(names, key=str.encode))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def generated(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "é", "É", "The", "the", "z1", "ß", "on", "in"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ". ", "\n", "-", "_", " "]) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 9, 10, 11, 30]))) for i in range(30)]
    items += [(3, text(12)), (40, items[5][1]), (41, None), (42, "... --"), (None, text(12)), (None, text(4)), (100, items[7][1].upper()), (43, "")]
    docs = [(i, text(r.randint(0, 80))) for i in range(40)]
    for i in range(30):
        docs.append((100 + i, text(5) + str(r.choice(items)[1]) + " " + text(5)))
    docs += [(docs[50]), (docs[50]), (None, docs[60][1]), (None, None), (7, ""), (7, items[3][1]), (8, "  .. "), (9, ". a b"), (10, " ".join(["the"] * 400)), (11, text(9000) + items[9][1])]
    return docs, items


def test_words(spark):
    for text in ("", "A b", "...", " Ünï-Code_É9 x y ", "a\x00b", "İstanbul I"):
        row = spark.createDataFrame([(text,)], "t string").select(words(F.col("t")).alias("w")).first()
        assert row["w"] == tokens(text)


def test_against_brute_force(spark):
    for seed, k in ((1, 10), (2, 3)):
        docs, items = generated(seed)
        d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, term string, row int").repartition(5)
        i = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, phrase string").repartition(3)
        got = [tuple(r) for r in contamination(d, i, k).collect()]
        assert sorted(got, key=str) == brute(docs, items, k)


def test_documents_of_the_corpus(spark, docs, rows):
    """Awkward documents, with passages of them as items."""
    picked = [(n, " ".join((t or "").split()[20:55])) for n, t in [(r[0], r[1]) for r in rows[:6]]]
    items = spark.createDataFrame(picked, "item_id long, text string")
    got = [tuple(r) for r in contamination(docs, items).collect()]
    assert sorted(got, key=str) == brute([(r[0], r[1]) for r in rows], picked)
    assert sum(r[5] for r in got) >= 8


def test_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination(no_docs, items).collect() == []
    none = contamination(docs, items.limit(0)).collect()
    assert len(none) == docs.count() and not any(r["contaminated"] or r["n_items"] for r in none)
    assert contamination(no_docs, items.limit(0)).collect() == []


def test_index_holds_what_is_asked_for(spark):
    docs = spark.createDataFrame([(5, "x a b a"), (6, "c c")], "doc_id long, text string")
    terms = dictionary(spark.createDataFrame([("A c",)], "text string"), "text")
    number = {r["word"]: r["term"] for r in terms.collect()}
    index = build_index(docs, terms)
    ends = {r["row"]: (r["id"], r["n_words"]) for r in documents_of(index).collect()}
    assert sorted(ends.values()) == [(5, 4), (6, 2)]
    got = sorted((ends[r["row"]][0], r["pos"], r["term"]) for r in index.where("term >= 0").collect())
    assert got == [(5, 1, number["a"]), (5, 3, number["a"]), (6, 0, number["c"]), (6, 1, number["c"])]


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    from strandspark.llm import positions

    docs, items = generated(3)
    monkeypatch.setattr(positions, "MAX_BROADCAST_TERMS", 0)
    monkeypatch.setattr(positions, "MAX_BROADCAST_ROWS", 0)
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in contamination(d, i).collect()), key=str) == brute(docs, items)


def brute_near(docs, items, k, span):
    wins = {w for _, t in items for w in windows(t, k)}
    out = set()
    for d, text in docs:
        w = tokens(text)
        for win in wins:
            need = set(win)
            for s in range(len(w)):
                if w[s] in need and need <= set(w[s : s + span]):
                    out.add((d, win, s))
    return out


def test_proximity(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choices("abcdefghijklm", k=n))
    docs = [(i, text(r.randint(0, 60))) for i in range(25)] + [(90, "a b " * 80)]
    items = [(i, text(r.randint(1, 7))) for i in range(12)] + [(50, "a b"), (51, "zz a")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    terms = dictionary(i, "text")
    windows_, _ = phrases(i, 4)
    index = build_index(d, terms)
    name = {x["row"]: x["id"] for x in documents_of(index).collect()}
    word = {x["phrase"]: tuple(x["words"]) for x in windows_.collect()}
    for span in (4, 7):
        got = [(name[x["row"]], word[x["phrase"]], x["start"]) for x in near_matches(index, windows_, terms, span).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_near(docs, items, 4, span)
    exact = {(name[x["row"]], word[x["phrase"]], x["start"]) for x in exact_matches(index, windows_, terms).collect()}
    want = {(n, w, s) for n, t in docs for w in word.values() for s in range(len(tokens(t)) - len(w) + 1) if tuple(tokens(t)[s : s + len(w)]) == w}
    assert exact == want


def test_plan_is_native(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
