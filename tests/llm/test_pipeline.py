"""The pipeline against a plain version of its stages."""

import hashlib

import numpy as np

import corpus_pipeline
from strandspark.llm.mixing import mix
from strandspark.llm.pieces import PieceModel
from strandspark.llm.q_mixing import BUDGET, EPOCHS, SEED, WEIGHTS
from strandspark.llm.q_pieces import vocabulary
from strandspark.llm.quality import Judge, LineRules, judge
from strandspark.llm.substrings import without
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_quality import brute_common, hashed
from tests.llm.test_substrings import WORD


def plain_substrings(texts):
    from collections import Counter

    ws = [WORD.findall(t) for t in texts]
    seen = Counter(tuple(w[p : p + 35]) for w in ws for p in range(len(w) - 34))
    out = []
    for t, w in zip(texts, ws):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 34):
            if seen[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = True
        out.append(without(t, gone) if gone.any() else t)
    return out


def test_run(spark):
    import xxhash

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    by = Judge(LineRules(), frozenset(hashed(brute_common([r["text"] for r in rows]))))
    docs = []
    for r in rows:
        j = judge(r["text"], by)
        if j[6]:
            docs.append((r["doc_id"], j[9], r["source"]))
    stay = set(brute_kept([(i, t) for i, t, _ in docs])[0])
    assert len({i for i, _, _ in docs}) == len(docs)
    docs = [d for d in docs if d[0] in stay]
    docs = [(i, t, s) for (i, _, s), t in zip(docs, plain_substrings([t for _, t, _ in docs]))]
    copies = {r["doc_id"]: r["copies"] for r in mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), WEIGHTS, BUDGET, EPOCHS, SEED).collect()}
    library = PieceModel(vocabulary()).library
    want = []
    for i, t, _ in docs:
        ids = library.encode(t, add_bos=True, add_eos=True)
        row = i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        want += [row] * copies[i]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(want)


def test_stages_keep_columns(spark, docs, no_docs):
    for empty in (False, True):
        d = (no_docs if empty else docs).select("doc_id", "text", "lang", "source", "n_chars", "size", "k")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d2 = stage(spark, d, "")
            assert d2.columns == d.columns, name
            d = spark.createDataFrame(d2.collect(), d.schema)
            assert empty == (d.count() == 0), name
        assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() == d.count()


def test_stages_with_awkward_column_names(spark, docs):
    names = ["doc_id", "text", "lang", "source", "n_chars", "__span_key", "_span_key", "_key", "a.b", "c d", "node", "root"]
    d = docs.select("doc_id", "text", "lang", "source", "n_chars", *["k"] * 7).toDF(*names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == names, name
        rows = out.collect()
        assert rows and {r["a.b"] for r in rows} == {1} and {r["__span_key"] for r in rows} == {1}, name
