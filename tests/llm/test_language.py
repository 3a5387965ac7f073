import math
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.llm.language import MULTIPLIERS, LanguageConfig, LanguageModel, codewords, features, fit, predict, train
from strandspark.llm.q_language import query


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(out) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.97
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect())]


def test_awkward_rows(docs, no_docs, spark):
    config = LanguageConfig(steps=20)
    own = docs.withColumn("held_out", F.lit(False))
    model = fit(own, ~F.col("held_out"), config)
    assert set(model.languages) == {"en", "fr"}
    rows = predict(own, model).collect()
    assert len(rows) == docs.count()
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if not (texts[r["doc_id"]] or "").strip())
    nothing = fit(no_docs.withColumn("held_out", F.lit(False)), F.lit(True), config)
    assert {r["lang_pred"] for r in predict(own, nothing).collect()} == {"und"}
    one = fit(own.where("lang = 'en'"), F.lit(True), config)
    assert {r["lang_pred"] for r in predict(own, one).collect()} == {"und", "en"}
    assert predict(no_docs.withColumn("held_out", F.lit(False)), model).collect() == []


@pytest.mark.parametrize("n,least", [(1, 0), (2, 2), (3, 2), (4, 4), (5, 5), (6, 5), (7, 5), (20, 5), (97, 5), (256, 5)])
def test_codewords_differ(n, least):
    code = codewords(n, 5, 1)
    apart = ((code.shape[1] - code @ code.T) / 2)[~np.eye(n, dtype=bool)]
    assert n == 1 or apart.min() >= least
    assert len({tuple(c * c[0]) for c in code.T}) == (code.shape[1] if n > 2 else 1)
    assert code.shape[1] <= n + 4 + 3 * math.log2(n)


@pytest.mark.parametrize("n", [5, 20, 256])
def test_wrong_bits_are_corrected(n):
    """Any two bits may be wrong."""
    code = codewords(n, 5, 3)
    bits = code.shape[1]
    model = LanguageModel([f"l{i:03d}" for i in range(n)], code, np.zeros((1, bits), np.float32), np.ones(bits), LanguageConfig())
    rng = np.random.default_rng(n)
    at = np.arange(n).repeat(20)
    margins = 3.0 * code[at]
    for row in margins:
        row[rng.choice(bits, 2, replace=False)] *= -1
    assert (model.decode(margins)[0] == at).all()


def test_bits_weigh_by_their_classifiers():
    """A bit that cannot be learned counts less; a noisy one is outvoted."""
    rng = np.random.default_rng(1)
    at = np.arange(6).repeat(40)
    x = np.eye(6, 32, dtype=np.float32)[at]
    x[at < 2] = np.eye(1, 32, dtype=np.float32)  # two languages that look alike
    x += rng.normal(0, 0.05, x.shape).astype(np.float32)
    model = train(x, [f"l{i}" for i in at], LanguageConfig(dims=32))
    assert model.trust.mean() == pytest.approx(1) and max(model.trust[:2]) < min(model.trust[2:6])
    assert (train(x[::40], [f"l{i}" for i in range(6)], LanguageConfig(dims=32)).trust == 1).all()


def test_features_do_not_depend_on_blocks(monkeypatch):
    import strandspark.llm.language as L

    text = "Ein längerer Text mit vielen Wörtern " * 50
    whole = features(text, 256)
    monkeypatch.setattr(L, "BLOCK", 100)
    parts = features(text, 256)
    assert np.dot(whole, parts) > 0.99


def brute_features(text, dims):
    """Counts of 1- to 3-grams by a plain loop; square roots, scaled to length 1."""
    out = [0] * dims
    shift = 32 - (dims.bit_length() - 1)
    c = [ord(x) for x in text.lower()]
    for i in range(len(c)):
        for n in (1, 2, 3):
            if i + n <= len(c):
                h = 0
                for x, m in zip(c[i : i + n], MULTIPLIERS):
                    h = (h * 31 + x * m) % 2**32
                out[(((h ^ h >> 15) * 0x2C1B3C6D) % 2**32) >> shift] += 1
    norm = math.sqrt(sum(out))
    return [math.sqrt(x) / norm if norm else 0.0 for x in out]


def brute_predict(model, text):
    if not text or not model.languages or not any(unicodedata.category(c).startswith("L") for c in text):
        return "und", 0.0
    x = [*brute_features(text, model.config.dims), 1.0]
    margins = [sum(a * float(w) for a, w in zip(x, col)) for col in model.weights.T]
    loss = [sum(w * math.log1p(math.exp(-float(c) * m)) for c, m, w in zip(code, margins, model.trust)) for code in model.code]
    p = [math.exp(min(loss) - v) for v in loss]
    return model.languages[loss.index(min(loss))], max(p) / sum(p)


TEXTS = ["The cat sat on the mat.", "Der Hund läuft über die Straße!", "été à la plage", "½ ² Ⅷ 123 ... _", "", None, "12 a", "漢字", "ÀÉ", "٣ ٤", "xxxx " * 50, "\u0301"]


def test_against_brute_force(spark):
    for text in TEXTS[:4] + TEXTS[6:]:
        assert np.allclose(features(text, 256), brute_features(text, 256), atol=1e-5)
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de")] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit(False))
    model = fit(df, ~F.col("held_out"), LanguageConfig(dims=256, steps=60))
    asked = spark.createDataFrame([(i, t, False) for i, t in enumerate(TEXTS)], "doc_id long, text string, held_out boolean")
    for r in predict(asked, model).collect():
        lang, score = brute_predict(model, TEXTS[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4), TEXTS[r["doc_id"]]


def test_numbers_are_no_letters():
    model = train(np.eye(2, 16, dtype=np.float32), ["a", "b"], LanguageConfig(dims=16, steps=1))
    assert [model.predict(t)[0] for t in ("½", "²³", "Ⅷ", "12 _ ٣", "\u0301")] == ["und"] * 5
    assert model.predict("ß")[0] != "und" and isinstance(model, LanguageModel)


def test_fit_is_bounded(spark, monkeypatch):
    """Copies of one id, and more languages than the fit may have."""
    import strandspark.llm.language as L

    seen = []
    monkeypatch.setattr(L, "train", lambda x, y, c: seen.append((x.shape, sorted(set(y)))) or train(x, y, c))
    rows = [(1, "the same text", "en")] * 3000 + [(i, f"other text {i}", f"l{i % 40:02d}") for i in range(2, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fit(df, F.lit(True), LanguageConfig(dims=64, steps=2, max_rows=60, max_languages=10))
    (shape, languages), = seen
    assert shape[0] <= 60 and len(languages) == 10 and "en" in languages


def test_reruns_and_order_agree(spark):
    rows = [(i, f"text {i % 50} und so", "de" if i % 3 else "en") for i in range(400)]
    make = lambda n: fit(spark.createDataFrame(rows[:: 1 if n < 3 else -1], "doc_id long, text string, lang string").repartition(n), F.lit(True), LanguageConfig(dims=64, steps=5, max_rows=40))
    assert (make(1).weights == make(5).weights).all()
