"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit is fitted on hashed
character n-grams (one to three characters), and a text gets the language whose
codeword has the least loss-weighted distance to the bits' margins. A text whose
two best codewords are close is flagged as ambiguous.

Codewords differ in ``least_distance`` bits or more, so two wrong bits can be corrected: beside
a bit of each language's own come balanced splits, drawn until the code is that wide, about twice the
logarithm of the number of languages. No split comes twice, so up to four languages only have the
distance that all splits give (4 for four). A bit's loss weighs by how well its classifier does
on rows that it was not fitted on.

The fit takes a bounded sample of labelled rows: of at most ``max_languages``
languages (those with most rows; ties: first in code point order) one row, the one with the
smallest hash, of each of ``max_rows / languages`` hash buckets. Their feature vectors, no
more than ``max_rows`` whatever the table, go to the driver; prediction reads every
whole text in one pass without a shuffle.

Defined results: null texts and texts without a letter (digits, marks, fractions and
numerals like ``\u2167`` are none) give ``und`` and score 0; with no labelled row every
text does; a null label or id is not learned from; very long texts are read whole, in
blocks; repeated rows are predicted each and learned from once; of equally near codewords
the first language in code point order; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.texts import map_texts

UNDETERMINED = "und"
#: Multipliers of the n-gram hash, one per character of the n-gram.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Characters that are hashed at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class LanguageConfig:
    dims: int = 4096
    max_rows: int = 2048
    max_languages: int = 256
    #: Bits in which any two codewords differ at least, if that many languages allow it.
    least_distance: int = 5
    steps: int = 300
    #: Steps of the two fits on half of the rows that the bits' weights come from.
    trial_steps: int = 100
    rate: float = 0.5
    l2: float = 1e-4
    #: Probability margin under which a prediction is flagged.
    ambiguous_under: float = 0.2
    seed: int = 17


def features(text: str, dims: int) -> np.ndarray:
    """Scaled counts of hashed 1- to 3-grams of the whole lower-cased text."""
    out = np.zeros(dims, np.int64)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    for start in range(0, len(text), BLOCK):
        part = text[max(0, start - 2) : start + BLOCK].lower()
        c = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n, m in enumerate(MULTIPLIERS, 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(31) + c[n - 1 :] * np.uint32(m)
            mixed = h ^ (h >> np.uint32(15))
            out += np.bincount((mixed * np.uint32(0x2C1B3C6D)) >> shift, minlength=dims)
    x = np.sqrt(out.astype(np.float32))
    norm = float(np.linalg.norm(x))
    return x / norm if norm else x


#: Splits drawn for each column of the code; the one that separates most pairs of close codewords is taken.
DRAWN = 32


def codewords(n: int, distance: int, seed: int) -> np.ndarray:
    """(n, bits) of -1 and 1: one bit per language, then balanced splits until any two rows
    differ in ``distance`` bits, or no new split is found."""
    if n == 1:
        return np.ones((1, 1), np.float32)
    code = 2 * np.eye(n, dtype=np.float32) - 1
    rng = np.random.default_rng(seed)
    have: set[bytes] = {(c * c[0]).tobytes() for c in code.T}
    while (close := np.triu((code.shape[1] - code @ code.T) / 2 < distance, 1)).any():
        best, most = None, 0
        for _ in range(DRAWN):
            c = np.where(rng.permutation(n) < (n + 1) // 2, 1, -1).astype(np.float32)
            parted = int((close & (c[:, None] != c[None])).sum())
            if parted > most and (c * c[0]).tobytes() not in have:
                best, most = c, parted
        if best is None:
            break
        have.add((best * best[0]).tobytes())
        code = np.hstack([code, best[:, None]])
    return code


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    #: What each bit's loss counts in decoding.
    trust: np.ndarray
    config: LanguageConfig

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best language, probability) from (rows, bits) margins, by logistic loss."""
        if not len(self.languages):
            return np.full(len(margins), -1), np.zeros(len(margins))
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        x = features(text, self.config.dims)
        best, p = self.decode((np.append(x, np.float32(1)) @ self.weights)[None].astype(np.float64))
        top = np.sort(p[0])[::-1]
        return self.languages[best[0]], float(min(1.0, top[0])), bool(len(top) > 1 and top[0] - top[1] < self.config.ambiguous_under)


def train(x: np.ndarray, y: list[str], config: LanguageConfig) -> LanguageModel:
    """One logistic classifier per code bit; languages weigh the same whatever their number of rows."""
    languages = sorted(set(y))
    if not languages:
        return LanguageModel([], np.zeros((0, 1), np.float32), np.zeros((config.dims + 1, 1), np.float32), np.ones(1), config)
    code = codewords(len(languages), config.least_distance, config.seed)
    at = np.array([languages.index(v) for v in y])
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    return LanguageModel(languages, code, _bits(x, at, code, config, config.steps), _trust(x, at, code, config), config)


def _shares(at: np.ndarray) -> np.ndarray:
    """Weights of the rows: languages count the same."""
    share = (1 / np.bincount(at))[at].astype(np.float32)[:, None]
    return share / share.sum()


def _trust(x: np.ndarray, at: np.ndarray, code: np.ndarray, config: LanguageConfig) -> np.ndarray:
    """Weights of the bits, 1 on average: the part of a coin's loss that a classifier fitted on one half of
    each language's rows saves on the other half; at least a twentieth."""
    order = np.argsort(at, kind="stable")
    nth = np.empty(len(at), np.int64)
    nth[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order])
    odd = nth % 2 == 1
    if len(np.unique(at[odd])) < len(code):  # a language of one row leaves nothing to judge by
        return np.ones(code.shape[1])
    lost = np.zeros(code.shape[1])
    for own, other in ((odd, ~odd), (~odd, odd)):
        margins = code[at[other]] * (x[other] @ _bits(x[own], at[own], code, config, config.trial_steps))
        lost += (np.logaddexp(0, -margins.astype(np.float64)) * _shares(at[other])).sum(0) / 2
    saved = np.maximum(0.05, 1 - lost / np.log(2))
    return saved / saved.mean()


def _bits(x: np.ndarray, at: np.ndarray, code: np.ndarray, config: LanguageConfig, steps: int) -> np.ndarray:
    """One column of weights per code bit, by full-batch gradient steps with momentum."""
    t, share = code[at], _shares(at)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    v = np.zeros_like(w)
    for _ in range(steps):
        g = x.T @ (-t * share / (1 + np.exp(np.clip(t * (x @ w), -30, 30)))) + config.l2 * w
        v = 0.9 * v - config.rate * 10 * g
        w += v
    return w


def fit(docs: DataFrame, trainable: Column, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Fit on the rows of (doc_id, text, lang) for which ``trainable`` holds."""
    own = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    own = own.select("text", "lang", F.xxhash64(F.lit(config.seed), "doc_id", "text").alias("key"))
    rows = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(config.max_languages).collect()
    languages = [r["lang"] for r in rows]
    per = max(1, config.max_rows // max(1, len(languages)))
    own = own.where(F.col("lang").isin(languages)).withColumn("bucket", F.pmod(F.shiftright("key", 20), F.lit(per)))
    picked = [r["key"] for r in own.groupBy("lang", "bucket").agg(F.min("key").alias("key")).select("key").distinct().collect()]
    dims = config.dims

    def run(c: dict[str, list]) -> pa.RecordBatch:
        vec = [features(t, dims).astype(np.float32).tobytes() for t in c["text"]]
        return pa.RecordBatch.from_arrays([pa.array(c["key"], pa.int64()), pa.array(c["lang"], pa.string()), pa.array(c["bucket"], pa.int64()), pa.array(vec, pa.binary())], names=["key", "lang", "bucket", "vec"])

    seen = map_texts(own.where(F.col("key").isin(picked)), run, "key long, lang string, bucket long, vec binary")
    chosen = sorted(tuple(r) for r in seen.groupBy("lang", "bucket").agg(F.min_by("vec", "key").alias("vec")).collect())
    x = np.stack([np.frombuffer(v, np.float32) for _, _, v in chosen]) if chosen else np.zeros((0, dims), np.float32)
    return train(x, [lang for lang, _, _ in chosen], config)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each row of (doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(c: dict[str, list]) -> pa.RecordBatch:
        m = shared.value
        got = [m.predict(t) for t in c["text"]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c["doc_id"], pa.int64()), pa.array(c["held_out"], pa.bool_()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
            names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
        )

    return map_texts(docs.select("doc_id", "text", "held_out"), run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
