"""SimHash near-duplicates with a pigeonring filter.

A document's fingerprint has a bit where over half of its shingle hashes have it.
Exact copies share a fingerprint, so links are sought among distinct fingerprints
only, and components are of fingerprints, whether their documents have ids or not.

Filter: the 64 bits lie on a ring of ``SEGMENTS`` segments. If two fingerprints
differ in at most ``t`` bits, some segment starts a chain whose cumulative
differences stay within ``l * t / SEGMENTS`` for every length ``l``. The first
budget is 0, so the segment itself is a join key; the second allows one bit, so
one half of the next segment is equal too and narrows the key. Joined pairs then
have to keep the chain's budgets before the full Hamming distance is taken.

Defined results: a text without a word has fingerprint 0 and links like any
other; a text shorter than a shingle is one shingle; very long texts are hashed
whole, in blocks; documents without an id link and are linked through like any other,
but their ids are nobody's: a component without any id has a null component id;
repeated rows are returned each; an empty table gives an empty one; other columns
are not looked at.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.texts import map_texts
from strandspark.operators.graph import components
from strandspark.runtime import fewer, written

SEED = 42
SEGMENTS = 4
WIDTH = 64 // SEGMENTS
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Shingles hashed at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a whole text, as an unsigned 64-bit number."""
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        part = w[k : k + BLOCK + shingle - 1] if n > 1 else w
        grams = [b" ".join(g) for g in zip(*(part[i:] for i in range(shingle)))] if n > 1 else [b" ".join(w)]
        h = np.array([digest(g, SEED) for g in grams], "<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def majority(h: np.ndarray) -> int:
    """Fingerprint of hashes that are at hand: a bit is set where over half of them have it."""
    sums = np.zeros(64, np.int64)
    for k in range(0, len(h), BLOCK):
        part = np.ascontiguousarray(h[k : k + BLOCK], "<u8")
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long of the same bits."""

    def run(c: dict[str, list]) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in c["text"]], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def chain_keys(fp: Column) -> Column:
    """Keys of a fingerprint: (chain start, its segment, one half of the next segment)."""
    keys = []
    half = WIDTH // 2
    for i in range(SEGMENTS):
        own, after = _segment(fp, i), _segment(fp, i + 1)
        for j in range(2):
            part = F.shiftrightunsigned(after, half * j).bitwiseAND(F.lit((1 << half) - 1))
            keys.append(own + part * (1 << WIDTH) + F.lit((i * 2 + j) << (WIDTH + half)))
    return F.array(*[k.cast("long") for k in keys])


def chain_viable(bits: list[Column], distance: int, longest: int | None = None) -> Column:
    """Some chain of segments on the ring keeps every budget: ``bits`` are the segments'
    differences, ``longest`` the segments of a chain (default: all)."""
    n = len(bits)
    out = F.lit(False)
    for i in range(n):
        total, ok = F.lit(0), F.lit(True)
        for k in range(longest or n):
            total = total + bits[(i + k) % n]
            ok = ok & (total <= (k + 1) * distance // n)
        out = out | ok
    return out


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(u, v) node pairs of rows (node, fp) whose fingerprints are distinct and within
    ``distance`` bits; u > v. A pair may come more than once."""
    if distance >= SEGMENTS:
        raise ValueError("the keys hold for distances under the number of segments")
    keyed = distinct.select("node", "fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    a, b = keyed.select("key", F.col("node").alias("u"), F.col("fp").alias("a")), keyed.select("key", F.col("node").alias("v"), F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = a.join(b, "key").where((F.col("u") > F.col("v")) & chain_viable([F.bit_count(_segment(x, i)) for i in range(SEGMENTS)], distance))
    return pairs.where(F.bit_count(x) <= distance).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) of every document; n_links counts
    the other fingerprints within ``distance``."""
    own = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    n = own.count()
    distinct = written(fewer(own.groupBy("fp").agg(F.min("doc_id").alias("least")), n), "distinct-fingerprints")
    edges = written(fewer(links(distinct.select(F.col("fp").alias("node"), "fp"), distance).distinct(), n), "links")
    linked = components(edges).select(F.col("node").alias("fp"), "root")
    ends = edges.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    linked = written(fewer(linked.join(ends, "fp").join(distinct, "fp"), n), "linked-fingerprints")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.join(least, "root").select("fp", "component_id", "n_links")
    alone = distinct.join(known, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = own.join(known.unionByName(alone), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
