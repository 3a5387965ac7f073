"""One row of each group of near copies: five-word shingle similarity of 0.8 or more.

The form of the SimHash operator for a similarity instead of a number of bits. Its own steps
come first: 64-bit SimHash of the shingles, pigeonring keys, budgets of the chains, Hamming check
(``simhash.links``, 3 bits). Pairs of similarity 0.8 lie up to 12 bits apart, a distance that no
selective key covers, so for the rest candidates are texts that share
a band of minhashes: with 32 bands of 5 a pair of similarity 0.8 shares none with a probability
of 0.672 ** 32, or 3 in a million, and closer pairs with less. Every candidate of both kinds is
then checked on its whole shingle sets (as 64-bit hashes). Texts are known by a
64-bit hash.

Only components count, so a group of n copies need not be n * n comparisons: the texts
of a band are first compared with its central text only, the one whose bands hold most
texts -- in a group of near copies that is the least edited one. After that only those of a
band that are still in different components are compared with one another, and of these
those whose fingerprints, two bits of each of 512 minhashes, differ in at most 113 places
(at similarity 0.8: 77 expected, spread 8.1; at 0.65 they differ in 134), and whose sets can
be alike at all: a shingle that no other of the texts left has is in no intersection.
Texts are never shuffled: a bitmap of bounded size picks those whose sets are needed.

Defined results: a text shorter than a shingle is one shingle, and texts without a
word are copies of each other; null is the empty text. Of a component the row with
the smallest id stays, one without an id only where none has one. Rows that repeat
an id and a text are copies as well. Very long texts are sketched whole, a block of shingles at a
time; an empty table gives an empty one; other columns, whatever their names, are kept and
not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.simhash import LOWER, links, majority
from strandspark.llm.substrings import keep_held, bitmap_of, holds
from strandspark.llm.texts import free_name, map_texts, plain_names, quoted, renamed
from strandspark.operators.graph import components
from strandspark.runtime import fewer, written

SHINGLE = 5
BANDS, DEPTH = 32, 5
#: Minhashes in all, the 64-bit words of two bits of each, and the most of them in which a candidate differs.
HASHES = 512
WORDS, APART = HASHES // 32, 113
SEED = 7
#: Shingles sketched at once.
BLOCK = 1 << 12
_draw = np.random.default_rng(SEED)
_A = _draw.integers(0, 1 << 32, HASHES, np.uint32)[:, None] | np.uint32(1)
_B = _draw.integers(0, 1 << 32, HASHES, np.uint32)[:, None]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    w = (text or "").encode().translate(LOWER).split()
    n = max(1, len(w) - SHINGLE + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + SHINGLE]), SEED) for i in range(n)], np.uint64))


def sketch(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return minima(shingles(text))


def minima(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of each band of minhashes, and two bits of each of all minhashes: for 64 of
    them the words of their first and of their second bits, and so on."""
    x = grams.astype(np.uint32)
    least = np.full(HASHES, (1 << 32) - 1, np.uint32)
    for k in range(0, len(x), BLOCK):
        np.minimum(least, (_A * x[k : k + BLOCK] + _B).min(1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least[: BANDS * DEPTH].reshape(BANDS, DEPTH).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    two = (least * np.uint32(0x9E3779B1)) >> np.uint32(30)
    planes = [np.packbits((two >> np.uint32(k) & np.uint32(1)).astype(np.uint8)).view(np.int64) for k in range(2)]
    return key.view(np.int64), np.stack(planes, 1).ravel()


def differing(a: list[Column], b: list[Column]) -> Column:
    """In how many of 64 minhashes two texts differ: words of the first and the second bits."""
    return F.bit_count(a[0].bitwiseXOR(b[0]).bitwiseOR(a[1].bitwiseXOR(b[1])))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(flat))


def _sketches(texts: DataFrame) -> DataFrame:
    def run(c: dict[str, list]) -> pa.RecordBatch:
        both, fp = [], []
        for t in c["text"]:
            grams = shingles(t)
            both.append(minima(grams))
            fp.append(majority(grams))
        prints = pa.array(np.array(fp, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c["node"], pa.int64()), _lists([x[0] for x in both]), _lists([x[1] for x in both]), prints], names=["node", "keys", "bits", "fp"])

    return map_texts(texts, run, "node long, keys array<long>, bits array<long>, fp long")


def fingerprint_pairs(sketches: DataFrame, n: int) -> DataFrame:
    """Candidates (u, v) by SimHash: texts of one fingerprint with its smallest text, and the smallest
    texts of fingerprints that the operator's keys and checks link, each with the smallest it is linked
    to, so that pairs are never more than texts."""
    own = written(fewer(sketches.select("node", "fp").distinct(), n), "text-fingerprints")
    least = written(fewer(own.groupBy("fp").agg(F.min("node").alias("least")), n), "distinct-fingerprints")
    near = links(least.select(F.col("least").alias("node"), "fp")).groupBy("u").agg(F.min("v").alias("v"))
    same = own.join(least, "fp").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return written(fewer(_ordered(near.unionByName(same)), n), "fingerprint-pairs")


def _sets(texts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, grams) of the texts of ``nodes``, each once."""
    nodes = written(fewer(nodes.select(F.col("node").alias("key")).distinct(), n), "set-nodes")
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap_of(nodes, nodes.count()))

    def run(c: dict[str, list]) -> pa.RecordBatch:
        ok = holds(wanted.value, np.array(c["node"], np.int64).view(np.uint64))
        own = {}
        for node, text, k in zip(c["node"], c["text"], ok):
            if k and node not in own:
                own[node] = shingles(text).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), _lists(list(own.values()))], names=["node", "grams"])

    return written(map_texts(texts, run, "node long, grams array<long>").dropDuplicates(["node"]), "sets")


def _close(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Those of rows (u, v) whose fingerprints differ in few enough places."""
    both = pairs.join(_named(bits, "a"), F.col("u") == F.col("a_node")).join(_named(bits, "b"), F.col("v") == F.col("b_node"))
    return both.where(_near()).select("u", "v")


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.toDF(*[f"{side}_{c}" for c in df.columns])


def _near() -> Column:
    words = lambda side, k: [F.col(f"{side}_b{k + j}") for j in range(2)]
    return sum((differing(words("a", k), words("b", k)) for k in range(0, WORDS, 2)), F.lit(0)) <= APART


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of rows (u, v) whose sets have a similarity of 0.8 or more, in whole numbers."""
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    n = F.size("a") + F.size("b")
    close = F.least(F.size("a"), F.size("b")) * 5 >= F.greatest(F.size("a"), F.size("b")) * 4
    return both.where(F.when(close, 9 * F.size(F.array_intersect("a", "b")) >= 4 * n).otherwise(False)).select("u", "v")


def _open(shared: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(key, node, root, main) of the bands whose texts are in more than one component;
    ``main`` is the component that most of a band's texts are in."""
    rooted = shared.join(components(edges), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted-bands")
    each = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = each.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    return rooted.join(written(fewer(mixed, n), "open-bands"), "key")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def copy_links(texts: DataFrame, n: int) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of alike texts, from ``n`` rows
    (node, text), of which a node may have several of the same text."""
    sketches = written(_sketches(texts), "sketches")
    keyed = sketches.select(F.explode("keys").alias("key"), "node")
    bands = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    shared = written(keyed.join(written(fewer(bands, n), "bands"), "key").distinct(), "shared-bands")
    sizes = written(fewer(shared.groupBy("key").agg(F.count(F.lit(1)).alias("size")), n), "band-sizes")
    used = written(fewer(shared.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("weight")), n), "shared-nodes")
    centre = written(fewer(shared.join(used, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("centre")), n), "central-nodes")
    words = [F.col("bits")[k].alias(f"b{k}") for k in range(WORDS)]
    bits = keep_held(sketches.select("node", *words, "keys"), "node", bitmap_of(used.select(F.col("node").alias("key")), used.count()))
    bits = written(fewer(bits.join(used, "node", "left_semi").dropDuplicates(["node"]), n, 20_000), "shared-bits")
    tried = written(fewer(_ordered(shared.join(centre, "key").select(F.col("node").alias("u"), F.col("centre").alias("v"))), n), "first-pairs")
    close = _close(tried, bits).unionByName(fingerprint_pairs(sketches, n)).distinct()
    first = written(fewer(close, 2 * n), "first-close-pairs")
    edges = written(_verified(first, _sets(texts, first.select(F.explode(F.array("u", "v")).alias("node")), n)), "first-links")

    left = written(_open(shared, edges, n), "open-texts")
    sets = _sets(texts, left, n)
    alone = sets.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("node", F.size("grams").alias("size")).join(alone, "node", "left").select("node", "size", F.expr("size - coalesce(own, 0)").alias("common")).where("5 * common >= 4 * size")
    left = written(left.join(sizes, "node").join(bits, "node"), "open-texts")
    # texts out of their band's main component meet all of the band; any two others are in one component
    a, b = _named(left.where("root <> main"), "a"), _named(left, "b")
    can = 9 * F.least("a_common", "b_common") >= 4 * (F.col("a_size") + F.col("b_size"))
    once = ~F.arrays_overlap(F.slice("a_keys", F.lit(1), F.array_position("a_keys", F.col("a_key")).cast("int") - 1), F.col("b_keys"))  # in the first band that both are in
    other = (F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("b_main")) | (F.col("a_node") > F.col("b_node")))
    pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & other & can & _near() & once)
    pairs = _ordered(pairs.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))).join(tried, ["u", "v"], "left_anti")
    more = written(_verified(written(pairs, "further-pairs"), sets), "further-links")
    return edges.unionByName(more)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of alike texts, with all its columns."""
    names, docs = docs.columns, plain_names(docs)
    key = text_key(F.col(text_col))
    n = docs.count()
    root = components(copy_links(docs.select(key.alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), n))
    rows = written(fewer(docs.groupBy(F.col(id_col).alias("id"), key.alias("node")).agg(F.count(F.lit(1)).alias("n")), n), "row-keys")
    rows = rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(fewer(rows, n), "rooted-rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "node")).alias("best"))
    judged = rows.join(written(fewer(best, n), "kept-rows"), "root")
    stays = (F.col("best.node") == F.col("node")) & F.col("best.id").eqNullSafe(F.col("id"))
    # rows that go, and rows that stay once of several
    named = written(fewer(judged.where(~stays | (F.col("n") > 1)).select("id", F.col("node").alias("key"), stays.alias("once")), n), "judged-rows")
    # texts that no such row has stay where they are; the bitmap may let a few more join
    name = free_name(docs.columns, "key")
    held = bitmap_of(named.select("key"), named.count())
    own = docs.withColumn(name, key)
    rest, own = keep_held(own, name, held, False), keep_held(own, name, held)
    at = F.col(id_col).eqNullSafe(named["id"]) & (F.col(name) == named["key"])
    once = own.join(named.where("once"), at, "left_semi").groupBy(id_col, name).agg(F.first(F.struct(*quoted(docs.columns))).alias("row"))
    out = rest.select(*quoted(docs.columns)).unionByName(own.join(named, at, "left_anti").select(*quoted(docs.columns))).unionByName(once.select("row.*"))
    return renamed(out, names)
