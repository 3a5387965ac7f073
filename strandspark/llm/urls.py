"""URL filters by a Bloom filter cascade.

Rules and list entries are a host with its subdomains and a path prefix. The keys of
a URL are those suffixes of its host and prefixes of its path that an entry could
have, by the pairs of sizes (labels, characters) that entries do have. Over the
corpus's complete universe of keys, level 1 of the cascade encodes the listed keys,
level 2 those other keys that level 1 lets pass, level 3 the listed keys that level 2
lets pass, and so on until nothing passes. Walking the levels then answers membership
exactly for every key of the universe, without a join.

Level 1 lets about as many other keys pass as there are listed ones, so a cascade
takes some bits per listed key whatever the size of the corpus. It is cut by key hash into
shards of at most about ``max_bytes``; each is a broadcast of its own, and the URLs
meet one after the other. Bit arrays are built by a map-side combined aggregation.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule and the default verdict; an empty path fits a rule only if the rule's path is
empty, and the list as ``/`` does; very long urls are taken whole, and have no more
keys than short ones; repeated rows are judged each; an empty table gives an empty
result; an empty list lets everything pass; a rule goes before the list. Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.runtime import fewer, forget, written

#: Share of the keys that a level after the first lets pass wrongly.
RATE = 0.1

PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(h1: np.ndarray, h2: np.ndarray, level: int, k: int, m: int) -> list[np.ndarray]:
    """Bit positions of keys at a level; each level hashes afresh."""
    a = _stir(h1 + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    b = _stir(h2 ^ np.uint64(level)) | np.uint64(1)
    return [(a + np.uint64(j) * b) % np.uint64(m) for j in range(k)]


@dataclass
class Cascade:
    """Levels of (bits, number of hash functions); bits as little-endian 64-bit words."""

    levels: list[tuple[np.ndarray, int]] = field(default_factory=list)

    @property
    def n_bytes(self) -> int:
        return sum(b.nbytes for b, _ in self.levels)

    def hit(self, n: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys level ``n`` (from 0) holds."""
        bits, k = self.levels[n]
        out = np.ones(len(h1), bool)
        for at in positions(h1, h2, n, k, len(bits) * 64):
            out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def passed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How many levels in a row hold each key."""
        out = np.zeros(len(h1), np.int64)
        on = np.arange(len(h1))
        for n in range(len(self.levels)):
            on = on[self.hit(n, h1[on], h2[on])]
            out[on] += 1
        return out

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Odd levels hold listed keys, so a walk that ends after an odd one is a member's."""
        return self.passed(h1, h2) % 2 == 1


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def _test(df: DataFrame, cascade: Cascade, out: str, parity: bool) -> DataFrame:
    """Add a column from the array columns h1 and h2: membership, or levels passed."""
    shared = df.sparkSession.sparkContext.broadcast(cascade)
    kind = pa.bool_() if parity else pa.int64()

    def run(it):
        for b in it:
            c = shared.value
            a = b.column(b.schema.get_field_index("h1")), b.column(b.schema.get_field_index("h2"))
            h1, h2 = (x.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for x in a)
            got = c.member(h1, h2) if parity else c.passed(h1, h2)
            sizes = a[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield b.append_column(out, pa.ListArray.from_arrays(pa.array(offsets), pa.array(got, kind)))

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + f", {out} array<{'boolean' if parity else 'bigint'}>"
    return df.mapInArrow(run, schema)


def _bits(keys: DataFrame, n: int, level: int, rate: float) -> tuple[np.ndarray, int]:
    """Bloom filter of rows (h1, h2); 64-bit words are combined before the shuffle."""
    k = max(1, round(-np.log2(rate)))
    m = max(1, -(-int(n * k / np.log(2)) // 64)) * 64

    def run(it):
        for b in it:
            h1, h2 = (b.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in ("h1", "h2"))
            pos = np.concatenate(positions(h1, h2, level, k, m))
            word, inv = np.unique(pos >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inv, np.uint64(1) << (pos & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    got = keys.select("h1", "h2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(m // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out, k


def _cascade(keys: DataFrame, n_listed: int, n_others: int) -> Cascade:
    """Cascade over distinct rows (h1, h2, listed), both hashes as arrays of one."""
    cascade = Cascade()
    while True:
        level = len(cascade.levels)
        left = _test(keys, cascade, "passed", False).where((F.element_at("passed", 1) == level) & (F.col("listed") == (level % 2 == 0)))
        left = left.select(F.element_at("h1", 1).alias("h1"), F.element_at("h2", 1).alias("h2"))
        if not (n := left.count()):
            return cascade
        cascade.levels.append(_bits(left, n, level, RATE if level else min(RATE, max(n_listed, 1) / max(n_others, 1))))
        if level > 60:
            raise RuntimeError("two keys of different kind have the same hashes")


def shard_of(h2: Column, n: int) -> Column:
    return F.pmod(F.shiftright(h2, 7), F.lit(n))


def build_cascades(universe: DataFrame, most: int, max_bytes: int = 64 << 20) -> list[Cascade]:
    """Cascades over rows (key, listed), of which there are at most ``most`` different
    keys; a key's place is :func:`shard_of` its second hash. Keys may repeat."""
    h1, h2 = hashes(F.col("key"))
    keys = universe.groupBy("key").agg(F.max("listed").alias("listed")).select(h1.alias("a"), h2.alias("b"), "listed")
    keys = written(fewer(keys, most), "url-keys")
    n = keys.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("others")).first()
    bits = n["listed"] * 1.45 * (3 * np.log2(1 / RATE) + max(0.0, np.log2((n["others"] + 1) / (n["listed"] + 1))))
    shards = max(1, -(-int(bits / 8) // max_bytes))
    out = []
    for i in range(shards):
        own = keys if shards == 1 else keys.where(shard_of(F.col("b"), shards) == i)
        out.append(_cascade(own.select(F.array("a").alias("h1"), F.array("b").alias("h2"), "listed"), n["listed"] // shards, n["others"] // shards))
    forget(keys)
    return out


def _found(urls: DataFrame, cascades: list[Cascade]) -> DataFrame:
    """``urls`` with ``found``: those of its array ``keys`` that the cascades hold."""
    n = len(cascades)
    out = urls.withColumn("found", F.expr("cast(array() as array<string>)"))
    for i, c in enumerate(cascades):
        own = out.withColumn("own", F.filter("keys", lambda k: shard_of(hashes(k)[1], n) == i) if n > 1 else F.col("keys"))
        tested = _test(own.withColumns({"h1": F.transform("own", lambda k: hashes(k)[0]), "h2": F.transform("own", lambda k: hashes(k)[1])}), c, "member", True)
        out = tested.withColumn("found", F.concat("found", F.expr("transform(filter(arrays_zip(own, member), x -> x.member), x -> x.own)"))).drop("own", "h1", "h2", "member")
        if i + 1 < n:
            out = written(out, "judged-urls")  # only one shard is in a worker's memory
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    host = F.translate(F.regexp_extract(url, PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def entry_sizes(host: Column, path: Column) -> Column:
    return F.struct(F.size(F.split(host, "[.]")).alias("labels"), F.char_length(path).alias("chars"))


def url_keys(sizes: list[tuple[int, int]], mark: str, path: str) -> Column:
    """Keys of a row (host, ``path``): by each (labels, characters) that host and path have."""
    own = [
        F.when((F.col("n_labels") >= labels) & (F.char_length(path) >= chars), F.concat(F.lit(mark), F.substring_index("host", ".", -labels), F.substring(path, 1, chars)))
        for labels, chars in sizes
    ]
    return F.array_compact(F.array(*own)) if own else F.expr("cast(array() as array<string>)")


def flagged_hosts(pages: DataFrame, terms: tuple[str, ...], url_col: str = "url") -> DataFrame:
    """List entries (host, path): of each host of the corpus the shortest suffix whose first
    label holds one of ``terms``, alone or between hyphens. A last label is never listed."""
    host = url_parts(F.col(url_col))[0]
    labels = pages.select(host.alias("host")).distinct().withColumn("labels", F.split("host", "[.]"))
    marks = F.transform(F.slice("labels", 1, F.size("labels") - 1), lambda x, i: F.when(F.arrays_overlap(F.split(x, "-"), F.array(*map(F.lit, terms))), i))
    last = labels.withColumns({"n": F.size("labels"), "at": F.array_max(marks)})
    return last.where("at is not null").select(F.array_join(F.slice("labels", F.col("at") + 1, F.col("n") - F.col("at")), ".").alias("host"), F.lit("/").alias("path")).distinct()


def filter_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_bytes: int = 64 << 20) -> DataFrame:
    """Judge each url: the longest rule that fits, else block if an entry of ``listed``
    (host, path) fits, else ``default``. Paths of entries begin with ``/``."""
    host, path = url_parts(F.col(url_col))
    listed = written(listed.select("host", "path").where("host is not null and path is not null"), "url-list")
    of_list = [(r["s"]["labels"], r["s"]["chars"]) for r in listed.select(entry_sizes(F.col("host"), F.col("path")).alias("s")).distinct().orderBy("s").collect()]
    of_rules = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumns({"n_labels": F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", "[.]"))), "list_path": F.when(F.col("path") == "", "/").otherwise(F.col("path"))})
    urls = urls.withColumn("keys", F.concat(url_keys(of_rules, "r:", "path"), url_keys(of_list, "l:", "list_path"))).drop("n_labels", "list_path")
    ruled = [f"r:{r.key}" for r in rules]
    most = pages.count() * max(1, len(of_list) + len(of_rules))
    marked = urls.select(F.explode("keys").alias("key")).select("key", F.col("key").isin(ruled).alias("listed"), F.lit(True).alias("seen"))
    marked = marked.unionByName(listed.select(F.concat(F.lit("l:"), "host", "path").alias("key"), F.lit(True).alias("listed"), F.lit(False).alias("seen")))
    universe = marked.groupBy("key").agg(F.max("listed").alias("listed"), F.max("seen").alias("seen")).where("seen").drop("seen")
    found = _found(urls, build_cascades(universe, most, max_bytes))
    best = F.array_max(F.transform(F.filter("found", lambda k: k.startswith("r:")), lambda k: F.struct(F.char_length(k).alias("n"), F.substring(k, 3, 1 << 30).alias("key"))))["key"]
    actions = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.action)]) if rules else F.lit(None)
    out = found.withColumn("rule", best if rules else F.lit(None).cast("string"))
    verdict = F.when(F.col("rule").isNotNull(), F.try_element_at(actions, F.col("rule")) if rules else F.lit(None)).when(F.size("found") > 0, F.lit("block")).otherwise(F.lit(default))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
