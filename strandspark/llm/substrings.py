"""Exact substring deduplication by level-wise doubling.

A window of ``window`` words (35) is removed where its word sequence starts at
more than one place of the corpus. Windows are found by growing repeats: what is
repeated at one length (9 words) alone is looked at at twice that length (18), and
so on up to the window itself; the doubling ends as soon as nothing survives.

At each length a window is stood for by its anchor, the sequence of that length
with the smallest hash inside it: equal windows have equal anchors at equal
offsets, so a window whose anchor occurs once cannot repeat. A level counts the
anchors' hashes (map-side combined; only hashes are shuffled) and passes the
repeated ones on as a bitmap of bounded size (``MAX_BITS``). The bitmap may let a
few single anchors through, never hides a repeated one, and thereby only thins
the last level, which is exact: it compares 128 bits of hash of the full windows.
Where a corpus has more repeats than the bitmap has room for, the last level
counts more runs; every step stays linear in the input.

The last level first counts whole runs of windows with one anchor. Only where an
anchor has several runs, one of them single, are its windows counted one by one.
Skew: a sequence that very many documents share is combined before each shuffle;
runs meet their verdicts in joins that Spark can split. The text itself is
shuffled once, to meet its spans: by a key of 128 bits of its id and text, so rows
with the same key have the same text and therefore the same spans, kept once.

Defined results: null and empty texts have no words; texts shorter than a window
lose nothing; very long texts are whole (hashed at once, anchors found in blocks);
repeated rows are documents of their own, so they remove each other, whatever their
ids; ids may be null; an empty table gives an empty result. Input columns with the
names of result columns are replaced, all others go through unseen.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.texts import ROWS, free_name, map_texts, plain_names, quoted, renamed, words
from strandspark.runtime import fewer, forget, written

WINDOW = 35
#: Length of the first level; each further one is twice as long, up to the window.
FIRST = 9
MAX_BITS = 1 << 28
#: Documents for each file of the tables between the steps.
DOCS_PER_FILE = 10_000
#: Windows whose anchors are found at once.
BLOCK = 1 << 14
#: Bases of the rolling hashes: odd, so that they have inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
TOKENS = re.compile(rb"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)")

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, for i < n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of words."""

    def __init__(self, w: np.ndarray, base: int):
        self.up, self.down = powers(base, len(w) + 1)
        self.sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * self.up[:-1], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        return stir((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return stir((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(1) * np.asarray(length).astype(np.uint64))


def word_hashes(w: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(x) for x in w], np.uint64)


def lengths(window: int, first: int = FIRST) -> tuple[int, ...]:
    """The levels before the window itself."""
    out = [min(first, window)]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    if window - out[-1] > 62:
        raise ValueError("a run of windows with one anchor has to fit into 63 bits")
    return tuple(out)


def anchors(h: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """For each start in ``at``, the leftmost position of the smallest of ``h[at : at + reach]``."""
    view = sliding_window_view(h, reach)
    whole = len(at) == len(view)
    out = np.empty(len(at), np.int64)
    for k in range(0, len(at), BLOCK):
        part = at[k : k + BLOCK]
        out[k : k + BLOCK] = part + (view[k : k + BLOCK] if whole else view[part]).argmin(1)
    return out


def bit_positions(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return key >> shift, (key * np.uint64(BASES[0])) >> shift


def holds(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    out = np.ones(len(key), bool)
    for at in bit_positions(key, len(bitmap) * 64):
        out &= (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def bitmap_of(keys: DataFrame, n: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bitmap of the long column ``key``, of 16 bits a key and ``max_bits`` at most."""
    bits = min(max_bits, max(1 << 16, 1 << (16 * n).bit_length()))

    def run(it):
        for b in it:
            pos = np.concatenate(bit_positions(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            word, inv = np.unique(pos >> np.uint64(6), return_inverse=True)
            out = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(out, inv, np.uint64(1) << (pos & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(out.view(np.int64))], names=["word", "bits"])

    got = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def candidates(w: np.ndarray, window: int, levels: tuple[int, ...], bitmaps: list[np.ndarray]):
    """Starts of windows that all given levels let pass, their anchors of the last
    level looked at, that level's hashes, and the rolling hash."""
    roll = Rolling(w, BASES[0])
    at = np.arange(len(w) - window + 1)
    for k, length in enumerate(levels):
        h = roll.all(length)
        q = anchors(h, at, window - length + 1)
        if k < len(bitmaps):
            ok = holds(bitmaps[k], h[q])
            at, q = at[ok], q[ok]
            if not len(at) or k + 1 == len(levels):
                break
    return at, q, h


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\0"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


def keep_held(df: DataFrame, column: str, bitmap: np.ndarray, held: bool = True) -> DataFrame:
    """Rows whose ``column`` the bitmap may hold, or those whose it does not."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(it):
        for b in it:
            yield b.filter(pa.array(holds(shared.value, b.column(b.schema.get_field_index(column)).to_numpy(zero_copy_only=False).view(np.uint64)) == held))

    return df.mapInArrow(run, df.schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, first: int = FIRST) -> DataFrame | None:
    """(key, spans) of the texts with repeats: word spans (start, mask of window starts).
    None where no window repeats."""
    spark = docs.sparkSession
    own = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    n_docs = docs.count()
    few = lambda df: fewer(df, n_docs, DOCS_PER_FILE)
    levels = lengths(window, first)
    shared: list = []

    for level in range(len(levels)):

        def emit(c: dict[str, list], level=level, maps=tuple(shared)) -> pa.RecordBatch:
            out = [np.zeros(0, np.uint64)]
            for text in c["text"]:
                w = words(text)
                if len(w) >= window:
                    at, q, h = candidates(word_hashes(w), window, levels[: level + 1], [m.value for m in maps])
                    if len(at):
                        out.append(h[np.unique(q)])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["key"])

        again = map_texts(own.select("text"), emit, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        again = written(few(again.select("key")), f"repeats-{levels[level]}")
        if not (n := again.count()):
            return None
        shared.append(spark.sparkContext.broadcast(bitmap_of(again, n)))
        forget(again)

    maps = tuple(shared)

    def runs(c: dict[str, list]) -> pa.RecordBatch:
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        keys: list[np.ndarray] = []
        lists: list[np.ndarray] = []
        for key, text in zip(c["key"], c["text"]):
            b = words(text)
            if len(b) < window:
                continue
            w = word_hashes(b)
            at, q, h = candidates(w, window, levels, [m.value for m in maps])
            if not len(at):
                continue
            new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(q) != 0)]))
            n = np.diff(np.append(new, len(at)))
            a, anchor = at[new], q[new]
            roll = Rolling(w, BASES[1])
            keys.append(np.tile(np.frombuffer(key, np.uint8), len(new)))
            for col, v in zip(cols, (a, n, anchor - a, h[anchor].view(np.int64), roll.of(a, n - 1 + window).view(np.int64))):
                col.append(v)
            lists.append(roll.of(at, window).view(np.int64))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint8)
        arrays = [pa.Array.from_buffers(pa.binary(), len(flat) // 16, [None, pa.py_buffer(np.arange(0, len(flat) + 1, 16, np.int32)), pa.py_buffer(flat)])]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        arrays += [pa.array(np.concatenate(v).astype(z.to_pandas_dtype()) if v else [], z) for v, z in zip(cols, kinds)]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(cols[1]))]) if lists else np.zeros(1)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(lists) if lists else [], pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names=["key", "start", "n", "off", "anchor", "whole", "each"])

    found = map_texts(own, runs, "key binary, start int, n int, off int, anchor long, whole long, each array<long>")
    found = written(found, "runs")
    run = ["anchor", "off", "n", "whole"]
    counted = written(few(found.groupBy(run).agg(F.count(F.lit(1)).alias("c"))), "counted-runs")
    opened = counted.groupBy("anchor").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1 and kinds > 1")
    opened = written(few(opened.select(F.col("anchor").alias("key"))), "open-anchors")
    masks = counted.where("c > 1").select(*run, F.expr("shiftleft(1L, n) - 1").alias("mask"))
    if n_open := opened.count():
        # equal windows have equal anchors, so all places of a window are among an open anchor's runs
        each = keep_held(found.select(*run, "each"), "anchor", bitmap_of(opened, n_open))
        each = written(few(each.join(opened, each["anchor"] == opened["key"], "left_semi").groupBy(run).agg(F.count(F.lit(1)).alias("c"), F.first("each").alias("each"))), "open-runs")
        windows = each.select("anchor", "c", F.explode("each").alias("h")).groupBy("anchor", "h").agg(F.sum("c").alias("c")).where("c > 1").select("anchor", "h")
        single = each.where("c = 1").select(*run, F.posexplode("each").alias("pos", "h")).join(windows, ["anchor", "h"], "left_semi")
        masks = masks.unionByName(single.groupBy(run).agg(F.bit_or(F.expr("shiftleft(1L, pos)")).alias("mask")))
    masks = written(few(masks), "masks")
    spans = found.select("key", "start", *run).join(masks, run).groupBy("key").agg(F.collect_set(F.struct("start", "mask")).alias("spans"))
    return written(few(spans), "spans")


def removed(n: int, spans: list | None, window: int) -> np.ndarray:
    """Which of a text's ``n`` words are in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        mask, p = s["mask"], s["start"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            if p + low + window <= n:
                edge[p + low] += 1
                edge[p + low + window] -= 1
            mask &= mask - 1
    return np.cumsum(edge[:-1]) > 0


def without(text: str, gone: np.ndarray) -> str:
    """The text without these words and the white space after each."""
    raw = text.encode()
    lead = len(raw) - len(raw.lstrip())
    parts = [raw[:lead]]
    parts.extend(m[0] for m, g in zip(TOKENS.finditer(raw), gone) if not g)
    return b"".join(parts).decode()


def _cut(docs: DataFrame, spans: DataFrame | None, id_col: str, text_col: str, build: Callable, schema: str) -> DataFrame:
    """``build(batch, texts, marks)`` of the rows with their spans: marks are arrays of
    lost words, or None where nothing is lost."""
    mark, key, other = (free_name(docs.columns, n) for n in ("spans", "key", "span_key"))
    if spans is None:
        joined = docs.withColumn(mark, F.lit(None).cast("array<struct<start:int,mask:bigint>>"))
    else:
        own = docs.withColumn(key, row_key(id_col, text_col))
        joined = own.join(spans.select(F.col("key").alias(other), F.col("spans").alias(mark)), F.col(key) == F.col(other), "left").select(*quoted(docs.columns), mark)

    def run(it):
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                yield build(b.remove_column(b.schema.get_field_index(mark)), b.column(b.schema.get_field_index(text_col)).to_pylist(), b.column(b.schema.get_field_index(mark)).to_pylist())

    return joined.mapInArrow(run, schema)


def _lost(text: str | None, spans: list | None, window: int) -> tuple[list[bytes], np.ndarray | None]:
    w = words(text)
    return w, removed(len(w), spans, window) if spans else None


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """The documents with n_words, n_removed, kept_words (kept words joined by one
    space) and kept_text (the text with its own white space) in new columns
    ``sub_n_words``, ``sub_n_removed``, ``sub_kept_words``, ``sub_kept_text``."""
    own = ("sub_n_words", "sub_n_removed", "sub_kept_words", "sub_kept_text")
    docs = docs.select(*quoted([c for c in docs.columns if c not in own]))
    names, docs = docs.columns, plain_names(docs)

    def build(b: pa.RecordBatch, texts: list, marks: list) -> pa.RecordBatch:
        n, lost, kept, left = [], [], [], []
        for text, s in zip(texts, marks):
            w, gone = _lost(text, s, window)
            n.append(len(w))
            lost.append(0 if gone is None else int(gone.sum()))
            kept.append((b" ".join(w) if gone is None else b" ".join([x for x, g in zip(w, gone) if not g])).decode())
            left.append(without(text, gone) if lost[-1] else text)
        for name, v, kind in zip(own, (n, lost, kept, left), (pa.int64(), pa.int64(), pa.string(), pa.string())):
            b = b.append_column(name, pa.array(v, kind))
        return b

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    spans = repeated_spans(docs, id_col, text_col, window, first)
    out = _cut(docs, spans, id_col, text_col, build, fields + ", sub_n_words long, sub_n_removed long, sub_kept_words string, sub_kept_text string")
    return renamed(out, [*names, *own])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """The documents with the columns that they have, and texts without repeated windows;
    ``chars_col``, where there is one, is the new text's number of characters."""

    names, docs = docs.columns, plain_names(docs)

    def build(b: pa.RecordBatch, texts: list, marks: list) -> pa.RecordBatch:
        cut = {}
        for i, (text, s) in enumerate(zip(texts, marks)):
            if s and (gone := _lost(text, s, window)[1]).any():
                cut[i] = without(text, gone)
        if cut:
            k = b.schema.get_field_index(text_col)
            b = b.set_column(k, b.schema.field(k), pa.array([cut.get(i, t) for i, t in enumerate(texts)], b.schema.field(k).type))
            if (k := b.schema.get_field_index(chars_col)) >= 0:
                old = b.column(k).to_pylist()
                b = b.set_column(k, b.schema.field(k), pa.array([len(cut[i]) if i in cut else n for i, n in enumerate(old)], b.schema.field(k).type))
        return b

    return renamed(_cut(docs, repeated_spans(docs, id_col, text_col, window, first), id_col, text_col, build, docs.schema), names)


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_words): what :func:`remove_repeats` finds, without
    the texts themselves."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def build(b: pa.RecordBatch, texts: list, marks: list) -> pa.RecordBatch:
        rows = [_lost(t, s, window) for t, s in zip(texts, marks)]
        kept = [(b" ".join(w) if gone is None else b" ".join([x for x, g in zip(w, gone) if not g])).decode() for w, gone in rows]
        n, lost = [len(w) for w, _ in rows], [0 if gone is None else int(gone.sum()) for _, gone in rows]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_words"])

    return _cut(own, repeated_spans(own, "doc_id", "text", window, first), "doc_id", "text", build, f"doc_id {dict(own.dtypes)['doc_id']}, n_words long, n_removed long, kept_words string")
