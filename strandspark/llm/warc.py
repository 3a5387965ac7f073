"""WARC archives: writing with payload deduplication, reading, and the merged index.

Writing: pages with equal payloads are one group; its largest page id is stored as
a response, the others as revisits that refer to it. Records are laid out JVM-side;
each becomes a gzip member of its own, and members fill files of at most about
``file_bytes`` (one larger record is a file of its own). The writer ends each file
with an empty member. Reading goes member by member, parses by Content-Length and
checks stored payloads against their digests; the index holds each member's offset, from
which the record can be read alone.

Index, by an external merge: every reading task sorts its captures by URL key and
timestamp and writes them as a run, a file in the shared folder. The key space is then cut
into ranges of bounded size, and in every range the slices of the runs that reach
into it are merged by a k-way loser tree over one small buffer per slice, so that the
partitions, in order, hold all captures by URL key and time. Nothing is sorted a second
time: slices are the stretches that arrive in order.

Defined results: a null html is an empty payload; a null url is recorded as
``urn:page:<id>``; a null page id is never a group's response unless the group has no
other; repeated rows with the largest id are all responses; very long pages are
whole; an empty table gives an empty result; other columns are not looked at. The
largest group is never in one task: its largest id is combined before the shuffle,
and Spark can split the join. Captures of one URL may be in several ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.runtime import fewer, shared_dir, written

#: Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Captures of the synthetic crawl: seconds after this time, by page id.
EPOCH = 1_577_836_800

#: Bytes of a file of records, level of its compression, and the gzip member without content that ends each file.
FILE_BYTES, LEVEL = 16 << 20, 3
NOTHING = gzip.compress(b"", mtime=0)
#: Keys of a run that a merge has in hand, and rows of a batch of its result.
BUFFER, ROWS_OUT = 512, 10_000

INDEX = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def base32(hexadecimal: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: every five hex digits are four characters."""
    parts = []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(hexadecimal, i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(number, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex), response: the id of the group's response."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    groups = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"))
    groups = groups.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.join(groups.select("digest", "response"), "digest", "left")


def records(classified: DataFrame) -> DataFrame:
    """One column ``value``: the record of each row, without the end of record."""
    id_, revisit = F.col("page_id"), F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v, F.lit("\r\n"))
    size = F.octet_length("payload").cast("string")
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(id_.cast("string"), F.lit("none")))), r"[\x00-\x20]", "%20")
    http = F.concat(F.lit(HTTP), line("Content-Length", size), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(id_, F.lit(0)) % F.lit(10**9)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(id_)),
        line("WARC-Target-URI", uri),
        line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("response"))), line("X-Refers-To-Page", F.col("response").cast("string")))).otherwise(F.lit("")),
        F.when(id_.isNotNull(), line("X-Page", id_.cast("string"))).otherwise(F.lit("")),
        line("X-Payload-Length", size),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    ]
    return classified.select(F.concat(*head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, per_task: int = 2000, **columns) -> None:
    """Archives of all pages under ``path``."""

    def pack(it):
        held, size = [], 0
        for b in it:
            for value in b.column(0):
                member = gzip.compress(value.as_py().encode() + END.encode(), LEVEL, mtime=0)
                if held and size + len(member) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    files = fewer(records(classify(pages, **columns)), pages.count(), per_task).mapInArrow(pack, "value binary")
    # the text writer puts a row's bytes as they are, then its separator
    writer = files.select(F.col("value").cast("string")).write.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def members(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of an archive's members that have content."""
    at = 0
    while at < len(raw):
        d = zlib.decompressobj(31)
        content = d.decompress(memoryview(raw)[at : at + (64 << 10)])
        end = at + (64 << 10)
        parts = [content]
        while not d.eof and end < len(raw):
            parts.append(d.decompress(memoryview(raw)[end : end + (64 << 10)]))
            end += 64 << 10
        if not d.eof:
            raise ValueError(f"the member at {at} is cut off")
        if content := b"".join(parts):
            yield at, content
        at = min(end, len(raw)) - len(d.unused_data)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    stop = record.index(b"\r\n\r\n")
    first, *lines = record[:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a record")
    headers = dict(x.split(": ", 1) for x in lines)
    start = stop + 4
    end = start + int(headers["Content-Length"])
    if record[end:] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    return headers, record[start:end]


def record_at(raw: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """The record whose member begins at ``offset``; nothing before it is read."""
    return parse(next(members(memoryview(raw)[offset:]))[1])


def url_key(uri: str) -> str:
    """Host reversed by labels, then path: all captures of a site sort together."""
    scheme, found, rest = uri.partition("://")
    if not found:
        return uri
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:].split("#")[0] or "/")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all records under ``path``; a stored payload that does not match
    its digest is an error."""

    def run(it):
        for b in it:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for at, record in members(content.as_buffer()):
                    h, block = parse(record)
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(h["X-Payload-Length"]):
                            raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
                    page, refers = h.get("X-Page"), h.get("X-Refers-To-Page")
                    rows.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], int(page) if page else None, int(h["X-Payload-Length"]), digest, kind, int(refers) if refers else None, name.rsplit("/", 1)[-1], at))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                cols = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


class Run:
    """A sorted stretch ``[at, stop)`` of a column of keys, of which a buffer at a time is in hand."""

    def __init__(self, keys: pa.Array, at: int, stop: int):
        self.keys, self.at, self.stop = keys, at, stop
        self.buffer: list[bytes] = []
        self.next = 0
        self.key: bytes | None = None
        self._fill()

    def _fill(self) -> None:
        self.buffer = self.keys.slice(self.at, min(BUFFER, self.stop - self.at)).to_pylist()
        self.next = 0
        self.key = self.buffer[0] if self.buffer else None

    def pop(self) -> int:
        """The place of the key that was first; the following one is first now."""
        out, self.at, self.next = self.at, self.at + 1, self.next + 1
        if self.next < len(self.buffer):
            self.key = self.buffer[self.next]
        else:
            self._fill()
        return out


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its match, so the next
    smallest key costs one match per level on the path of the last winner's run."""

    def __init__(self, runs: list[Run]):
        self.runs, self.k = runs, max(1, len(runs))
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._enter(i)

    def _less(self, a: int, b: int) -> bool:
        """Run a's first key goes before run b's; finished runs go last."""
        x, y = self.runs[a].key, self.runs[b].key
        if x is None or y is None:
            return x is not None
        return x < y or x == y and a < b

    def _enter(self, i: int) -> None:
        """Play run i up the tree while it is built; an empty node takes it."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[int]:
        """Places of the keys, in the order of keys."""
        while self.runs and self.runs[i := self.losers[0]].key is not None:
            yield self.runs[i].pop()
            node = (i + self.k) // 2
            while node > 0:
                if self._less(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.losers[0] = i


def stretches(keys: pa.ChunkedArray) -> list[tuple[int, int]]:
    """(from, to) of the longest stretches in order; one batch's keys at a time."""
    cuts, at, last = [0], 0, None
    for chunk in keys.chunks:
        for k in range(0, len(chunk), 10 * BUFFER):
            own = chunk.slice(k, 10 * BUFFER).to_numpy(zero_copy_only=False)
            if last is not None and own[0] < last:
                cuts.append(at)
            cuts.extend((np.flatnonzero(own[1:] < own[:-1]) + 1 + at).tolist())
            at, last = at + len(own), own[-1]
    return list(zip(cuts, [*cuts[1:], at])) if at else []


def merged(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of sorted stretches, in the order of the binary column ``key``."""
    if not (held := [b for b in batches if b.num_rows]):
        return
    t = pa.Table.from_batches(held)
    runs = stretches(t[key])
    t = t.combine_chunks()
    keys = t[key].chunk(0)
    places: list[int] = []
    for place in LoserTree([Run(keys, a, b) for a, b in runs]):
        places.append(place)
        if len(places) == ROWS_OUT:
            yield from t.take(pa.array(places, pa.int64())).combine_chunks().to_batches()
            places = []
    if places:
        yield from t.take(pa.array(places, pa.int64())).combine_chunks().to_batches()


def order_key() -> Column:
    """Bytes that sort as URL key, capture time, page id (none first), file and offset do."""
    number = lambda c: F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat_ws("\0", "urlkey", "captured", F.coalesce(number("page_id"), F.lit("")), "archive", number("offset")).cast("binary")


def merge_index(index: DataFrame, per_range: int = 100_000) -> DataFrame:
    """All index rows in the order of URL key and capture time, partition by partition."""
    runs = written(index.withColumn("order_key", order_key()).sortWithinPartitions("order_key"), "capture-runs")
    ranges = runs.repartitionByRange(max(1, -(-runs.count() // per_range)), "order_key")
    return ranges.mapInArrow(lambda it: merged(it, "order_key"), runs.schema).select(*index.columns)


def capture_histories(pages: DataFrame, path: str | None = None, least_bytes: int = 0, **columns) -> DataFrame:
    """Archive all pages, read the archives back, and merge their index."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes=least_bytes, **columns)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(p)
    return merge_index(read_archives(spark, path))
