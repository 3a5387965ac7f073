import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from strandspark.llm import warc as W
from strandspark.llm.warc import LoserTree, Run, capture_histories, members, merge_index, merged, parse, read_archives, record_at, stretches, write_archives


def tree(runs):
    keys = pa.array([x for run in runs for x in run], pa.binary())
    at = [0]
    for run in runs:
        at.append(at[-1] + len(run))
    return keys, LoserTree([Run(keys, a, b) for a, b in zip(at, at[1:])])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30).map(lambda x: b"%02d" % x)).map(sorted), max_size=9))
def test_loser_tree(runs):
    keys, t = tree(runs)
    places = list(t)
    assert [keys[p].as_py() for p in places] == sorted(x for run in runs for x in run)
    assert sorted(places) == list(range(len(keys)))


def test_merge_matches_once_a_level_and_holds_a_buffer_of_each_run(monkeypatch):
    """Nothing is sorted, and no run is ever a list."""
    r = random.Random(8)
    runs = [sorted(b"%06d" % r.randrange(10**6) for _ in range(3000)) for _ in range(16)]
    matches, held = 0, 0
    less, fill = LoserTree._less, Run._fill

    def counted(self, a, b):
        nonlocal matches
        matches += 1
        return less(self, a, b)

    def seen(self):
        nonlocal held
        fill(self)
        held = max(held, len(self.buffer))

    monkeypatch.setattr(LoserTree, "_less", counted)
    monkeypatch.setattr(Run, "_fill", seen)
    monkeypatch.setattr(W, "sorted", None, raising=False)
    keys, t = tree(runs)
    assert [keys[p].as_py() for p in t] == sorted(x for run in runs for x in run)
    assert matches <= 16 * 3000 * 4 + 16 and held <= W.BUFFER < 3000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 99), max_size=30), max_size=8))
def test_merge_of_any_batches(parts):
    """Stretches are found where they lie, within batches and across them."""
    batches = [pa.RecordBatch.from_arrays([pa.array([b"%02d" % x for x in p], pa.binary()), pa.array(p, pa.int64())], names=["key", "x"]) for p in parts]
    got = [x for b in merged(iter(batches), "key") for x in b.column(1).to_pylist()]
    flat = [x for p in parts for x in p]
    assert got == sorted(flat)
    if flat:
        cut = stretches(pa.Table.from_batches([b for b in batches if b.num_rows])["key"])
        assert len(cut) == 1 + sum(a > b for a, b in zip(flat, flat[1:]))


def pages(spark):
    r = random.Random(4)
    html = ["<p>é" + "x" * r.randint(0, 50) + "\r\n\r\nWARC/1.1\r\n\r\n" + str(i % 7) for i in range(60)] + [None, "", None, "same", "same", "same"]
    rows = [(i, f"http://H{i % 3}.example.org/p/{i % 5}#f" if i % 11 else None, h, "z") for i, h in enumerate(html)]
    rows += [rows[5], rows[-1], (None, "no scheme here", "same", "z"), (None, "u\r\nX-Page: 9", "alone", "z")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip(spark):
    rows, df = pages(spark)
    most = {}
    for i, _, h, _ in rows:
        h = h or ""
        most[h] = max(most.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        raw, m = (h or "").encode(), most[h or ""]
        kind = "response" if m < 0 or i == m else "revisit"
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, m if kind == "revisit" else None))
    out = capture_histories(df)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_globally_ordered(spark, tmp_path):
    _, df = pages(spark)
    path = f"file://{tmp_path}/w"
    write_archives(df, path, file_bytes=900)
    merged = merge_index(read_archives(spark, path), per_range=10)
    rows = merged.collect()
    keys = [(r["urlkey"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in rows]
    assert keys == sorted(keys) and merged.rdd.getNumPartitions() > 2
    assert len({r["archive"] for r in rows}) > 6


def test_offsets_seek_and_files_are_bounded(spark, tmp_path):
    """Each record is a gzip member that can be read alone; ordinary gzip reads the file."""
    import gzip

    _, df = pages(spark)
    long = "<p>" + "".join(random.Random(1).choices("abcdefghijklmnop", k=200_000))
    df = df.unionByName(spark.createDataFrame([(1000, "http://long/", long, "z")], df.schema))
    write_archives(df, f"file://{tmp_path}/w", file_bytes=2000)
    raw = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("part-*")}
    sizes = sorted(map(len, raw.values()))
    assert len(sizes) > 5 and sizes[-2] <= 2000 + len(W.NOTHING) < 50_000 < sizes[-1]
    index = read_archives(spark, f"file://{tmp_path}/w").collect()
    assert len(index) == df.count() == sum(len(list(members(x))) for x in raw.values())
    for r in index:
        headers, block = record_at(raw[r["archive"]], r["offset"])
        assert headers["WARC-Type"] == r["record_type"] and headers["WARC-Payload-Digest"] == "sha1:" + r["payload_digest"]
        assert headers.get("X-Page") == (None if r["page_id"] is None else str(r["page_id"]))
    for x in raw.values():
        assert gzip.decompress(x) == b"".join(c for _, c in members(x))


def test_damage_is_noticed():
    import gzip

    for bad in (b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n", b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        list(members(gzip.compress(b"some record")[:-3]))


def test_least_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://a/", "x"), (3, "http://a/", "long one"), (4, "http://a/", "long one")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in capture_histories(df, least_bytes=4).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert capture_histories(df.limit(0)).collect() == []
