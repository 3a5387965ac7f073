import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strandspark.llm.simhash import SEGMENTS, WIDTH, chain_viable, fingerprint, near_duplicates


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """pairs: (doc_id, fingerprint); smallest id reachable over links of 3 bits or fewer,
    through fingerprints without ids too."""
    fps = sorted({f for _, f in pairs})
    least = {f: min((i for i, g in pairs if g == f and i is not None), default=None) for f in fps}
    changed = True
    while changed:
        changed = False
        for f in fps:
            for g in fps:
                if (f ^ g).bit_count() <= 3 and least[g] is not None and (least[f] is None or least[g] < least[f]):
                    least[f], changed = least[g], True
    return least


def test_against_brute_force(docs, rows):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect()), key=str)
    pairs = [(x[0], brute_fingerprint(x[1])) for x in rows]
    least = brute_components(pairs)
    assert got == sorted(((i, f"{f:016x}", least.get(f)) for i, f in pairs), key=str)
    assert len({c for _, _, c in got}) < len({i for i, _, _ in got})


def test_query_on_whole_table(spark):
    from strandspark.llm.q_simhash import query

    sf = "/root/testdata/sf0.001"
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in query(spark, sf).collect())
    pairs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    least = brute_components(pairs)
    assert got == sorted((i, f"{f:016x}", least[f]) for i, f in pairs)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def test_filter_loses_no_pair(spark):
    """Every difference of up to three bits has a viable chain and an equal key."""
    from pyspark.sql import functions as F

    from strandspark.llm.simhash import _segment, chain_keys

    rng = np.random.default_rng(3)
    rows = []
    for _ in range(3000):
        a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(bit)
        rows.append(tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    x = F.col("a").bitwiseXOR(F.col("b"))
    ok = chain_viable([F.bit_count(_segment(x, i)) for i in range(SEGMENTS)], 3) & F.arrays_overlap(chain_keys(F.col("a")), chain_keys(F.col("b")))
    assert df.where(~ok).count() == 0
    assert SEGMENTS * WIDTH == 64


def test_links_through_documents_without_ids(spark, monkeypatch):
    """0 - 7 - 63: the middle one has no id; it still links its neighbours."""
    import strandspark.llm.simhash as S

    rows = [(5, 0), (9, 0), (None, 7), (2, 63), (None, 63 << 40), (None, 63 << 40), (None, 7 << 40), (3, (1 << 63) - 1)]
    monkeypatch.setattr(S, "fingerprints", lambda *a: spark.createDataFrame(rows, "doc_id long, fp long"))
    got = near_duplicates(spark.range(0).selectExpr("id AS doc_id", "'' AS text")).collect()
    least = brute_components(rows)
    assert sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got), key=str) == sorted(((i, f, least[f]) for i, f in rows), key=str)
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 9, 2)} == {2}
    assert {r["n_links"] for r in got if int(r["fingerprint"], 16) == 7} == {2}


def test_empty_and_limits(no_docs, spark):
    assert near_duplicates(no_docs).collect() == []
    with pytest.raises(ValueError):
        near_duplicates(no_docs, distance=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 64), min_size=8, max_size=8), st.integers(1, 8))
def test_ring_has_a_chain_within_budgets(parts, longest):
    """Whatever the segments' differences, their sum leaves some chain of any length viable."""
    total = sum(parts)
    n = len(parts)
    assert any(all(sum(parts[(i + j) % n] for j in range(k + 1)) <= (k + 1) * total // n for k in range(longest)) for i in range(n))
