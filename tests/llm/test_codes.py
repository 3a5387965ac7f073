import math
import os
import random

import duckdb
import numpy as np
from strandspark.llm import q_codes
from strandspark.llm.codes import CodeConfig, Movement, compress, decode, nearest_two, reassign, with_label_error

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, entry string"


def brute(rows, config):
    """Plain Lloyd rounds over Python integers."""
    ok = [(i, [math.floor(config.scale * float(np.float32(c))) for c in v], lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v) and len(v) % config.parts == 0]
    if not ok:
        return [], []
    w = len(ok[0][1]) // config.parts
    ok = [r for r in ok if len(r[1]) == w * config.parts]
    first = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[: config.entries]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(config.parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned():
        return [[min((d2(x[p * w : p * w + w], e), k) for k, e in enumerate(books[p])) for p in range(config.parts)] for _, x, _ in ok]

    for _ in range(config.rounds):
        at = assigned()
        for p in range(config.parts):
            for k in range(len(books[p])):
                own = [x[p * w : p * w + w] for (_, x, _), a in zip(ok, at) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    at = assigned()
    labels = {}
    for (_, _, lab), a in zip(ok, at):
        labels[lab] = labels.get(lab, 0) + sum(d for d, _ in a)
    return sorted(((i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), labels[lab]) for (i, _, lab), a in zip(ok, at)), key=str), books


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1, "e") for i, v, lab in rows], SCHEMA).repartition(3)


def awkward(seed, n=150, dim=16, step=0.25):
    r = random.Random(seed)
    rows = [(i, [r.randint(-4, 4) * step for _ in range(dim)], r.choice([1, 2, 3, None])) for i in range(n)]
    rows += [(500, None, 1), (501, [0.1] * (dim - 1) + [None], 1), (502, [float("nan")] * dim, 2), (503, [float("-inf")] + [0.0] * (dim - 1), 2), (504, [], 1), (505, [0.5] * (dim + 8), 1), (506, [0.5] * 3, 1)]
    return rows + [rows[0], rows[0], (3, [0.3] * dim, None), (None, [-0.3] * dim, 3), (-7, [1e-9] * dim, 1)]


def check(spark, rows, config):
    done = compress(table(spark, rows), config)
    want, books = brute(rows, config)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in with_label_error(done.rows).collect()]
    assert sorted(got, key=str) == want
    assert [b.tolist() for b in done.books] == books
    return done


def test_against_brute_force(spark):
    check(spark, awkward(1), CodeConfig(parts=8))
    check(spark, awkward(2, step=0.0003), CodeConfig(parts=4, entries=5, rounds=4))
    check(spark, awkward(3, n=60, dim=8), CodeConfig(parts=1, entries=300, rounds=2))
    check(spark, awkward(4, n=40), CodeConfig(parts=8, rounds=0))


def test_few_rows_and_none(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.5] * 8, None), (3, [-0.5] * 8, 1)]
    check(spark, rows, CodeConfig())
    check(spark, rows[:1], CodeConfig())
    none = compress(table(spark, rows).limit(0))
    assert none.rows.collect() == [] and none.books is None and len(none.sha256()) == 64
    assert compress(table(spark, [(1, None, 1), (2, [1.0], 2)])).rows.collect() == []


def test_bounds_keep_results_and_save_scans():
    """Bounds over many rounds: the same entries as full scans, of which most are saved."""
    g = np.random.default_rng(3)
    centres = g.integers(-4000, 4000, (16, 8))
    x = centres[g.integers(0, 16, 4000)] + g.integers(-300, 300, (4000, 8))
    book = x[:16].copy()
    at, first, second = nearest_two(x, book)
    upper, lower, scans = np.sqrt(first.astype(float)), np.sqrt(second), 0
    for _ in range(8):
        new = np.array([x[at == k].sum(0) // max((at == k).sum(), 1) if (at == k).any() else book[k] for k in range(16)])
        at, upper, lower, n = reassign(x, new, at, upper, lower, Movement.between(book, new))
        book, scans = new, scans + n
        plain, d, two = nearest_two(x, book)
        assert (plain == at).all()
        assert (upper >= np.sqrt(d.astype(float))).all() and (lower <= np.sqrt(two) + 1e-9).all()
    assert scans < 0.3 * 8 * len(x)


def test_ties_go_to_the_lower_index():
    book = np.array([[4], [0], [4], [8]])
    at, first, second = nearest_two(np.array([[2], [4], [6], [9]]), book)
    assert at.tolist() == [0, 0, 0, 3] and first.tolist() == [4, 0, 4, 1] and second.tolist() == [4, 0, 4, 25]
    still = Movement.between(book, book)
    for start in ([1, 2, 3, 3], [2, 2, 2, 3]):
        d = ((np.array([[2], [4], [6], [9]]) - book[start]) ** 2).sum(1)
        got = reassign(np.array([[2], [4], [6], [9]]), book, np.array(start), np.sqrt(d.astype(float)), np.sqrt(second), still)[0]
        assert got.tolist() == [0, 0, 0, 3]


def test_large_components_are_cut(spark):
    rows = [(i, [s * 3e38] * 8, 1) for i, s in enumerate((1, -1, 1))]
    done = compress(table(spark, rows))
    assert {r["error"] for r in done.rows.collect()} == {0} and done.books.max() == 1 << 28


def test_decode(spark):
    done = compress(table(spark, awkward(5)), CodeConfig(rounds=2))
    out = decode(done.rows.select("vec_id", "code"), done.books).collect()
    assert len(out) == done.rows.count() and len(out[0]["approx"]) == 16
    r = next(r for r in out if r["vec_id"] == 9)
    at = bytes.fromhex(r["code"])
    assert np.allclose(r["approx"], (np.concatenate([done.books[p][at[p]] for p in range(8)]) + 0.5) / 4096)


def test_sql(spark):
    con = duckdb.connect()
    p = f"{SF}/embeddings.parquet"
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    got = q_codes.query(spark, SF)
    want = con.sql(q_codes.SQL)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
