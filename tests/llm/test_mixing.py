import pytest
from strandspark.llm.mixing import mix, mixed


def brute_targets(sizes, weights, budget_share, max_epochs):
    """Share by weight, clamp, share the excess again by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = budget_share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > max_epochs * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: max_epochs * sizes[s] for s in over}


def rows(seed, n=400):
    import random

    r = random.Random(seed)
    src = ["a", "b", "B", "é", None, "zz", "src0"]
    return [(i, " ".join(["w"] * r.randint(0, 60)) if r.random() > 0.03 else None, r.choices(src, [1, 5, 2, 1, 3, 1, 9])[0], "x") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    out = mix(df, (5, 2, 1), 1.5, 2.0, 7).collect()
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2.0)
    taken = {}
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 60
    assert sorted(out) == sorted(mix(df, (5, 2, 1), 1.5, 2.0, 7).collect())
    copies = {}
    for r in mixed(df, (5, 2, 1), 1.5, 2.0, 7).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {r["doc_id"]: r["copies"] for r in out if r["copies"]}


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty, (5, 2, 1), 1.5, 2.0, 7).collect() == []
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["taken"], r["target"]) for r in mix(nothing, (5, 2, 1), 1.5, 2.0, 7).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
    same = spark.createDataFrame([(1, "a b c", "s")] * 3, "doc_id long, text string, source string")
    assert sorted(r["taken"] for r in mix(same, (5, 2, 1), 1.5, 2.0, 7).collect()) in ([3, 3, 6], [3, 6, 6])


def test_columns_with_the_operators_own_names(spark):
    df = spark.createDataFrame([(i, "a b c " * (i + 1), "s", 7, "k", i) for i in range(20)], "doc_id long, text string, source string, mix_id int, mix_key string, `mix_row` int")
    got = mixed(df, (5, 2, 1), 1.5, 2.0, 7)
    assert got.columns == df.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows and all(r["mix_id"] == 7 and r["mix_key"] == "k" and r["mix_row"] == i for i, r in rows.items())


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "x y", "a"), (3, None, "b")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mix(df, (5, 2, 1), 1.5, 2.0, 7).collect()} == {1: 300_000, 2: 2, 3: 0}
