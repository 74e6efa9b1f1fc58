import math
import random

from kinomill.llm.topn import top_per_group

SCHEMA = "g string, item string, score float"


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -math.inf), s)
    groups = {}
    for (g, i), s in best.items():
        groups.setdefault(g, []).append((-s, i is not None, i or "", i))
    return {(g, x[3], r + 1) for g, xs in groups.items() for r, x in enumerate(sorted(xs)[:n])}


def got(spark, rows, n, schema=SCHEMA):
    return {(r["g"], r["item"], r["rank"]) for r in top_per_group(spark.createDataFrame(rows, schema), ["g"], "item", "score", n).collect()}


def test_against_brute_force_with_ties_nulls_and_a_hot_group(spark):
    rng = random.Random(2)
    scores = [None, float("nan"), 0.0, -1.0, 0.5, 0.25, 1.0, float("inf"), float("-inf"), 2.0]
    rows = [(rng.choice(["a"] * 10 + ["b", "c", None, ""] + [str(k) for k in range(40)]), rng.choice([None, ""] + [f"i{k}" for k in range(60)]), rng.choice(scores)) for _ in range(4000)]
    for n in (1, 3, 5):
        assert got(spark, rows, n) == brute(rows, n)


def test_all_scores_equal(spark):
    rows = [("a", f"i{k:03d}", 1.0) for k in range(50)] * 2
    assert got(spark, rows, 3) == {("a", "i000", 1), ("a", "i001", 2), ("a", "i002", 3)}


def test_an_item_seen_in_a_higher_band_does_not_come_again(spark):
    rows = [("a", "x", 10.0), ("a", "y", 9.0)] + [("a", "x", float(s)) for s in range(8)] + [("a", "z", 0.5), ("a", "w", 0.25)]
    assert got(spark, rows, 3) == {("a", "x", 1), ("a", "y", 2), ("a", "z", 3)}


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, [], 3) == set()
    df = spark.createDataFrame([("a", "x", 1.0, 7, 8, "q", True)], SCHEMA + ", rank int, g0 int, heavy string, filled boolean")
    out = top_per_group(df, ["g"], "item", "score", 2)
    assert out.columns == ["g", "item", "score", "rank"] and out.count() == 1


def test_only_null_scores_and_long_items(spark):
    long = "x" * 200_000
    assert got(spark, [("a", "x", None), ("b", long, 1.0)], 2) == {("b", long, 1)}


def test_clogged_groups_and_keys_of_several_types(spark):
    rng = random.Random(3)
    # one item of a group with many scores hides the others behind its places
    rows = [("a", "x", 10 + k / 100) for k in range(300)] + [("a", f"y{k}", k / 10) for k in range(9)] + [("b", f"z{k}", rng.random()) for k in range(50)]
    assert got(spark, rows, 3) == brute(rows, 3)
    typed = [(k % 3 or None, None if k % 5 else [k], f"i{k}", float(k)) for k in range(60)]
    out = top_per_group(spark.createDataFrame(typed, "a int, b array<int>, item string, score double"), ["a", "b"], "item", "score", 2)
    assert dict(out.dtypes)["b"] == "array<int>"
    groups = {}
    for a, b, i, s in typed:
        groups.setdefault((a, tuple(b) if b else None), []).append((-s, i))
    assert {(r["a"], tuple(r["b"]) if r["b"] else None, r["item"]) for r in out.collect()} == {(*g, i) for g, x in groups.items() for _, i in sorted(x)[:2]}
