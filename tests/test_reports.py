import random

import pytest
from pyspark.sql import functions as F

from kinomill.lineage import scratch_path
from kinomill.operators import index, intervals, reports, tasks, timeline


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_summaries_with_nothing_in_them(spark):
    frames = rows(spark, [("a", "seek", None), ("a", "seek", " "), ("a", "keyframe", "broken"), ("b", None, "x")], "m string, method string, error string")
    assert got(reports.extraction_summary(frames, "m")) == [("a", "seek", 2, 1), ("b", None, 0, 1)]
    assert reports.extraction_summary(frames.limit(0), "m").count() == 0
    sizes = rows(spark, [("a", 0), ("b", 10), ("c", None)], "m string, size long")
    asked = rows(spark, [("b", 4, 1), ("b", 4, 1), ("a", 3, 0)], "m string, bytes long, block int")
    assert got(reports.range_stats(asked, sizes, "m")) == [("a", 1, 3, 1, 0.0), ("b", 2, 8, 1, 0.8), ("c", 0, 0, 0, 0.0)]
    pairs = rows(spark, [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    assert tuple(reports.drift_report(pairs, "a", "b").first())[:4] == (3, round((1 + 0.5**0.5) / 3, 8), 0.0, 1.0)
    assert reports.drift_report(pairs.limit(0), "a", "b").first()["recommendation"] is None


def test_choices(spark):
    kinds = rows(spark, [("a", "HD", 1, True), ("a", "UHD", 2, False), ("a", "FHD", 3, True), ("b", "SD", 5, True), ("b", "SD", 4, True), ("c", "FHD", 1, False)], "k string, kind string, n int, ok boolean")
    assert [(r["k"], r["n"]) for r in reports.preferred(kinds, "k", "kind", ["UHD", "FHD"], "n", F.col("ok")).orderBy("k").collect()] == [("a", 3), ("b", 4)]
    paths = rows(spark, [(3, "x"), (1, " y "), (2, "x"), (0, None), (5, ""), (4, "z")], "n int, p string")
    assert [r["p"] for r in reports.first_distinct(paths, "p", ["n"], 2).collect()] == ["y", "x"]


def test_ingestion_keeps_what_has_a_vector_and_drops_what_is_rejected(spark):
    images = rows(spark, [(i,) for i in "abcdef"], "image_id string")
    vectors = rows(spark, [("a", [9.0])], "image_id string, vector array<float>")
    faces = rows(spark, [("a", 0.9, [1.0]), ("b", 0.9, [2.0]), ("c", 0.9, [3.0]), ("c", 0.1, [4.0]), ("d", 0.2, [5.0]), ("f", 0.9, [6.0])], "image_id string, score float, vector array<float>")
    state, after = reports.ingested(images, vectors, faces, rows(spark, [("f",)], "image_id string"))
    assert got(state) == [("a", "skipped"), ("b", "ready"), ("c", "rejected"), ("d", "rejected"), ("e", "rejected"), ("f", "failed")]
    assert {(r["image_id"], r["vector"][0]) for r in after.collect()} == {("a", 9.0), ("b", 2.0)}


def test_a_hot_key_in_cells_gives_what_one_window_gives(spark):
    rng = random.Random(3)
    series = [(rng.choice(["hot"] * 8 + ["x", "y"]), float(rng.randint(0, 300)), i) for i in range(600)]
    probes = [(i, rng.choice(["hot"] * 8 + ["x", "none"]), float(rng.randint(-5, 320))) for i in range(400)]
    s, p = rows(spark, series, "k string, t double, v int"), rows(spark, probes, "n int, k string, t double")
    expected = {}
    for n, k, t in probes:
        own = sorted((a, v) for b, a, v in series if b == k)
        before = [x for x in own if x[0] <= t]
        expected[n] = before[-1][1] if before else own[0][1] if own else None
    for width in (None, 7.0, 1e9):
        assert {r["n"]: r["v"] for r in timeline.as_of(p, s, "k", "t", "v", width=width).collect()} == expected
    spans = [(k, t, t + rng.randint(0, 3)) for k, t, _ in series[:150]]
    merged = {}
    for k, a, b in sorted(spans):
        last = merged.setdefault(k, [])
        if last and a <= last[-1][1] + 1:
            last[-1][1] = max(last[-1][1], b)
        else:
            last.append([a, b])
    for width in (None, 5.0, 1e9):
        found = timeline.islands(rows(spark, spans, "k string, start double, end double"), "k", 1.0, width)
        assert {(r["k"], r["start"], r["end"]) for r in found.collect()} == {(k, a, b) for k, x in merged.items() for a, b in x}


def test_gaps_over_cells_against_sets_of_bytes(spark):
    rng = random.Random(5)
    blocks = [(rng.choice("hhhhx"), a := rng.randint(-20, 220), a + rng.randint(0, 15)) for _ in range(60)]
    asked = [(rng.choice("hhxz"), i, a := rng.randint(0, 200), a + rng.randint(0, 60)) for i in range(30)]
    expected = set()
    for k, r, a, b in asked:
        lost = sorted(set(range(a, b)) - {x for j, s, e in blocks if j == k for x in range(s, e)})
        for x in lost:
            if x - 1 not in lost:
                end = x
                while end + 1 in lost:
                    end += 1
                expected.add((k, r, x, end + 1))
    for width in (None, 1, 9, 10_000):
        found = intervals.missing(rows(spark, asked, "k string, request int, start long, end long"), rows(spark, blocks, "k string, start long, end long"), "k", width)
        assert set(map(tuple, found.collect())) == expected


def test_problems_of_media_without_nesting(spark):
    media = rows(spark, [("a", "t", 2000, 5.0), ("b", " ", 1700, -1.0), ("c", None, None, None), ("d", "t", 2000, 1.0)], "media_id string, title string, year int, duration double")
    scenes = rows(spark, [("a", 0.0, 1.0, None), ("b", 2.0, 1.0, 3.0), ("d", 0.0, 1.0, 0.5), ("d", -1.0, 1.0, 1.0)], "media_id string, start double, end double, quality_score float")
    assert {r["media_id"]: r["errors"] for r in reports.media_problems(media, scenes).collect()} == {"a": [], "b": ["title", "year", "duration", "interval", "quality"], "c": ["title", "scenes"], "d": ["interval"]}


def test_changes_and_commands(spark):
    before, after = rows(spark, [(1, "a"), (2, "b"), (3, None)], "id int, state string"), rows(spark, [(2, "c"), (3, None), (4, "d")], "id int, state string")
    assert got(tasks.changes(before, after, "id")) == [(1, "removed", None), (2, "updated", "c"), (4, "updated", "d")]
    media = rows(spark, [("m", 10.0), ("n", None)], "media_id string, duration double")
    commands = rows(spark, [(1, "m", 10.0), (2, "m", 10.1), (3, "m", float("nan")), (4, "n", 1e9), (5, "n", float("inf")), (6, "x", 1.0), (7, "m", None), (8, "m", -0.1)], "n int, media_id string, time double")
    assert {r["n"]: r["problem"] for r in tasks.checked_commands(commands, media).collect()} == {1: None, 2: "bad time", 3: "bad time", 4: None, 5: "bad time", 6: "unknown media", 7: "bad time", 8: "bad time"}


def test_tables_that_are_absent_empty_or_broken(spark, tmp_path):
    path = scratch_path(spark, "absent")
    assert index.stored_table(spark, path, "a int").count() == 0 == index.json_table(spark, path, "a int").count()
    (tmp_path / "empty.json").write_text("")
    assert index.json_table(spark, f"file://{tmp_path}/empty.json", "a int").count() == 0
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        index.json_table(spark, f"file://{tmp_path}/bad.json", "a int").collect()
