import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinomill import lineage
from kinomill.operators import catalog, faces, index, intervals, search, tasks, timeline
from kinomill.operators.search import SearchRequest
from kinomill.plans.catalog import names_scan_io08
from kinomill.plans.search import scan_sorted_p06_sl15

SCENES = "scene_id string, media_id string, start double, embedding array<float>, embedding_model string, person_ids array<string>, preview string, preview_path string, preview_time double"
MEDIA = "media_id string, type string, year int, language array<string>, metadata string"


def documents(spark, scenes, media, request):
    return search.scene_documents(spark.createDataFrame(scenes, SCENES), spark.createDataFrame(media, MEDIA), request)


def scene(i, media, vector, persons=(), preview=""):
    return (i, media, 0.0, vector, "m", list(persons), preview, "", 0.0)


FILMS = [("movie", "movie", 2024, ["zh"], None), ("series", "series", 2023, ["en"], None), ("movie-other", "movie", 2024, ["zh"], None)]


def test_best_scene_and_threshold(spark):
    rows = [scene("r1", "movie", [1.0, 0.0]), scene("r2", "movie", [0.0, 0.0]), scene("s1", "series", [0.0, 1.0]), scene("lost", "none", [1.0, 0.0]), scene("bad", "movie", [1.0])]
    request = SearchRequest([1.0, 0.0], limit=1)
    found = search.search_media(documents(spark, rows, FILMS, request), request).collect()
    assert [(r["media_id"], r["scene_id"], r["score"]) for r in found] == [("movie", "r1", 1.0)]
    nothing = SearchRequest([0.0, 0.0])
    assert search.search_media(documents(spark, rows, FILMS, nothing), nothing).count() == 0
    hit = SearchRequest([1.0, 0.0], min_score=0.6, mode="scene")
    assert [r["scene_id"] for r in search.search_scenes(documents(spark, [scene("hit", "movie", [1.0, 0.0]), scene("miss", "movie", [0.0, -1.0])], FILMS, hit), hit).collect()] == ["hit"]


def test_filters(spark):
    rows = [scene(f"s{i}", m, [1.0, 1.0], [p]) for i, (m, p) in enumerate((("movie", "a"), ("series", "b"), ("movie-other", "c")))]
    for request, ids in (
        (SearchRequest([1.0, 1.0], media_type="movie", year=2024, language="zh"), {"s0", "s2"}),
        (SearchRequest([1.0, 1.0], media_id="movie-other"), {"s2"}),
        (SearchRequest([1.0, 1.0], person_ids=["a", "b"]), {"s0", "s1"}),
        (SearchRequest([1.0, 1.0], person_id="c"), {"s2"}),
        (SearchRequest([1.0, 1.0], year=1999), set()),
    ):
        assert {r["scene_id"] for r in documents(spark, rows, FILMS, request).collect()} == ids


def test_cosine_and_default_limits(spark):
    rows = [scene("large", "movie", [10.0, 0.0]), scene("same", "movie", [1.0, 1.0])]
    request = SearchRequest([1.0, 1.0], limit=1, mode="scene")
    assert [(r["scene_id"], round(r["score"], 6)) for r in search.search_scenes(documents(spark, rows, FILMS, request), request).collect()] == [("same", 1.0)]
    assert SearchRequest([]).settled().limit == 16 == SearchRequest([], limit=101).settled().limit
    assert search.catalog_limit(0) == 20 and search.catalog_limit(101) == 100
    for bad in (SearchRequest([], min_score=1.5), SearchRequest([], mode="x")):
        with pytest.raises(ValueError):
            bad.settled()


def test_search_is_one_scan_without_a_join_of_the_query(spark):
    request = SearchRequest([1.0, 0.0], mode="scene")
    plan = search.search_scenes(spark.createDataFrame([scene("a", "movie", [1.0, 0.0])], SCENES), request)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Join" not in plan and "Exchange" not in plan


def test_listing_is_whole_and_in_order(spark):
    rows = [(f"s{i:03d}", f"m{i * 7 % 5}", float(i * 31 % 97), [1.0], "m", ["p"] if i % 2 else [], "", "", 0.0) for i in range(300)]
    media = [(f"m{i}", "movie" if i else "series", 2000, [], None) for i in range(4)]  # m4 is no known media
    got = search.listing(documents(spark, rows, media, SearchRequest((), media_type="movie", person_id="p")))
    right = sorted((r[1], r[2], r[0]) for r in rows if r[1] in ("m1", "m2", "m3") and r[5])
    assert [(r["media_id"], r["start"], r["scene_id"], r["place"]) for r in got.collect()] == [(*r, i) for i, r in enumerate(right, 1)]
    assert search.listing(documents(spark, [], media, SearchRequest(()))).count() == 0


def test_the_listing_query_has_every_row(spark, tmp_path):
    rows = [(i, i * 7 % 5, [1.0]) for i in range(1, 251)]
    spark.createDataFrame(rows, "vec_id int, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = scan_sorted_p06_sl15(spark, str(tmp_path)).collect()
    right = sorted((label, i) for i, label, _ in rows)
    assert [tuple(r) for r in got] == [(i, label, n) for n, (label, i) in enumerate(right, 1)]


def test_preview_times(spark):
    metadata = '{"frame_extraction_sources": [{"scene_index": 0, "sample_timestamp": 13.303}, {"scene_index": 1, "sample_timestamp": 44.662}, {"scene_index": 2}]}'
    rows = [scene("s0", "m", [1.0], (), "/frames/frame-000001.jpg"), scene("s1", "m", [1.0], (), "/frames/frame-000002.jpg"), scene("s2", "m", [1.0], (), "x.jpg")]
    got = search.with_preview_times(spark.createDataFrame(rows, SCENES), spark.createDataFrame([("m", "", None, [], metadata)], MEDIA))
    assert {r["scene_id"]: r["preview_time"] for r in got.collect()} == {"s0": 13.303, "s1": 44.662, "s2": 0.0}


def test_identity_map_and_repoint(spark):
    rows = [("external:nm1", "nm1", 0), ("tmdb:7", "", 7), ("both", "nm1", 7), ("alone", "", 0), ("c1", "x", 1), ("c2", "x", 2), ("c3", "y", 2), ("c4", "y", 3), ("c5", None, 3)]
    got = catalog.identity_map(spark.createDataFrame(rows, "id string, imdb string, tmdb int"), ["imdb", "tmdb"])
    assert {r["id"]: r["canonical"] for r in got.collect()} == {**dict.fromkeys(("external:nm1", "tmdb:7", "both"), "both"), "alone": "alone", **dict.fromkeys(("c1", "c2", "c3", "c4", "c5"), "c1")}
    cast = spark.createDataFrame([("m", "tmdb:7", 2), ("m", "both", 1), ("n", "tmdb:7", 3)], "movie string, person string, n int")
    assert {tuple(r) for r in catalog.repoint(cast, got, "person", ["movie", "person"]).collect()} == {("m", "both", 1), ("n", "both", 3)}


def test_long_chains_of_identities(spark):
    rows = [(f"p{i:03d}", f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(200)]
    got = catalog.identity_map(spark.createDataFrame(rows, "id string, a string, b string"), ["a", "b"])
    assert {r["canonical"] for r in got.collect()} == {"p000"}


def test_identities_that_are_not_settled_are_no_result(spark):
    rows = spark.createDataFrame([(f"p{i:03d}", f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(60)], "id string, a string, b string")
    with pytest.raises(RuntimeError, match="not settled"):
        catalog.identity_map(rows, ["a", "b"], rounds=2)


def test_merging(spark):
    old = spark.createDataFrame([(1, "a", 5, ["x"]), (2, "b", 6, [])], "id int, t string, n int, l array<string>")
    new = spark.createDataFrame([(1, " ", 0, ["y"]), (3, "c", 7, None)], "id int, t string, n int, l array<string>")
    got = {r["id"]: (r["t"], r["n"], r["l"]) for r in catalog.merge_rows(old, new, "id", {"t": "text", "n": "always", "l": "list"}).collect()}
    assert got == {1: ("a", 0, ["y"]), 2: ("b", 6, []), 3: ("c", 7, None)}
    maps = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"}), ({}, {})], "o map<string,string>, n map<string,string>")
    assert [r[0] for r in maps.select(catalog.merge_maps(F.col("o"), F.col("n"))).collect()] == [{"a": "1", "b": "2"}, None]


def test_names_of_every_id_are_scanned(spark, tmp_path):
    kinds = {"nm01": "actor", "nm12": "actress", "nm50": "actor", "xx9": "actress", "nm70": "writer", "nm13": "director"}
    lines = [(i, f"tt{i}\t1\t{name}\t{kind}\t\\N\t\\N") for i, (name, kind) in enumerate(kinds.items())]
    spark.createDataFrame(lines, "line_no int, line string").write.parquet(f"{tmp_path}/raw_title_principals.parquet")
    assert {r["name_id"] for r in names_scan_io08(spark, str(tmp_path)).collect()} == {"nm01", "nm12", "nm50", "xx9"}


def test_names_of_one_known_row_only(spark):
    known = spark.createDataFrame([("k1", "jaden"), ("k2", "will"), ("k3", "will")], "id string, name string")
    bare = spark.createDataFrame([("b1", "jaden"), ("b2", "will"), ("b3", "none")], "id string, name string")
    assert [tuple(r) for r in catalog.unique_by_name(bare, known, "name").collect()] == [("b1", "k1")]


def test_ready_people(spark):
    persons = spark.createDataFrame([("p1",), ("p2",)], "person_id string")
    vectors = spark.createDataFrame([("p1",), ("p2",)], "person_id string")
    cast = spark.createDataFrame([("m1", "p1"), ("m2", "p2")], "title_id string, person_id string")
    title = spark.createDataFrame([("m1",)], "title_id string")
    assert [r[0] for r in catalog.ready_people(persons, vectors, 1, cast, title).collect()] == ["p1"]
    assert catalog.ready_people(persons, vectors, 2, cast, title).count() == 0
    assert catalog.ready_people(persons, vectors, 1, cast, title.limit(0)).count() == 0


def test_faces(spark):
    face = spark.createDataFrame([("f", "s", "m", [1.0, 0.0], 0.99)], "face_id string, scene_id string, media_id string, embedding array<float>, det_score float")
    references = spark.createDataFrame([("v1", "person-a", 0.9, [1.0, 0.0], "m"), ("v2", "person-b", 0.9, [0.0, 1.0], "m")], "vector_id string, person_id string, quality float, vector array<float>, media_id string")
    tagged = faces.tag_faces(face, references, "media_id").collect()
    assert [(r["person_id"], r["match_count"]) for r in tagged] == [("person-a", 1)] and tagged[0]["best_score"] >= 0.99
    assert faces.tag_faces(face, references.limit(0), "media_id").count() == 0


def test_even_spread(spark):
    rows = spark.createDataFrame([("g", i) for i in range(10)] + [("h", 1)], "g string, n int")
    assert {(r["g"], r["n"]) for r in faces.evenly_spread(rows, "g", ["n"], 4).collect()} == {("g", 0), ("g", 3), ("g", 6), ("g", 9), ("h", 1)}


def test_as_of_and_first(spark):
    series = spark.createDataFrame([("k", 10, "a"), ("k", 20, "b"), ("j", 5, "c")], "k string, t int, v string")
    probes = spark.createDataFrame([("k", 5, 1), ("k", 10, 2), ("k", 19, 3), ("k", 25, 4), ("x", 1, 5)], "k string, t int, n int")
    assert {r["n"]: r["v"] for r in timeline.as_of(probes, series, "k", "t", "v").collect()} == {1: "a", 2: "a", 3: "a", 4: "b", 5: None}
    assert {r["n"]: r["v"] for r in timeline.as_of(probes, series, "k", "t", "v", False).collect()} == {1: None, 2: "a", 3: "a", 4: "b", 5: None}


def test_refinement_windows(spark):
    rows = spark.createDataFrame([("v", t, 60.0) for t in (50.0, 8.0, 16.0, 0.1)], "k string, t double, duration double")
    assert sorted((r["start"], r["end"]) for r in timeline.refinement_windows(rows, "k").collect()) == [(0.0, 17.0), (40.0, 51.0)]


def test_missing_ranges_against_plain_sets(spark):
    rng = random.Random(1)
    blocks, requests = [], []
    for k in range(8):
        blocks += [(str(k), s, s + rng.randint(1, 12)) for s in (rng.randrange(100) for _ in range(rng.randint(0, 8)))]
        requests.append((str(k), 0, a := rng.randrange(80), a + rng.randint(1, 30)))
    b = spark.createDataFrame(blocks, "k string, start long, end long")
    q = spark.createDataFrame(requests, "k string, request int, start long, end long")
    got = {}
    for r in intervals.missing(q, b, "k").collect():
        got.setdefault(r["k"], set()).update(range(r["start"], r["end"]))
    for k, _, a, z in requests:
        held = {x for key, s, e in blocks if key == k for x in range(s, e)}
        assert got.get(k, set()) == set(range(a, z)) - held
    assert {r["k"]: r["complete"] for r in intervals.covered(q, b, "k").collect()} == {k: k not in got for k, *_ in requests}


def test_recency(spark):
    rows = spark.createDataFrame([("k", 1, 0, 50), ("k", 3, 10, 40), ("k", 2, 20, 40), ("j", 1, 0, 500)], "k string, used int, start int, bytes int")
    assert {(r["k"], r["used"]) for r in intervals.kept_by_recency(rows, "k", 100).collect()} == {("k", 3), ("k", 2), ("j", 1)}


def test_index_updates(spark):
    scenes = spark.createDataFrame([("m1", "s1", ["x"]), ("m1", "s2", []), ("m2", "s3", [])], "media_id string, scene_id string, person_ids array<string>")
    updates = spark.createDataFrame([("m1", "s2", ["old"], 1), ("m1", "s2", [" a", "b", "a", ""], 2), ("m2", "s1", ["z"], 3)], "media_id string, scene_id string, person_ids array<string>, n int")
    assert {r["scene_id"]: r["person_ids"] for r in index.update_people(scenes, updates).collect()} == {"s1": ["x"], "s2": ["a", "b"], "s3": []}
    pairs = spark.createDataFrame([("m2", "s1"), ("m1", "s2")], "media_id string, scene_id string")
    assert {r["scene_id"] for r in index.delete_scenes(scenes, pairs).collect()} == {"s1", "s3"}
    media = spark.createDataFrame([("m1",), ("m2",)], "media_id string")
    _, left = index.upsert_media(media, scenes, media.filter("media_id = 'm2'"), spark.createDataFrame([("m2", "s1", ["n"])], scenes.schema))
    assert {(r["media_id"], r["scene_id"]) for r in left.collect()} == {("m1", "s2"), ("m2", "s1")}


def test_validation(spark):
    schema = "media_id string, type string, title string, year int, duration double, scenes array<struct<start:double,end:double,quality_score:float>>"
    rows = [("ok", "", "T", None, None, [(0.0, 1.0, 0.0)]), ("bad", "x", " ", 1500, -1.0, [(2.0, 1.0, 2.0)]), ("none", "x", "T", 2000, 1.0, None)]
    settled = index.settled_media(spark.createDataFrame(rows, schema))
    got = {r["media_id"]: (r["type"], r["e"]) for r in settled.select("media_id", "type", index.media_errors().alias("e")).collect()}
    assert got == {"ok": ("movie", []), "bad": ("x", ["title", "year", "duration", "interval", "quality"]), "none": ("x", ["scenes"])}


def test_tables_are_replaced_in_place(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    index.replace_table(spark.range(3), path)
    index.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_tasks(spark):
    events = spark.createDataFrame([("a", 1, "queued", 0.1), ("a", 2, "running", 0.5), ("a", 3, "running", 0.3), ("b", 1, "failed", 2.0)], "id string, n int, state string, percent double")
    assert {r["id"]: (r["n"], r["state"]) for r in tasks.latest_states(events, "id", ["n"]).collect()} == {"a": (3, "running"), "b": (1, "failed")}
    assert [r["percent"] for r in tasks.running_percent(events, "id", ["n"]).orderBy("id", "n").collect()] == [0.1, 0.5, 0.5, 1.0]
    states = events.groupBy("id").agg(F.max_by("state", "n").alias("state"))
    assert {r["id"]: r["state"] for r in tasks.recovered(states).collect()} == {"a": "failed", "b": "failed"}
    assert [r["id"] for r in tasks.without_terminal(states).collect()] == ["a"]


def test_lineage(spark):
    path = lineage.scratch_path(spark, "x")
    assert path.startswith(lineage.shared_dir(spark))
    assert lineage.cut(spark.range(5)).count() == 5


def test_a_crowded_group_is_scored_in_blocks(spark, monkeypatch):
    """Blocks of a few faces and people, faces of several groups, vectors of other lengths, nulls and zeros, against the plain formula."""
    monkeypatch.setattr(faces, "FACES", 4)
    monkeypatch.setattr(faces, "PEOPLE", 6)
    rng = random.Random(3)
    vector = lambda n=8: [float(np.float32(rng.gauss(0, 1))) for _ in range(n)]
    face = [(f"f{i}", f"s{i}", "hot" if i < 20 else f"g{i % 5}", vector()) for i in range(30)] + [("f2", "s2", "g1", vector()), ("odd", "so", "hot", vector(5)), ("none", "sn", "hot", [0.0] * 8), ("null", "su", "hot", [1.0] * 7 + [None])]
    known = [(g, f"p{p}", vector()) for g in ("hot", "g0", "g1") for p in range(9) for _ in range(p % 5 + 1)] + [("hot", "p1", vector(5)), ("hot", "p3", [0.0] * 8), ("hot", "mirror", [-x for x in face[0][3]])]
    left = spark.createDataFrame(face, "face_id string, scene_id string, g string, embedding array<float>")
    right = spark.createDataFrame(known, "g string, person_id string, vector array<float>")

    def cosine(a, b):
        x, y = np.array(a, np.float64), np.array(b, np.float64)
        return max(-1.0, min(1.0, float(x @ y / np.sqrt((x @ x) * (y @ y))))) if len(a) == len(b) and x.any() and y.any() and not np.isnan(x).any() else -1.0

    found = {}
    for f, _, g, a in face:
        for h, p, b in known:
            if g == h:
                found.setdefault((f, p), []).append(cosine(a, b))
    mean = lambda s: float(np.mean(sorted((x for x in s if x > -1 + 1e-6), reverse=True)[:3] or [-1.0]))
    wanted = {key: mean(s) for key, s in found.items()}
    got = {(r["face_id"], r["person_id"]): r["score"] for r in faces.person_scores(left, right, "g").collect()}
    assert got == pytest.approx(wanted, abs=1e-5)
    first = {(r["face_id"], r["person_id"]): r["score"] for r in faces.person_scores(left, right, "g", 2).collect()}
    assert all(got[key] == score for key, score in first.items()) and len(first) < len(got)
    for f in {f for f, *_ in face}:
        best = sorted((-s, p) for (x, p), s in got.items() if x == f)[:2]
        assert all((f, p) in first for _, p in best)
