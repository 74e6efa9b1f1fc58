from pyspark.sql import functions as F

from kinomill.functions import byteranges, numbers, text, timeline, vectors


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [r[0] if len(columns) == 1 else tuple(r) for r in df.select(*columns).collect()]


def test_normalizing(spark):
    got = values(spark, [(" A\u00a0 b\tC ",), ("",), (None,), ("ΟΔΟΣ",)], "x string", text.normalized(F.col("x")))
    assert got == ["a b c", "", None, "οδοσ"]
    assert values(spark, [("Amélie  ŒUVRE ß ẞ Åñ",)], "x string", text.loosely_normalized(F.col("x"))) == ["amelie oeuvre ss ß an"]


def test_file_names(spark):
    names = ["Copperfield.Lane.1974.720p.WEBRip.x264-GRP.mkv", "雪山之下 3 (2018) 4K.mp4", "1914 The Last Post 1931.mkv", "Harbour.1974", "no year_here-x.mkv", "/v/w/Glass.Orchard.1962.mkv"]
    got = values(spark, [(n,) for n in names], "x string", text.resolved_name(F.col("x")))
    assert [(r["title"], r["year"]) for r in got] == [("Copperfield Lane", 1974), ("雪山之下 3", 2018), ("", 1914), ("Harbour", None), ("no year here x", None), ("Glass Orchard", 1962)]


def test_ids(spark):
    row = values(spark, [("movie", 123, "x", "T", 1999)], "k string, t int, e string, n string, y int", text.entity_id(*(F.col(c) for c in "kteny")))
    assert row == ["movie:tmdb:123"]
    row = values(spark, [("person", 0, " NM7 ", "T", None)], "k string, t int, e string, n string, y int", text.entity_id(*(F.col(c) for c in "kteny")))
    assert row == ["person:external:nm7"]


def test_paths(spark):
    paths = ["G:\\Reels\\k7.mkv", "D:/Reels/k7.mkv", "/a//b/./c/../d", "a/../../b", "", "/..", "./x"]
    assert values(spark, [(p,) for p in paths], "x string", text.normalized_path(F.col("x"))) == ["/mnt/g/Reels/k7.mkv", "/mnt/d/Reels/k7.mkv", "/a/b/d", "../b", "", "/", "x"]
    frames = ["/v1/frames/frame-000001.jpg?size=small", "https://h/f.jpg", "C:\\x\\a%20b.jpg", "..", "/a/..%2Fb", "", "a+b.jpg"]
    assert values(spark, [(p,) for p in frames], "x string", text.frame_file_name(F.col("x"))) == ["frame-000001.jpg", "", "a b.jpg", "", "", "", "a+b.jpg"]
    assert values(spark, [(n,) for n in ("a/frame-000003.jpg", "frame-0.jpg", "x\\frame-12", "frame-x.jpg", "")], "x string", text.preview_frame_index(F.col("x"))) == [2, -1, 11, -1, -1]
    assert values(spark, [(n,) for n in (" a b?.jpg ", "..", "", "_x_")], "x string", text.safe_file_name(F.col("x"))) == ["a_b_.jpg", "reference", "reference", "x"]


def test_tokens_and_hints(spark):
    assert values(spark, [("Snow 山下风 k9",)], "x string", text.search_tokens(F.col("x"))) == [["snow", "k9", "山", "下", "风", "山下", "下风", "山下风"]]
    assert values(spark, [(["The Weight of Lanterns", "a"],)], "x array<string>", text.search_order(F.col("x"))) == [["lanterns", "weight", "the weight of lanterns", "a"]]
    assert values(spark, [("Film.2001.mkv", "film 2001 mkv")], "a string, b string", text.title_hints([F.col("a"), F.col("b")])) == [["Film.2001.mkv", "Film", "film 2001 mkv"]]
    assert values(spark, [("éCole",)], "x string", text.exact_variants(F.col("x"))) == [["éCole", "école", "École"]]
    assert values(spark, [([" a", "b", "a", "", None],)], "x array<string>", text.cleaned_ids(F.col("x"))) == [["a", "b"]]


def test_numbers(spark):
    assert values(spark, [(x,) for x in ("12", " 12", "-3", "0", "x", None, "+7")], "x string", numbers.positive_year(F.col("x"))) == [12, None, None, None, None, None, 7]
    assert values(spark, [(x,) for x in ("8.7", "-1", "x", "1e2")], "x string", numbers.decimal_or_zero(F.col("x")).cast("string")) == ["8.7", "0.0", "0.0", "100.0"]
    assert values(spark, [('{"a": true, "b": "true", "c": 3.7}',)], "x string", numbers.json_flag(F.col("x"), "a"), numbers.json_flag(F.col("x"), "b"), numbers.json_integer(F.col("x"), "$.c")) == [(True, False, 3)]
    size = numbers.fitted_size(F.col("w"), F.col("h"), F.lit(320), F.lit(240))
    assert [(r["width"], r["height"]) for r in values(spark, [(1920, 1080), (100, 50), (1, 4000)], "w int, h int", size)] == [(320, 180), (100, 50), (1, 240)]


def test_vectors(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([10.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])]
    got = values(spark, pairs, "a array<float>, b array<float>", vectors.cosine(F.col("a"), F.col("b")))
    assert [round(x, 6) for x in got] == [1.0, 0.707107, 0.0, 0.0, 0.0]
    assert values(spark, pairs[2:], "a array<float>, b array<float>", vectors.cosine(F.col("a"), F.col("b"), -1.0)) == [-1.0, -1.0, -1.0]
    assert values(spark, [([0.5, 1.0, 0.25, -1.0, 0.75],), ([-1.0],)], "s array<float>", vectors.mean_of_top(F.col("s"))) == [0.75, -1.0]
    assert values(spark, [([1.0, 2.5],)], "a array<float>", vectors.from_bytes(vectors.to_bytes(F.col("a")))) == [[1.0, 2.5]]
    assert values(spark, [(bytearray(b"abc"),)], "b binary", vectors.from_bytes(F.col("b"))) == [[]]
    assert values(spark, [([],), (["a", "a"],)], "t array<string>", F.round(vectors.norm(vectors.hashed_tokens(F.col("t"), 8)), 5)) == [0.0, 1.0]

    assert vectors.case_folded_tokens("Straße 山下风 x2") == ["strasse", "x2", "山", "下", "风", "山下", "下风", "山下风"]
    texts = values(spark, [("a A b",), (None,), ("",)], "t string", vectors.hashed_texts(F.col("t"), 16))
    assert texts[0] == values(spark, [(["a", "a", "b"],)], "t array<string>", vectors.hashed_tokens(F.col("t"), 16))[0] and texts[1] == texts[2] == [0.0] * 16


def test_timeline(spark):
    got = values(spark, [([8.0, 2.0, 2.2, 2.6, 0.1, 9.98],)], "t array<double>", timeline.spaced_boundaries(F.col("t"), F.lit(10.0)))
    assert got == [[2.0, 2.6, 8.0]]
    scenes = values(spark, [([2.0, 2.1, 7.0],)], "t array<double>", timeline.scene_intervals(F.col("t"), F.lit(10.0)))
    assert [(s["start"], s["end"]) for s in scenes[0]] == [(0, 2), (2, 7), (7, 10)]
    cases = [(7001.0, 30.0, 32), (10.0, 3.0, 320), (10.0, 0.0, 32), (10000.0, 1.0, 320)]
    assert values(spark, cases, "d double, i double, m int", F.size(timeline.even_boundaries(F.col("d"), F.col("i"), F.col("m")))) == [31, 3, 0, 319]
    assert values(spark, [(0.35,), (0.01,), (0.99,)], "t double", F.round(timeline.candidate_threshold(F.col("t")), 6)) == [0.105, 0.08, 0.2]
    parts = values(spark, [(12.0,)], "d double", timeline.segments(F.col("d"), F.lit(3), F.lit(1.0)))[0]
    assert [tuple(p)[1:] for p in parts] == [(0, 4, 0, 5), (4, 8, 3, 9), (8, 12, 7, 12)]
    assert values(spark, [([9, 3, 1],), (None,)], "e array<int>", timeline.sync_samples(F.col("e"), F.lit(4))) == [[1, 3], [1, 2, 3, 4]]


def test_ranges(spark):
    headers = ["", "bytes=0-", "bytes=10-19", "bytes=-5", "bytes=5-2", "bytes=0-1,3-4", "bytes=500-", "items=1-2", "bytes=-500", "bytes=-0"]
    got = values(spark, [(h, 100) for h in headers], "h string, s bigint", byteranges.http_range(F.col("h"), F.col("s")))
    none = (None, None, 416)
    assert [tuple(r) for r in got] == [(0, 99, 200), (0, 99, 206), (10, 19, 206), (95, 99, 206), none, none, none, (0, 99, 200), (0, 99, 206), none]
    kinds = values(spark, [(bytearray(b"\0\0\0\x18ftypisom"),), (bytearray(b"\x1aE\xdf\xa3abcd"),), (bytearray(b"xx"),)], "b binary", byteranges.container_kind(F.col("b")))
    assert kinds == ["mp4", "matroska", None]
