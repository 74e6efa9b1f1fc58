import gzip
import struct

import pytest
from pyspark.sql import functions as F

from kinomill.operators import catalog, credits, resolve
from kinomill.plans import blobs
from kinomill.sources import containers, files, snapshots


def box(kind, *body):
    data = b"".join(body)
    return struct.pack(">I4s", 8 + len(data), kind.encode()) + data


def full(kind, *numbers, form="I"):
    return box(kind, b"\0" * 4, struct.pack(f">{len(numbers)}{form}", *numbers))


def movie(sync=(1, 3)):
    table = box(
        "stbl", full("stts", 2, 2, 100, 2, 50), full("stsz", 0, 4, 10, 20, 30, 40), full("stsc", 2, 1, 3, 1, 2, 1, 1), full("stco", 2, 1000, 5000), *([full("stss", len(sync), *sync)] if sync is not None else [])
    )
    media = box("mdia", box("mdhd", b"\0" * 12, struct.pack(">II", 100, 300)), box("hdlr", b"\0" * 8, b"vide", b"\0" * 12), box("minf", table))
    return box("ftyp", b"isom") + box("moov", box("trak", box("mdia", box("hdlr", b"\0" * 8, b"soun"))), box("trak", media))


def element(name, body):
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + bytes([0x40 | len(body) >> 8, len(body) & 255]) + body


def test_mp4():
    assert containers.mp4_keyframes(movie()) == [{"number": 1, "seconds": 0.0, "offset": 1000, "size": 10}, {"number": 3, "seconds": 2.0, "offset": 1030, "size": 30}]
    assert [k["offset"] for k in containers.mp4_keyframes(movie(None))] == [1000, 1010, 1030, 5000]
    for cut in range(0, len(movie()), 7):
        containers.mp4_keyframes(movie()[:cut])


def test_matroska():
    cue = element(0xBB, element(0xB3, b"\x05") + element(0xB7, element(0xF7, b"\x01") + element(0xF1, b"\x10\x00")) + element(0xB7, element(0xF1, b"\x20") + element(0xF0, b"\x07")))
    timeless = element(0xBB, element(0xB7, element(0xF1, b"\x01")))
    data = element(0x1A45DFA3, b"") + element(0x18538067, element(0x1549A966, element(0x2AD7B1, (2_000_000).to_bytes(3, "big"))) + element(0x1C53BB6B, cue + timeless))
    assert containers.matroska_cues(data) == [{"seconds": 0.01, "track": 1, "cluster": 4096, "relative": None}, {"seconds": 0.01, "track": 0, "cluster": 32, "relative": 7}]
    assert containers.variable_number(b"\xff", 0, False) == (None, 1)
    with pytest.raises(ValueError):
        containers.variable_number(b"\x00", 0, False)


def test_indexes_of_columns(spark):
    df = spark.createDataFrame([("a", bytearray(movie()), 5000), ("b", bytearray(b"junk"), 5000), ("c", None, 1), ("d", bytearray(movie(None)), 5000)], "id string, content binary, size long")
    index = df.select("id", "size", containers.keyframes(F.col("content")).alias("keyframes"))
    assert {r["id"]: None if r["keyframes"] is None else len(r["keyframes"]) for r in index.collect()} == {"a": 2, "b": 0, "c": None, "d": 4}
    assert [r["id"] for r in containers.sound_index(index, "size").collect()] == ["a"]


def test_video_files(spark, tmp_path):
    for name in ("b.mkv", "a.MP4", "x.txt", "empty.mp4", "sub/c.RMVB", "sub/e.3gp", ".hidden/d.avi"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"" if "empty" in name else b"12")
    assert [r["path"].rpartition("/")[2] for r in files.video_files(spark, str(tmp_path)).collect()] == ["a.MP4", "b.mkv"]
    assert [r["path"].rpartition("/")[2] for r in files.video_files(spark, str(tmp_path), True).collect()] == ["a.MP4", "b.mkv", "c.RMVB", "e.3gp"]
    with pytest.raises(ValueError):
        files.video_files(spark, str(tmp_path), True, most=2)


def test_snapshots(spark, tmp_path):
    lines = "tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres\ntt7410\tmovie\tSalt \"Harbour\tHavn av salt\t0\t1987\t\\N\t103\tWestern,Musical\ntt7411\tshort\tKettle\tKettle\t0\t1979\t\\N\t\\N\t\\N\nshort line\ntt7412\tmovie\tNight Ferry\tNight Ferry\t1\t\\N\t\\N\t88\t\n"
    (tmp_path / "t.tsv.gz").write_bytes(gzip.compress(lines.encode()))
    titles = snapshots.titles(snapshots.read_lines(spark, str(tmp_path / "t.tsv.gz")))
    assert {r["title_id"]: (r["title"], r["year"], r["runtime_minutes"], r["genres"]) for r in titles.collect()} == {
        "tt7410": ('Salt "Harbour', 1987, 103, ["Western", "Musical"]), "tt7411": ("Kettle", 1979, 0, []), "tt7412": ("Night Ferry", None, 88, []),
    }
    assert [r["title_id"] for r in catalog.select_titles(titles, include_adult=False, first_year=1980).collect()] == ["tt7410"]
    (tmp_path / "ids").write_text("tt1 # one\n\n# none\n tt2\ntt1\n")
    assert {r["title_id"] for r in snapshots.allowed_ids(snapshots.read_lines(spark, str(tmp_path / "ids"))).collect()} == {"tt1", "tt2"}
    (tmp_path / "m.jsonl").write_text('{"media_id": "a", "title": "x", "year": 2000}\n{"title": "y"}\n')
    ids = [r["media_id"] for r in snapshots.media_lines(spark, str(tmp_path / "m.jsonl")).collect()]
    assert "a" in ids and len(set(ids)) == 2 and all(ids)
    (tmp_path / "bad.jsonl").write_text('{"media_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        snapshots.media_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def test_trees_with_cycles(spark):
    rows = [("a", "root", True), ("b", "a", True), ("a", "b", True), ("x", "b", False), ("y", "root", False), ("z", "nowhere", False)]
    found = files.tree_of(spark.createDataFrame(rows, "file_id string, parent_file_id string, is_folder boolean"), "root")
    assert {(r["file_id"], r["depth"]) for r in found.collect()} == {("x", 3), ("y", 1)}


def test_credits(spark):
    json = '{"cast": [{"id": 7, "name": "A", "character": "x"}, {"id": 7, "name": "A", "character": "y"}, {"id": 0, "name": "B"}, {"id": 8, "name": " "}, {"id": 9, "name": "C  D"}]}'
    df = spark.createDataFrame([("t", json)], "title_id string, json string")
    cast = credits.cast_rows(df)
    assert [(r["person"], r["billing_order"]) for r in cast.orderBy("billing_order").collect()] == [(7, 0), (7, 1), (9, 4)]
    assert credits.people(cast).count() == 2
    assert [r["person"] for r in credits.cast_rows(df, spark.createDataFrame([("c d",)], "name string")).collect()] == [9]
    assert credits.cast_rows(df, spark.createDataFrame([], "name string")).count() == 0


def test_resolution_tiers(spark):
    titles = spark.createDataFrame([("tt52", "Brúnó", "Brúnó", 1948), ("tt61", "A Nagy Utazás", "A Nagy Utazás", 1993), ("t3", "The Weight of Lanterns", "", 2014)], "title_id string, title string, original_title string, year int")
    akas = spark.createDataFrame([("tt61", "Bruno across the River")], "title_id string, title string")
    rows = [("m1", "t3", "x", "", None), ("m2", "", "Bruno", "", None), ("m3", "", "The.Weight.of.Lanterns.2014.1080p.mkv", "", None), ("m4", "", "bruno across the river", "", None), ("m5", "", "Nothing", None, None)]
    media = spark.createDataFrame([(*r, "") for r in rows], "media_id string, movie_id string, title string, original_title string, year int, remote_name string")
    got = {r["media_id"]: (r["title_id"], r["tier"]) for r in resolve.resolve(media, titles, akas).collect()}
    assert got == {"m1": ("t3", 1), "m2": ("tt52", 2), "m3": ("t3", 2), "m4": ("tt61", 4)}
    # any word brings in its titles, a rarer one that leads elsewhere does not hide them; the year decides first
    more = spark.createDataFrame([("w1", "Weight", "", 1999), ("w2", "Lanterns over Zurich", "", 2014), ("w3", "Zurich", "", 2014)], "title_id string, title string, original_title string, year int")
    rows = [("m6", "", "Weight of Zurich Lanterns", "", 2014, ""), ("m7", "", "my Zurich lanterns", "", None, "")]
    media2 = spark.createDataFrame(rows, "media_id string, movie_id string, title string, original_title string, year int, remote_name string")
    got = {r["media_id"]: (r["title_id"], r["tier"]) for r in resolve.resolve(media2, titles.unionByName(more), akas).collect()}
    assert got["m6"][1] == 3 and got["m6"][0] in ("w2", "w3", "t3") and got["m7"][1] == 5
    scenes = spark.createDataFrame([("m1",)], "media_id string")
    assert [r["title_id"] for r in resolve.processed_titles(media, scenes, titles, akas).collect()] == ["t3"]


def test_matroska_blocks():
    for seek in (False, True):
        data = blobs.matroska(seek)
        assert [(k["seconds"], data[k["offset"] : k["offset"] + k["size"]]) for k in containers.matroska_keyframes(data)] == [(0.0, b"ABCDE"), (5.0, b"picture")]
        assert containers.matroska_seconds(data) == 7.5
        assert [(t["number"], t["kind"], t["codec"]) for t in containers.matroska_tracks(data)] == [(1, 2, "A_AAC"), (2, 1, "V_TEST")]
        for end in range(len(data)):  # cut off anywhere, nothing breaks
            containers.matroska_keyframes(data[:end])
    frames = lambda lacing, body: containers._block(bytes([0x81, 0, 0, 0x80 | lacing]) + body, 0, 4 + len(body))
    assert frames(0x00, b"abc") == (1, 0x80, 4, 7)
    assert frames(0x04, bytes([2]) + b"aabbcc")[2:] == (5, 7)
    assert frames(0x06, bytes([2, 0x83, 0xC0]) + b"aaabbcccc")[2:] == (7, 10)
    assert frames(0x02, bytes([1, 255, 1]) + b"a" * 256 + b"b")[2:] == (7, 263)
    assert frames(0x02, b"") is None
    assert containers.float_number(b"", 0, 0) == 0.0 and containers.float_number(b"\x3f\x80\0\0", 0, 4) == 1.0
    with pytest.raises(ValueError):
        containers.float_number(b"abc", 0, 3)
