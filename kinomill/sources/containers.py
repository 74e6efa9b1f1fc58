"""Reading the index of a video container: which encoded pictures can be entered, when, and where they lie.

The functions on bytes are plain Python; :func:`keyframes` and :func:`cue_points` apply
them to a binary column, a batch at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element ids of the EBML container.
EBML = b"\x1a\x45\xdf\xa3"
SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_KIND, CODEC, PICTURE, WIDTH, HEIGHT = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0xE0, 0xB0, 0xBA
CLUSTER_BODY, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, DURATION = 0x1F43B675, 0xA3, 0xA0, 0xA1, 0xFB, 0x4489
SEGMENT, INFO, SCALE, CUES, CUE, CUE_TIME, POSITIONS, TRACK, CLUSTER, RELATIVE = 0x18538067, 0x1549A966, 0x2AD7B1, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
NANOSECONDS_OF_A_TICK = 1_000_000
#: Bytes of a cluster in which an entry picture is looked for.
CLUSTER_SCAN = 8 * 1024 * 1024


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """Type, start and end of the body of each box; stops at a box that does not fit."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind.decode("latin-1"), start + head, start + size
        start += size


def _inside(data: bytes, span: tuple[int, int], *path: str) -> tuple[int, int] | None:
    for name in path:
        span = next(((a, b) for kind, a, b in boxes(data, *span) if kind == name), None)
        if span is None:
            return None
    return span


def _numbers(data: bytes, span: tuple[int, int] | None, form: str, skip: int = 8) -> list[tuple]:
    """The rows of a table box: a count after version and flags, then rows of ``form``."""
    if span is None:
        return []
    a, b = span
    count = struct.unpack_from(">I", data, a + skip - 4)[0]
    size = struct.calcsize(">" + form)
    count = min(count, (b - a - skip) // size)
    return list(struct.iter_unpack(">" + form, data[a + skip : a + skip + count * size]))


def mp4_keyframes(data: bytes) -> list[dict]:
    """Entry pictures of the first video track, in order of time: number from 1, seconds, offset and size of the bytes."""
    moov = _inside(data, (0, len(data)), "moov")
    for kind, a, b in boxes(data, *moov) if moov else ():
        if kind != "trak":
            continue
        handler, media = _inside(data, (a, b), "mdia", "hdlr"), _inside(data, (a, b), "mdia", "mdhd")
        table = _inside(data, (a, b), "mdia", "minf", "stbl")
        if handler is None or media is None or table is None or data[handler[0] + 8 : handler[0] + 12] != b"vide":
            continue
        parts = {name: (x, y) for name, x, y in boxes(data, *table)}
        scale = struct.unpack_from(">I", data, media[0] + (20 if data[media[0]] == 1 else 12))[0] or 1
        fixed, count = struct.unpack_from(">II", data, parts["stsz"][0] + 4) if "stsz" in parts else (0, 0)
        sizes = [fixed] * count if fixed else [n for (n,) in _numbers(data, parts.get("stsz"), "I", 12)]
        chunks = [n for (n,) in _numbers(data, parts.get("stco"), "I")] or [n for (n,) in _numbers(data, parts.get("co64"), "Q")]
        offsets: list[int] = []
        runs = _numbers(data, parts.get("stsc"), "III")
        for i, (first, samples, _) in enumerate(runs):
            last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)
            for chunk in chunks[first - 1 : last]:
                for _ in range(samples):
                    if len(offsets) < len(sizes):
                        offsets.append(chunk)
                        chunk += sizes[len(offsets) - 1]
        times: list[int] = []
        clock = 0
        for n, delta in _numbers(data, parts.get("stts"), "II"):
            for _ in range(min(n, len(sizes) - len(times))):
                times.append(clock)
                clock += delta
        total = min(len(sizes), len(offsets), len(times))
        listed = range(1, total + 1) if "stss" not in parts else sorted({n for (n,) in _numbers(data, parts["stss"], "I") if 1 <= n <= total})
        found = [{"number": n, "seconds": times[n - 1] / scale, "offset": offsets[n - 1], "size": sizes[n - 1]} for n in listed]
        return sorted(found, key=lambda k: (k["seconds"], k["number"]))
    return []


def variable_number(data: bytes, at: int, keep_marker: bool) -> tuple[int | None, int]:
    """A number whose first set bit tells its length; None for the reserved value of all ones. Raises ValueError if there is none."""
    if at >= len(data) or data[at] == 0:
        raise ValueError("no number")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError("cut off")
    value = int.from_bytes(data[at : at + length], "big")
    if not keep_marker:
        value &= (1 << (7 * length)) - 1
        if value == (1 << (7 * length)) - 1:
            return None, at + length
    return value, at + length


def elements(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of the body of each element; one of unknown length reaches to the end."""
    while start < end:
        try:
            name, at = variable_number(data, start, True)
            size, at = variable_number(data, at, False)
        except ValueError:
            return
        stop = end if size is None else min(end, at + size)
        yield name, at, stop
        start = stop


@dataclass
class _Cue:
    time: int | None = None
    places: list[dict] = field(default_factory=list)


def matroska_cues(data: bytes) -> list[dict]:
    """A row for each position of each cue: seconds, track, cluster and the place in it (None if absent); cues without a time drop out."""
    _, parts = _level_one(data)
    cues = []
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    scale = next((number(x, y) for k, x, y in elements(data, *parts.get(INFO, (0, 0))) if k == SCALE), 0) or NANOSECONDS_OF_A_TICK
    for kind, x, y in elements(data, *parts.get(CUES, (0, 0))):
        if kind != CUE:
            continue
        cue = _Cue()
        for k, p, q in elements(data, x, y):
            if k == CUE_TIME:
                cue.time = number(p, q)
            elif k == POSITIONS:
                values = {m: number(r, s) for m, r, s in elements(data, p, q)}
                cue.places.append({"track": values.get(TRACK, 0), "cluster": values.get(CLUSTER, 0), "relative": values.get(RELATIVE)})
        if cue.time is not None:
            cues += [(cue.time, place) for place in cue.places]
    return [{"seconds": t * scale / 1e9, **place} for t, place in cues]


def float_number(data: bytes, start: int, end: int) -> float:
    """A number of 4 or 8 bytes in floating point; 0 for none. Raises ValueError for any other length."""
    if end - start not in (0, 4, 8):
        raise ValueError("no floating point number")
    return struct.unpack({0: "", 4: ">f", 8: ">d"}[end - start], data[start:end])[0] if end > start else 0.0


def _level_one(data: bytes) -> tuple[int, dict[int, tuple[int, int]]]:
    """Where the body of the segment begins, and the span of the first of each of its parts: those that its seek head names are looked up, others are met by walking."""
    for name, a, b in elements(data, 0, len(data)):
        if name != SEGMENT:
            continue
        parts: dict[int, tuple[int, int]] = {}
        for part, c, d in elements(data, a, b):
            if part == CLUSTER_BODY:
                break
            parts.setdefault(part, (c, d))
        for kind, c, d in elements(data, *parts.get(SEEK_HEAD, (0, 0))):
            if kind != SEEK:
                continue
            entry = {k: int.from_bytes(data[x:y], "big") for k, x, y in elements(data, c, d)}
            at = a + entry.get(SEEK_POSITION, len(data))
            found = next(elements(data, at, b), None) if at < b else None
            if found and found[0] == entry.get(SEEK_ID):
                parts.setdefault(found[0], found[1:])
        if not {INFO, TRACKS, CUES} <= parts.keys():  # the seek head does not say, so all of the segment is walked
            for part, c, d in elements(data, a, b):
                parts.setdefault(part, (c, d))
        return a, parts
    return 0, {}


def matroska_tracks(data: bytes) -> list[dict]:
    """Number, type (1 is video), codec and picture size of each track."""
    _, parts = _level_one(data)
    found = []
    for kind, a, b in elements(data, *parts.get(TRACKS, (0, 0))):
        if kind == TRACK_ENTRY:
            spans = {k: (x, y) for k, x, y in elements(data, a, b)}
            number = lambda k, spans=spans: int.from_bytes(data[slice(*spans.get(k, (0, 0)))], "big")
            picture = {k: int.from_bytes(data[x:y], "big") for k, x, y in elements(data, *spans.get(PICTURE, (0, 0)))}
            codec = data[slice(*spans.get(CODEC, (0, 0)))].rstrip(b"\0").decode("ascii", "replace")
            found.append({"number": number(TRACK_NUMBER), "kind": number(TRACK_KIND), "codec": codec, "width": picture.get(WIDTH, 0), "height": picture.get(HEIGHT, 0)})
    return found


def matroska_seconds(data: bytes) -> float:
    """The duration of the segment in seconds; 0 if it is not given."""
    _, parts = _level_one(data)
    info = {k: (x, y) for k, x, y in elements(data, *parts.get(INFO, (0, 0)))}
    scale = int.from_bytes(data[slice(*info.get(SCALE, (0, 0)))], "big") or NANOSECONDS_OF_A_TICK
    return float_number(data, *info.get(DURATION, (0, 0))) * scale / 1e9


def _block(data: bytes, start: int, end: int) -> tuple[int, int, int, int] | None:
    """Track, flags, and the bytes of the first picture of a block; None if it is cut off."""
    try:
        track, at = variable_number(data, start, False)
        flags, at = data[at + 2], at + 3
        lacing = flags & 0x06
        if not lacing:
            return track or 0, flags, at, end
        frames, at = data[at] + 1, at + 1
        if lacing == 0x04:  # all of one size
            return track or 0, flags, at, at + (end - at) // frames
        if lacing == 0x06:  # the first size, then differences
            size = end - at
            for i in range(frames - 1):
                value, at = variable_number(data, at, False)
                size = value or 0 if i == 0 else size
        else:  # sizes as sums of bytes up to one that is not full
            sizes = []
            for _ in range(frames - 1):
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + data[at])
                at += 1
            size = sizes[0] if sizes else end - at
        return (track or 0, flags, at, at + (size if frames > 1 else end - at)) if at < end else None
    except (ValueError, IndexError):
        return None


def _entry_block(data: bytes, kind: int, start: int, end: int, track: int) -> tuple[int, int] | None:
    """The bytes of the first picture of a block of ``track`` that can be entered: a simple block that says so, or a group that refers to no other."""
    if kind == SIMPLE_BLOCK:
        block = _block(data, start, end)
        return block[2:] if block and block[0] == track and block[1] & 0x80 else None
    if kind == BLOCK_GROUP:
        inside = {k: (x, y) for k, x, y in elements(data, start, end)}
        block = _block(data, *inside[BLOCK]) if BLOCK in inside and REFERENCE not in inside else None
        return block[2:] if block and block[0] == track else None
    return None


def matroska_keyframes(data: bytes) -> list[dict]:
    """Entry pictures of the first video track by its cues, in order of time: number from 1, seconds, offset and size of the bytes.

    A cue with a place in its cluster names the block; of one without, the first block
    of the track that can be entered counts, within :data:`CLUSTER_SCAN` bytes.  Cues
    that lead to no such block drop out.
    """
    video = min((t["number"] for t in matroska_tracks(data) if t["kind"] == 1), default=None)
    begin, _ = _level_one(data)
    found = []
    for cue in sorted((c for c in matroska_cues(data) if c["track"] in (0, video)), key=lambda c: c["seconds"]):
        head = next(elements(data, begin + cue["cluster"], len(data)), None)
        if video is None or head is None or head[0] != CLUSTER_BODY:
            continue
        _, start, stop = head
        first = start + (cue["relative"] or 0)
        near = elements(data, first, min(stop, first + CLUSTER_SCAN))
        blocks = (_entry_block(data, kind, a, b, video) for kind, a, b in ([next(near, (0, 0, 0))] if cue["relative"] is not None else near))
        place = next((b for b in blocks if b), None)
        if place and place[1] > place[0]:
            found.append({"number": len(found) + 1, "seconds": cue["seconds"], "offset": place[0], "size": place[1] - place[0]})
    return found


def _apply(read, schema: str, content: Column) -> Column:
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else read(bytes(b)))

    return F.pandas_udf(run, T.ArrayType(T.StructType.fromDDL(schema)))(content)


def keyframes(content: Column) -> Column:
    return _apply(mp4_keyframes, "number int, seconds double, offset bigint, size bigint", content)


def entry_pictures(content: Column) -> Column:
    """Entry pictures of an MP4 or a Matroska file, as its first bytes say; none of any other."""

    def read(data: bytes) -> list[dict]:
        return mp4_keyframes(data) if data[4:8] == b"ftyp" else matroska_keyframes(data) if data[:4] == EBML else []

    return _apply(read, "number int, seconds double, offset bigint, size bigint", content)


def tracks(content: Column) -> Column:
    return _apply(matroska_tracks, "number int, kind int, codec string, width int, height int", content)


def seconds(content: Column) -> Column:
    """The duration of a Matroska file; null for bytes that cannot be read."""

    def read(data: bytes) -> list[dict]:
        try:
            return [{"seconds": matroska_seconds(data)}]
        except ValueError:
            return []

    return F.get(_apply(read, "seconds double", content), F.lit(0))["seconds"]


def cue_points(content: Column) -> Column:
    return _apply(matroska_cues, "seconds double, track bigint, cluster bigint, relative bigint", content)


def sound_index(index: DataFrame, size: str) -> DataFrame:
    """Indexes whose every picture lies inside the file."""
    inside = F.forall("keyframes", lambda k: (k["offset"] >= 0) & (k["size"] > 0) & (k["offset"] + k["size"] <= F.col(size)))
    return index.filter((F.size("keyframes") > 0) & inside)


def probed(probe: Column) -> Column:
    """Duration, size, codec and pixel format from a prober's JSON; the first video stream counts."""
    parsed = F.from_json(probe, "format struct<duration:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,pix_fmt:string>>")
    video = F.get(F.filter(parsed["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return F.struct(parsed["format"]["duration"].try_cast("double").alias("duration"), video["width"].alias("width"), video["height"].alias("height"), video["codec_name"].alias("codec"), video["pix_fmt"].alias("pix_fmt"))
