"""Small container files for the queries that read containers."""

from __future__ import annotations

import struct


def box(kind: str, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", 8 + len(data), kind.encode()) + data


def table_box(kind: str, *numbers: int) -> bytes:
    return box(kind, b"\0" * 4, struct.pack(f">{len(numbers)}I", *numbers))


def mp4(sync: tuple[int, ...] | None) -> bytes:
    """Four pictures of 40, 30, 20 and 10 bytes, the first three together at 600 and one at 9000, a second and a half apart; ``sync`` are those that can be entered."""
    table = box(
        "stbl", table_box("stts", 1, 4, 150), table_box("stsz", 0, 4, 40, 30, 20, 10), table_box("stsc", 2, 1, 3, 1, 2, 1, 1), table_box("stco", 2, 600, 9000), *([table_box("stss", len(sync), *sync)] if sync else [])
    )
    media = box("mdia", box("mdhd", b"\0" * 12, struct.pack(">II", 100, 600)), box("hdlr", b"\0" * 8, b"vide", b"\0" * 12), box("minf", table))
    return box("ftyp", b"isom") + box("moov", box("trak", media))


def element(name: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + bytes([0x40 | len(data) >> 8, len(data) & 255]) + data


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def simple_block(track: int, key: bool, payload: bytes, lacing: int = 0) -> bytes:
    return element(0xA3, bytes([0x80 | track, 0, 0, (0x80 if key else 0) | lacing]), payload)


def matroska(seek: bool) -> bytes:
    """A sound and a picture track, and two clusters; cues come last, and a seek head leads to them if asked for.

    The first cluster has a block of each track and a laced one that can be entered; its
    cue has no place in it.  The second has a group that can be entered, at the place its cue names.
    """
    info = element(0x1549A966, number(0x2AD7B1, 1_000_000), element(0x4489, struct.pack(">d", 7500.0)))
    sound = element(0xAE, number(0xD7, 1), number(0x83, 2), element(0x86, b"A_AAC"))
    picture = element(0xAE, number(0xD7, 2), number(0x83, 1), element(0x86, b"V_TEST"), element(0xE0, number(0xB0, 640), number(0xBA, 360)))
    tracks = element(0x1654AE6B, sound, picture)
    laced = bytes([1, 5]) + b"ABCDE" + b"fghi"  # two frames, the first of five bytes
    first = element(0x1F43B675, number(0xE7, 0), simple_block(1, True, b"sound"), simple_block(2, False, b"later"), simple_block(2, True, laced, 0x02))
    before = number(0xE7, 5000)
    group = element(0xA0, element(0xA1, bytes([0x82, 0, 0, 0]), b"picture"))
    second = element(0x1F43B675, before, group)
    space = 26 if seek else 0  # what the seek head takes
    at = space + len(info) + len(tracks)

    def cue(time: int, cluster: int, relative: int | None) -> bytes:
        places = [number(0xF7, 2), number(0xF1, cluster), *([] if relative is None else [number(0xF0, relative)])]
        return element(0xBB, number(0xB3, time), element(0xB7, *places))

    cues = element(0x1C53BB6B, cue(0, at, None), cue(5000, at + len(first), len(before)))
    entry = element(0x4DBB, element(0x53AB, (0x1C53BB6B).to_bytes(4, "big")), element(0x53AC, (at + len(first) + len(second)).to_bytes(4, "big")))
    head = element(0x114D9B74, entry) if seek else b""
    assert len(head) == space
    return element(0x1A45DFA3, b"") + element(0x18538067, head, info, tracks, first, second, cues)
