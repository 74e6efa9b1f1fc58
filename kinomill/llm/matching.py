"""Matching records to catalogue entries without a common key.

Names of entries and records are brought into comparable forms, and each is laid under
several composite sort keys: year or running time, followed by the name or by its most
telling word, each forwards and backwards.  All keys are sorted together, and equal
keys by the rest of the name.  A window slides over the sorted rows: the name of a
record meets the :data:`WINDOW` different names of entries on either side whose keys
begin alike, and wherever they stand those that are equal to it.  Entries of one name
take one place in a window, however many they are.  What
met is sieved at once by measures that travel with the sort keys (:func:`sieve`): number in
a series, lengths, and which letters a name holds, which a few slips change by a few bits.
Names that pass are compared once.
Of a name that is near enough, the entries are looked up by year and running time,
exactly and without a window: each year and running time that the record allows is one
key, and the entries that agree in all of that are represented by the smallest, which
wins their tie.  Weighted similarities of name, year and running time give a
confidence; years or running times that contradict rule a pair out.  Last, every record
gets the entry of highest confidence.  That is the
assignment of greatest total confidence in which a record has at most one entry and an
entry any number of records: in this data an entry is described by several records, so
an assignment that is one-to-one on both sides would lose true matches.

Records that agree in all that is compared are matched once, however many they are.
The window runs over range partitions, of which a task holds :data:`SLIDE_ROWS` rows at a
time; what lies around a partition's ends (at most :data:`WINDOW` names each) is handed to
its neighbours, so no window is cut.

Defined cases:

* a record without any name, or with one of no letters and digits, has no row;
* a missing year or running time neither supports nor contradicts;
* ties of confidence go to the smaller entry key;
* records and entries that come several times count once;
* names of any length are compared whole; sort keys use their first letters;
* columns of the input other than those named are ignored, whatever their names;
* empty tables give an empty result.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinomill.lineage import cut

WINDOW = 12
#: Letters of the name in a sort key, and behind it, where only the order counts; bytes that two keys must share beyond year or running time, and where there is neither.
KEY_LETTERS, TAIL_LETTERS, ALIKE, ALIKE_ALONE = 16, 16, 3, 5
NAME_WEIGHT, YEAR_WEIGHT, TIME_WEIGHT = 0.7, 0.15, 0.15
#: Slips in a name that are put up with: one, one more for each of year and running time that agree, and never more than a share of its letters.
SLIPS, SLIPS_SHARE = 1, 0.34
YEARS_APART, SECONDS_APART = 1, 120
#: Words in more than this share of names are not telling. All of them are told to all tasks: they are at most the words of a name, on average, divided by the share.
COMMON_SHARE, COMMON_LEAST = 5e-4, 20
#: Rows that a window slides over at once.
SLIDE_ROWS = 500_000
#: What travels with a sort key for the sieve.
BITS = ("whole_bits", "telling_bits")
CARRIED = {"number": "int", "long": "int", "told": "int", "whole_bits": "long", "telling_bits": "long"}
#: In a sort key, in place of a year or running time that is missing.
NO_LEAD = "zzz"
#: In place of a year or running time: that of all entries, and that of entries without one.
ANY, NONE = -(2**31), -(2**31) + 1

#: What releases add to a name, words that carry little, letters that no decomposition takes apart, Roman numerals.
TAGS = "480p 576p 720p 1080p 1440p 2160p 4320p 4k 8k uhd hd sd hdrip dvdrip bdrip brrip webrip web webdl bluray remux hdtv x264 x265 h264 h265 hevc avc av1 xvid remastered".split()
LITTLE = "a an the of in for from to and le la les l un une de des du d der die das den dem ein eine von el los las una y et und".split()
LETTERS = {"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
NUMERALS = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_CASE = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ]|II|IV|[A-ZÀ-Þ]$|\d)")
_ASIDE = re.compile(r"[\[(][^\[\]()]*[\])]")
_EXTENSION = re.compile(r"\.(?:mkv|mp4|avi|mov|ts|m4v|wmv|flv|webm|mpg|mpeg)\s*$", re.IGNORECASE)


def plain(text: str) -> str:
    """Lower case, without accents."""
    text = unicodedata.normalize("NFKD", text).casefold()
    if not text.isascii():
        text = "".join(LETTERS.get(c, c) for c in text if not unicodedata.combining(c))
    return text


@functools.lru_cache(maxsize=100_000)
def name_forms(text: str | None) -> tuple[str, str, int, list[str]]:
    """The name in one piece, its telling words sorted and in one piece, its number in a series (1 if none), and its words."""
    words = re.findall(r"[^\W_]+", plain(_CASE.sub(" ", _ASIDE.sub(" ", text or "").replace("_", " "))))
    for i, w in enumerate(words[1:], 1):
        if w in TAGS:
            words = words[:i]
            break
    number = 1
    core = [w for w in words if w not in LITTLE] or words
    if len(core) > 1 and (core[-1] in NUMERALS or re.fullmatch(r"[1-9]\d?", core[-1])):
        number = NUMERALS.get(core[-1]) or int(core[-1])
        last = len(words) - 1 - words[::-1].index(core[-1])
        words = words[:last] + words[last + 1 :]
        core = core[:-1]
        if len(core) > 1 and core[-1] == "part":
            words.remove("part")
            core = core[:-1]
    elif core and (tail := re.fullmatch(r"(.*\D)([2-9])", core[-1])):
        number = int(tail[2])
        words = [tail[1] if w == core[-1] else w for w in words]
        core[-1] = tail[1]
    return "".join(words), "".join(sorted(core)), number, core


def _letters(names: Sequence[str], width: int) -> np.ndarray:
    return np.array(names, f"U{max(width, 1)}").view(np.uint32).reshape(len(names), -1)


def slips(left: Sequence[str], right: Sequence[str], most: int) -> np.ndarray:
    """For each pair, letters to insert, delete, replace or swap with their neighbour to turn one into the other; ``most + 1`` if more than ``most``.

    All pairs go through a band of the table of distances together, letter by letter.
    """
    over = most + 1
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    out = np.full(len(n), over, np.int64)
    live = np.flatnonzero(np.abs(n - m) <= most)
    if not len(live):
        return out
    left, right, n, m = [left[i] for i in live], [right[i] for i in live], n[live], m[live]
    rows = np.arange(len(live))
    a, b = _letters(left, int(n.max())), _letters(right, int(m.max()))
    wide = 2 * most + 1  # place k of row i is column i + k - most
    b = np.pad(b, ((0, 0), (over, a.shape[1] + over)))  # letter j of the right name, from 1, is at j + most
    columns = np.arange(wide) - most
    older = np.full((len(live), wide + 1), over)
    old = np.full((len(live), wide + 1), over)
    old[:, most:wide] = np.arange(wide - most)
    old[:, :wide][columns > m[:, None]] = over
    result = np.where(n == 0, np.minimum(m, over), over)
    for i in range(1, a.shape[1] + 1):
        x = a[:, i - 1, None]
        here, before = b[:, i : i + wide], b[:, i - 1 : i - 1 + wide]
        new = np.full((len(live), wide + 1), over)
        inside = (columns + i > 0) & (columns + i <= m[:, None])
        best = np.minimum(old[:, :wide] + (here != x), old[:, 1:] + 1)
        if i > 1:
            swapped = (x == before) & (a[:, i - 2, None] == here) & (columns + i > 1)
            best = np.where(swapped, np.minimum(best, older[:, :wide] + 1), best)
        best = np.where(inside, np.minimum(best, over), over)
        if i <= most:
            best[:, most - i] = i  # column 0
        for k in range(1, wide):
            best[:, k] = np.where(inside[:, k], np.minimum(best[:, k], best[:, k - 1] + 1), best[:, k])
        new[:, :wide] = best
        older, old = old, new
        ended = n == i
        result[ended] = np.minimum(best[rows[ended], (m - n)[ended] + most], over)
    out[live] = result
    return out


def _slips(a: Column, b: Column, most: int) -> Column:
    """:func:`slips` of two columns; the plain edit distance decides all but what could be a swap."""

    def count(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.full(len(left), np.nan)
        asked = np.flatnonzero(left.notna())
        one, other = left.iloc[asked].tolist(), right.iloc[asked].tolist()
        by_length = sorted(range(len(asked)), key=lambda i: len(one[i]))  # so that few are padded by much
        start = 0
        while start < len(asked):
            stop = start + 1
            while stop < min(len(asked), start + 2000) and (stop - start) * len(one[by_length[stop]]) < 1_000_000:
                stop += 1
            part = by_length[start:stop]
            out[asked[part]] = slips([one[i] for i in part], [other[i] for i in part], most)
            start = stop
        return pd.Series(out).astype("Int32")

    plain_distance = F.levenshtein(a, b, 2 * most)
    swapped = plain_distance >= 2
    counted = F.pandas_udf(count, T.IntegerType())(F.when(swapped, a), F.when(swapped, b))
    return F.when(plain_distance < 0, most + 1).when(swapped, counted).otherwise(plain_distance)


def letter_bits(name: str) -> int:
    """64 bits, two for each of 32 classes of letters: whether it is there, and whether it is there again. A slip changes at most two."""
    once = twice = 0
    for c in name:
        bit = 1 << (ord(c) & 31)
        twice |= once & bit
        once |= bit
    bits = once | twice << 32
    return bits - 2**64 if bits >= 2**63 else bits


def sieve(a: dict[str, np.ndarray], b: dict[str, np.ndarray], most: int) -> np.ndarray:
    """Which pairs of names could be within ``most`` slips, and within the share of their letters that is put up with; it drops no pair that is."""
    longer = np.maximum(a["told"], b["told"])
    slips_allowed = np.minimum(most, np.floor(SLIPS_SHARE * longer)).astype(np.int64)
    ok = np.zeros(len(longer), bool)
    for length, bits in (("long", "whole_bits"), ("told", "telling_bits")):
        near = np.abs(a[length].astype(np.int64) - b[length]) <= slips_allowed
        ok |= near & (np.bitwise_count(a[bits].view(np.uint64) ^ b[bits].view(np.uint64)) <= 2 * slips_allowed)
    return ok & (a["number"] == b["number"])


def file_title(name: str | None) -> str | None:
    """What a file name says of the title: without extension, a year in front, and all from a year or brackets on."""
    if not name:
        return None
    stem = re.sub(r"[\s_.]+", lambda m: m[0][:1], _EXTENSION.sub("", name))
    stem = re.sub(r"^\s*(?:\[[^\]]*\]\s*)?(?:(?:18|19|20)\d\d\s*-\s+)?", "", stem)
    return re.split(r"[\s._\-]*(?:[\[(].*|\b(?:18|19|20|21)\d\d(?=[\s._\-\])]|$).*)$", stem.replace("_", " ").replace(".", " "), maxsplit=1)[0] or stem


def _with_forms(df: DataFrame) -> DataFrame:
    """Adds ``whole``, ``telling``, ``number``, ``words`` and the letters that ``whole`` and ``telling`` hold to rows with ``name``."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64()]
        for batch in batches:
            found = [(*f, letter_bits(f[0]), letter_bits(f[1])) for f in map(name_forms, batch.column("name").to_pylist())]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "whole", "telling", "number", "words", *BITS])

    schema = ", ".join([*(f"`{n}` {k}" for n, k in df.dtypes), "whole string, telling string, number int, words array<string>, whole_bits long, telling_bits long"])
    return df.mapInArrow(forms, schema).filter("whole <> ''")


def _key(kind: int, lead: Column, text: Column, rest: Column) -> Column:
    key = F.concat(F.lit(chr(ord("A") + kind)), lead, F.substring(text, 1, KEY_LETTERS))
    return F.struct(key.alias("key"), F.substring(rest, 1, TAIL_LETTERS).alias("tail"))


def _keys(leads: list[tuple[int, Column]]) -> Column:
    """An array of sort keys: every lead with the name and with its most telling word, forwards and backwards, and what orders equal keys."""
    joined, word = F.col("joined"), F.col("word")
    texts = [(t, F.substring(t, KEY_LETTERS + 1, TAIL_LETTERS)) for t in (joined, F.reverse(joined))] + [(word, joined), (F.reverse(word), F.reverse(joined))]
    return F.array(*(_key(4 * kind + i, lead, text, rest) for kind, lead in leads for i, (text, rest) in enumerate(texts)))


def _ready(df: DataFrame, common: list[str]) -> DataFrame:
    """Adds ``joined``, the words in one piece, and ``word``, the longest of those that are not common."""
    rare = F.filter("words", lambda w: ~w.isin(common)) if common else F.col("words")
    by_length = F.array_sort(F.transform(F.when(F.size(rare) > 0, rare).otherwise(F.col("words")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return df.withColumn("joined", F.array_join("words", "")).withColumn("word", F.get(by_length, F.lit(0))["w"])


def _lead(value: Column) -> Column:
    """Three signs, so that the eight bytes that a sort compares first reach into the name."""
    return F.coalesce(F.lpad(F.conv(value.cast("string"), 10, 36), 3, "0"), F.lit(NO_LEAD))


#: Bytes of a sort key before the name, and of all of it at most.
LEAD_BYTES = 4
KEY_BYTES = LEAD_BYTES + 4 * KEY_LETTERS


class Slide:
    """A window that slides over sorted rows, some at a time; each column is an array."""

    def __init__(self, rows_at_once: int) -> None:
        self.rows_at_once = rows_at_once
        self.waiting: list[dict[str, np.ndarray]] = []
        self.size = 0

    def add(self, rows: dict[str, np.ndarray]) -> None:
        self.waiting.append(rows)
        self.size += len(rows["id"])

    def full(self) -> bool:
        return self.size >= self.rows_at_once

    def pairs(self, last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(records, entries) that meet among what was added; what may still meet later rows is kept unless these are the ``last``."""
        rows = {name: np.concatenate([w[name] for w in self.waiting]) for name in self.waiting[0]}
        entries, records = np.flatnonzero(rows["kind"] == 0), np.flatnonzero(rows["kind"] == 1)
        place = np.searchsorted(entries, records)
        self.waiting, self.size = [], 0
        if not last:  # a record whose window reaches beyond the last entry waits, with the entries before it
            ready = int(np.searchsorted(place, len(entries) - WINDOW, "right"))
            first = int(place[ready]) if ready < len(place) else len(entries)
            start = int(entries[max(0, first - WINDOW)]) if len(entries) else 0
            keep = np.arange(len(rows["id"])) >= start
            keep[records[:ready]] = False
            keep[records[ready:]] = True
            self.add({name: column[keep] for name, column in rows.items()})
            records, place = records[:ready], place[:ready]
        letters = rows["key"].view(np.uint8).reshape(-1, KEY_BYTES)
        undated = rows["key"].astype(f"S{LEAD_BYTES}").view(np.uint8).reshape(-1, LEAD_BYTES)[:, -1] == ord(NO_LEAD[-1])
        for offset in range(-WINDOW, WINDOW):
            to = place + offset
            ok = np.flatnonzero((to >= 0) & (to < len(entries)))
            for part in np.array_split(ok, max(1, len(ok) // 100_000)):
                own, other = records[part], entries[to[part]]
                near = sieve({c: rows[c][own] for c in CARRIED}, {c: rows[c][other] for c in CARRIED}, SLIPS + 2)
                own, other = own[near], other[near]
                need = LEAD_BYTES + np.where(undated[own], ALIKE_ALONE, ALIKE)
                a, b = letters[own], letters[other]
                same = np.minimum.accumulate((a == b) & (a > 0), axis=1).sum(1)
                # words shorter than the required start must be equal
                alike = (same >= need) | ((a == b).all(1))
                if alike.any():
                    yield rows["id"][own[alike]], rows["id"][other[alike]]


def _arrays(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    keys = np.array([k.encode() for k in batch.column("key").to_pylist()], f"S{KEY_BYTES}")
    return {"key": keys} | {name: batch.column(name).to_numpy() for name in ("kind", "id", *CARRIED)}


def _slide(rows: DataFrame) -> DataFrame:
    """``(record, entry)``: pairs that meet in a window over the different ``rows`` of ``key``, ``tail``, ``kind`` (0 entry, 1 record), ``id`` and what is carried."""
    spark = rows.sparkSession
    order = ["key", "tail", "kind", "id"]
    ordered = cut(rows.select(*order, *CARRIED).repartitionByRange(*order).distinct().sortWithinPartitions(*order).drop("tail"))
    fields = dict(ordered.dtypes)
    edge_schema = ", ".join(["at int", "end int", "n int", *(f"{name} {kind}" for name, kind in fields.items())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[dict] = []
        last: list[dict] = []
        for batch in batches:
            batch = batch.filter(pa.compute.equal(batch.column("kind"), 0))
            if len(first) < WINDOW:
                first += batch.slice(0, WINDOW - len(first)).to_pylist()
            last = (last + batch.slice(max(0, batch.num_rows - WINDOW)).to_pylist())[-WINDOW:]
            schema = batch.schema
        at = TaskContext.get().partitionId()
        out = [{"at": at, "end": end, "n": n, **row} for end, of_end in enumerate((first, last)) for n, row in enumerate(of_end)]
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([*((name, pa.int32()) for name in ("at", "end", "n")), *schema]))

    first: dict[int, list] = {}
    last: dict[int, list] = {}
    for r in ordered.mapInArrow(ends, edge_schema).collect():  # at most 2 * WINDOW rows of a partition
        (last if r["end"] else first).setdefault(r["at"], []).append((r["n"], {name: r[name] for name in fields}))
    in_order = lambda found: [row for _, row in sorted(found, key=lambda x: x[0])]
    parts = ordered.rdd.getNumPartitions()
    before: dict[int, list] = {}
    after: dict[int, list] = {}
    carried: list = []
    for p in range(parts):
        before[p] = carried
        carried = (carried + in_order(last.get(p, [])))[-WINDOW:]
    carried = []
    for p in reversed(range(parts)):
        after[p] = carried
        carried = (in_order(first.get(p, [])) + carried)[:WINDOW]
    around = spark.sparkContext.broadcast((before, after))  # at most 2 * WINDOW rows of a partition
    at_once = SLIDE_ROWS

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        head, tail = (rows[at] for rows in around.value)
        slide = Slide(at_once)
        pairs = lambda last: (pa.RecordBatch.from_arrays([pa.array(r), pa.array(e)], names=["record", "entry"]) for r, e in slide.pairs(last))
        schema = None
        for batch in batches:
            if schema is None and head:
                slide.add(_arrays(pa.RecordBatch.from_pylist(head, batch.schema)))
            schema = batch.schema
            slide.add(_arrays(batch))
            if slide.full():
                yield from pairs(False)
        if schema is not None:
            if tail:
                slide.add(_arrays(pa.RecordBatch.from_pylist(tail, schema)))
            yield from pairs(True)

    return ordered.mapInArrow(meet, "record long, entry long").distinct()


def _names(df: DataFrame, id_name: str) -> DataFrame:
    """Each different form of a name once."""
    return df.dropDuplicates(["form"]).select(F.col("form").alias(id_name), "whole", "telling", "number")


def _entries_by_time(entries: DataFrame) -> DataFrame:
    """``(entry_form, at_year, at_minute, entry)``: the smallest entry of a name for each year, also :data:`ANY` and :data:`NONE`, with each running time."""
    of = lambda name: F.explode(F.array(F.coalesce(name, F.lit(NONE)), F.lit(ANY)))
    rows = entries.select(F.col("form").alias("entry_form"), "entry", "minutes", of("year").alias("at_year"))
    return rows.withColumn("at_minute", of("minutes")).groupBy("entry_form", "at_year", "at_minute").agg(F.min("entry").alias("entry"))


def match_records(entries: DataFrame, records: DataFrame) -> DataFrame:
    """``(key, entry, confidence)``: the entry that each record describes.

    ``entries`` has a row for each name of an entry: ``entry``, ``name``, ``year``, ``minutes``.
    ``records`` has ``key``, ``names`` (an array), ``year``, ``seconds``.
    """
    form = F.xxhash64("whole", "telling", "number", "words")
    entries = entries.filter("name IS NOT NULL AND entry IS NOT NULL").groupBy("entry", "name").agg(F.min("year").alias("year"), F.min("minutes").alias("minutes"))
    entries = cut(_with_forms(entries).withColumn("form", form))
    described = F.xxhash64("names", "year", "seconds")
    records = cut(records.filter("key IS NOT NULL").dropDuplicates(["key"]).withColumn("description", described))
    distinct = records.groupBy("description").agg(F.first("names").alias("names"), F.first("year").alias("year"), F.first("seconds").alias("seconds"))
    spoken = distinct.select("description", "year", "seconds", F.explode(F.array_distinct(F.filter("names", lambda n: n.isNotNull()))).alias("name"))
    spoken = cut(_with_forms(spoken).withColumn("form", form).withColumn("minute", F.floor(F.col("seconds") / 60).cast("int")))

    total = entries.count()
    often = entries.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count().filter(F.col("count") >= max(COMMON_LEAST, total * COMMON_SHARE))
    common = [r["word"] for r in often.orderBy("word").collect()]

    carried = [F.col("number"), F.length("whole").alias("long"), F.length("telling").alias("told"), F.col("whole_bits"), F.col("telling_bits")]
    left = _ready(entries.select("form", "words", "year", "minutes", *carried).distinct(), common)
    left = left.select(F.col("form").alias("id"), *CARRIED, F.inline(_keys([(0, _lead(F.col("year"))), (1, _lead(F.col("minutes"))), (2, F.lit(NO_LEAD))])))
    year, minute = F.col("year"), F.col("minute")
    none = F.lit(None).cast("int")
    dated = _keys([(0, _lead(year + d)) for d in range(-YEARS_APART, YEARS_APART + 1)] + [(0, _lead(none))])
    timed = _keys([(1, _lead(minute + d)) for d in (-1, 0, 1, 2)] + [(1, _lead(none))])
    keys = F.when(year.isNotNull(), dated).when(minute.isNotNull(), timed).otherwise(_keys([(2, F.lit(NO_LEAD))]))
    led = spoken.select("form", "words", "year", F.when(year.isNull(), minute).alias("minute"), *carried).distinct()
    right = _ready(led, common).select(F.col("form").alias("id"), *CARRIED, F.inline(keys))
    rows = left.withColumn("kind", F.lit(0)).unionByName(right.withColumn("kind", F.lit(1)))

    e = _names(entries, "entry_form").withColumnsRenamed({c: f"e_{c}" for c in ("whole", "telling", "number")})
    r = _names(spoken, "record_form")
    pairs = _slide(rows).select(F.col("record").alias("record_form"), F.col("entry").alias("entry_form"))
    for name in ("whole", "telling"):
        same = r.join(e, (F.col(name) == F.col(f"e_{name}")) & (F.col("number") == F.col("e_number")))
        pairs = pairs.unionAll(same.select("record_form", "entry_form"))
    met = pairs.distinct().join(e, "entry_form").join(r, "record_form").filter(F.col("number") == F.col("e_number"))

    # far names go before any of them reaches Python
    most = 2 * (SLIPS + 2)
    met = met.filter((F.levenshtein(F.col("whole"), F.col("e_whole"), most) >= 0) | (F.levenshtein(F.col("telling"), F.col("e_telling"), most) >= 0))
    met = met.withColumn("slips", F.least(_slips(F.col("whole"), F.col("e_whole"), SLIPS + 2), _slips(F.col("telling"), F.col("e_telling"), SLIPS + 2)))
    longer = F.greatest(F.length("telling"), F.length("e_telling"))
    met = met.select("record_form", "entry_form", "slips", longer.alias("longer")).filter((F.col("slips") <= SLIPS + 2) & (F.col("slips") <= SLIPS_SHARE * F.col("longer")))

    years = F.when(year.isNull(), F.array(F.lit(ANY))).otherwise(F.array(*(year + d for d in range(-YEARS_APART, YEARS_APART + 1)), F.lit(NONE)))
    minutes = F.when(minute.isNull(), F.array(F.lit(ANY))).otherwise(F.array(*(minute + d for d in (-1, 0, 1, 2)), F.lit(NONE)))
    asked = spoken.select(F.col("form").alias("record_form"), "description", "year", "seconds", "minute").join(met, "record_form")
    asked = asked.withColumn("at_year", F.explode(years)).withColumn("at_minute", F.explode(minutes))
    found = asked.join(_entries_by_time(entries), ["entry_form", "at_year", "at_minute"])

    apart = F.when(F.col("at_year") > NONE, F.abs(F.col("year") - F.col("at_year")))
    off = F.when(F.col("at_minute") > NONE, F.abs(F.col("seconds") - F.col("at_minute") * 60))
    allowed = F.lit(SLIPS) + apart.isNotNull().cast("int") + off.isNotNull().cast("int")
    found = found.filter((apart.isNull() | (apart <= YEARS_APART)) & (off.isNull() | (off < SECONDS_APART)) & (F.col("slips") <= allowed))
    confidence = (
        NAME_WEIGHT * (1 - F.col("slips") / F.col("longer"))
        + YEAR_WEIGHT * F.when(apart.isNull(), 0.6).otherwise(1 - 0.3 * apart)
        + TIME_WEIGHT * F.when(off.isNull(), 0.6).otherwise(1 - 0.2 * off / SECONDS_APART)
    )
    scored = found.select("description", "entry", F.round(confidence, 6).alias("confidence"))
    best = scored.groupBy("description").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "entry")).alias("best"))
    return records.join(best, "description").select("key", "best.entry", (-F.col("best.less")).alias("confidence"))
