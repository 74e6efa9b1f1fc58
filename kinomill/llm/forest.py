"""Checking new batches against everything accepted so far, with a persisted hash forest.

A content is a 256-bit signature.  The forest keeps several permutations of every
distinct signature (rotations, each led by another of its blocks of digits) as sorted
runs in the shared folder.  A batch is located by prefix: all entries whose
permutation begins with the same digits are one range of a sorted run.  The prefix is
widened until the estimated recall reaches the target; at the width of a block the
recall is 1, since two signatures that differ in at most ``radius`` bits agree in one
of ``radius + 1`` blocks.  An entry holds its place (permutation and prefix), the next
64 bits of the permutation and the id of its content.  What a range holds is sieved by
these bits, and what is left is verified on the whole signatures in the ledger.

A run is sorted by place and its ledger by id.  Where a batch asks for little, its
places and ids are merged into a few ranges, and only the pages of the files that these
ranges hit are read (Parquet's statistics of row groups and pages); so what is read
follows the batch and not the history.  Each batch adds a run; four runs of a level are
merged into one of the next, which is laid out again from their ledgers.

The ledger holds, for every distinct content, the first record of it and the first
record of the same content within the radius.  A content that comes again is answered
by the ledger alone, so that copies are compared once however many there are.

A manifest in the folder names the runs.  It is replaced after all files of a batch are
written, so a forest that is opened again (:meth:`HashForest.open`) stands as after the
last whole batch, and what a broken batch left behind is not read.

Crowded ranges: an entry range holds the first :data:`SLOTS` entries in order of coming;
the rest of a crowded range is kept apart under a second prefix over the remaining
digits, and is searched only where it could still hold one that comes before the best
found so far, which again loses nothing.

Defined cases:

* a content that cannot be read as a signature or a remote id is unusable: it is never
  found and never kept;
* a record that comes several times counts once by its key;
* ties do not exist: the order of coming is total;
* columns of the input other than those named are ignored, whatever their names;
* an empty batch finds nothing and adds nothing; an empty history is an empty forest.
"""

from __future__ import annotations

import json
import math
import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinomill.lineage import list_path, read_text, remove_path, scratch_path, write_text

DIGITS, BITS, RADIUS = 64, 256, 12
SLOTS = 64
RUNS_OF_A_LEVEL = 4
#: Contents of a batch that are broadcast (13 entries of 20 bytes each), and pairs that are, at most; larger ones are joined by shuffle.
BROADCAST, BROADCAST_PAIRS = 20_000, 200_000
#: Values that are collected to find the ranges asked, the ranges they are merged into, and the share of all values above which ranges are not worth while.
ASKED, RANGES, SPARSE = 20_000, 64, 0.25
#: Rows of a page of a run, so that ranges hit little else.
PAGE_ROWS = 2000
WORDS = ("w0", "w1", "w2", "w3")


def canonical(written: Column) -> Column:
    """The 64 digits of a signature, or a remote id; null for anything else.

    White space around it, case, separators between digits and a tag in front (``0x``,
    or a word that ends with a colon or an equals sign) do not count.
    """
    text = F.lower(F.regexp_replace(written, r"(?U)^\s+|(?<!\s)\s+$", ""))

    def digits(x: Column) -> Column:
        return F.regexp_replace(x, r"(?U)[\s:._-]", "")

    plain, untagged = digits(text), digits(F.regexp_replace(text, r"(?U)^(?:[a-z][a-z0-9]*\s*[:=]\s*)?(?:0x)?", ""))
    whole = rf"\A[0-9a-f]{{{DIGITS}}}\z"
    return F.when(text.startswith("remote:"), text).when(plain.rlike(whole), plain).when(untagged.rlike(whole), untagged)


def blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """Start and length of ``radius + 1`` blocks of digits."""
    edges = [DIGITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def estimated_recall(width: int, radius: int = RADIUS) -> float:
    """Of pairs that differ in ``radius`` bits, the share that some permutation brings together under prefixes of ``width`` digits."""
    if width <= min(n for _, n in blocks(radius)):
        return 1.0
    alone = math.comb(BITS - 4 * width, radius) / math.comb(BITS, radius)
    return 1 - (1 - alone) ** (radius + 1)


def prefix_widths(recall: float = 1.0, radius: int = RADIUS) -> list[int]:
    """Digits of the prefix for each permutation: widened from 16 digits until the recall target is met, to a block at most."""
    width = 16
    while width > 1 and estimated_recall(width, radius) < recall:
        width -= 1
    return [max(width, n) if recall < 1 else n for _, n in blocks(radius)]


def _words(signature: Column) -> list[Column]:
    return [F.conv(F.substring(signature, 1 + 16 * i, 16), 16, -10).cast("long").alias(w) for i, w in enumerate(WORDS)]


def _described(contents: DataFrame) -> DataFrame:
    """Adds to ``content`` its ``id``, a hash that different contents may share, and the content as four words or, of a remote id, as ``remote``."""
    remote = F.col("content").startswith("remote:")
    return contents.select("*", F.xxhash64("content").alias("id"), *_words(F.when(~remote, F.col("content"))), F.when(remote, F.col("content")).alias("remote"))


def _digits() -> Column:
    """A signature's digits from its words."""
    return F.concat(*(F.lpad(F.lower(F.hex(w)), 16, "0") for w in WORDS))


def _entries(contents: DataFrame, widths: Sequence[int], *keep: str) -> DataFrame:
    """A row for each permutation of the signatures among ``contents``: ``at``, the number of its permutation and prefix, ``bits``, the 64 that follow, ``id``, ``left``, the digits after the prefix, and ``keep``."""
    rows = contents.filter("remote IS NULL").select("id", *keep, _digits().alias("digits"))
    turned = [
        F.struct(F.lit(p).alias("perm"), F.lit(width).alias("width"), F.concat(F.expr(f"substr(digits, {start + 1})"), F.substring("digits", 1, start)).alias("turned"))
        for p, ((start, _), width) in enumerate(zip(blocks(), widths, strict=True))
    ]
    rows = rows.select("id", *keep, F.inline(F.array(*turned)))
    wide = max(widths)
    prefix = F.conv(F.rpad(F.expr("substr(turned, 1, width)"), wide, "0"), 16, 10).cast("long")
    at = F.col("perm").cast("long") * 16**wide + prefix
    bits = F.conv(F.expr("substr(turned, width + 1, 16)"), 16, -10).cast("long")
    return rows.select(at.alias("at"), bits.alias("bits"), "id", *keep, F.expr("substr(turned, width + 1)").alias("left"))


def _second(entries: DataFrame) -> DataFrame:
    """A row for each of ``radius + 1`` parts of the digits that are left, under a number of place and part."""
    edge = lambda i: (F.length("left") * i / (RADIUS + 1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(RADIUS)), lambda i: F.struct(i.alias("part"), F.substring("left", edge(i) + 1, edge(i + 1) - edge(i)).alias("digits")))
    rows = entries.select("*", F.inline(parts))
    return rows.select(*(c for c in entries.columns if c != "left"), F.xxhash64("at", "part", "digits").alias("place"))


def _within(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in WORDS)) <= RADIUS


def ranges_of(values: Sequence[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all of the sorted ``values``, parted where the gaps are widest."""
    if not values:
        return []
    gaps = sorted(range(1, len(values)), key=lambda i: values[i - 1] - values[i])[: most - 1]
    starts = [0, *sorted(gaps)]
    return [(values[a], values[b - 1]) for a, b in zip(starts, [*starts[1:], len(values)], strict=True)]


def _in_ranges(column: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    parts = [column.between(a, b) for a, b in ranges]
    while len(parts) > 1:  # a flat tree
        parts = [reduce(lambda x, y: x | y, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def _sorted(rows: DataFrame, column: str, count: int | None = None) -> DataFrame:
    """In order of ``column``; in one file where it is known that they are few."""
    few = count is not None and count <= BROADCAST
    return (rows.repartition(1) if few else rows.repartitionByRange(column)).sortWithinPartitions(column)


def _with_best(rows: DataFrame, best: DataFrame | None, new: int) -> DataFrame:
    """Adds ``best`` to ``rows`` of at most ``new`` contents, null where there is none."""
    if best is None:
        return rows.withColumn("best", F.lit(None).cast(rows.schema["first"].dataType))
    return rows.join(F.broadcast(best) if new <= BROADCAST else best, ["id", *WORDS], "left")


def _contents(runs: Sequence[dict]) -> int:
    return sum(r["contents"] for r in runs)


class HashForest:
    """A forest in the folder ``path``; ``runs`` are its runs as the manifest names them: ``level``, number of ``contents``, ``entries``, ``rest`` (or none) and ``ledger``, names of folders."""

    def __init__(self, spark: SparkSession, path: str | None = None, recall: float = 1.0) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "forest")
        self.widths = prefix_widths(recall)
        self.runs: list[dict] = []
        self.schemas: dict[str, dict] = {}
        self.written = 0
        self._naming = threading.Lock()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HashForest:
        """The forest as it stood after the last batch that was accepted whole; an empty one if there is none in ``path``."""
        forest = cls(spark, path)
        manifests = sorted(n for n in list_path(spark, path) if n.startswith("manifest-"))
        if manifests:
            stored = json.loads(read_text(spark, f"{path}/{manifests[-1]}"))
            forest.widths, forest.runs, forest.schemas, forest.written = stored["widths"], stored["runs"], stored["schemas"], stored["written"]
        return forest

    def accept(self, batch: DataFrame, level: int = 0) -> None:
        """Adds ``batch``: ``key``, ``content`` in canonical form, and ``record``, a struct that orders all records by their coming."""
        batch = batch.filter("content IS NOT NULL").groupBy("key").agg(F.min_by("content", "record").alias("content"), F.min("record").alias("record"))
        contents = _described(batch.groupBy("content").agg(F.min("record").alias("first"))).drop("content")
        before, scratch = list(self.runs), []
        arrived, count = self._keep(contents, scratch)
        fresh, new = arrived, count
        if self.runs and count:
            known = self._sparse(self._ledger(*before), _contents(before), "id", arrived.select("id"), count)
            asked = arrived.select("id", *WORDS, "remote")
            asked = F.broadcast(asked) if count <= BROADCAST else asked
            same = lambda l, r: reduce(lambda x, y: x & y, (l[c].eqNullSafe(r[c]) for c in (*WORDS, "remote")), l["id"] == r["id"])
            known = known.select("id", *WORDS, "remote")
            known = known.join(asked, same(known, asked), "left_semi")
            fresh, new = self._keep(arrived.join(F.broadcast(known) if count <= BROADCAST else known, same(arrived, known), "left_anti"), scratch)
        if new:
            # the new run is written while older ones and the batch itself are searched
            with ThreadPoolExecutor(1) as beside:
                entries = beside.submit(self._write_entries, fresh, new)
                best = self._search(fresh, new, before, scratch)
            run = {"level": level, "contents": new, **entries.result()}
            best = self._search_rest(fresh, new, best, [*before, run], scratch)
            ledger = _with_best(fresh, best, new).withColumn("earliest", F.least("first", F.coalesce("best", "first"))).drop("best")
            run["ledger"] = self._write(_sorted(ledger, "id", new), "ledger")
            self.runs.append(run)
            stale = self._merge(level)
            self._commit()
            scratch += stale
        for name in scratch:
            remove_path(self.spark, f"{self.path}/{name}")

    def seen_before(self, records: DataFrame) -> DataFrame:
        """``key``, ``record`` and ``first``, the first record with the same content, for all accepted ``records`` that are not the first themselves."""
        records = records.filter("content IS NOT NULL").groupBy("key").agg(F.min_by("content", "record").alias("content"), F.min("record").alias("record"))
        if not self.runs:
            return records.limit(0).select("key", "record", F.col("record").alias("first"))
        ledger = self._ledger(*self.runs)
        known = ledger.select(F.coalesce("remote", _digits()).alias("content"), "earliest")
        return records.join(known, "content").filter("earliest < record").select("key", "record", F.col("earliest").alias("first"))

    def _name(self, kind: str) -> str:
        with self._naming:
            self.written += 1
            return f"{kind}-{self.written:06d}"

    def _write(self, df: DataFrame, kind: str) -> str:
        name = self._name(kind)
        self.schemas[kind] = df.schema.jsonValue()
        df.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/{name}")
        return name

    def _keep(self, df: DataFrame, scratch: list[str]) -> tuple[DataFrame, int]:
        """``df`` written and read again, and its rows, which are counted while it is written."""
        seen = Observation()
        scratch.append(self._write(df.observe(seen, F.count("*").alias("rows")), "scratch"))
        return self._read(scratch[-1]), seen.get["rows"] or 0

    def _read(self, *names: str) -> DataFrame:
        """What is stored under ``names``, all of one kind."""
        schema = T.StructType.fromJson(self.schemas[names[0].rpartition("-")[0]])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}" for name in names))

    def _ledger(self, *runs: dict) -> DataFrame:
        return self._read(*(r["ledger"] for r in runs))

    def _commit(self) -> None:
        """Replaces the manifest; what it no longer names may be removed then."""
        old = [n for n in list_path(self.spark, self.path) if n.startswith("manifest-")]
        write_text(self.spark, f"{self.path}/manifest-{self.written:06d}", json.dumps({"widths": self.widths, "runs": self.runs, "schemas": self.schemas, "written": self.written}))
        for name in old:
            remove_path(self.spark, f"{self.path}/{name}")

    def _write_entries(self, contents: DataFrame, count: int | None = None) -> dict:
        """A run of ``contents``, sorted by place, and what is left of its crowded ranges."""
        # a range is cut to its first entries on every partition before it is brought together
        entries = _entries(contents, self.widths, "first")
        heads = entries.withColumn("slot", F.row_number().over(Window.partitionBy("at").orderBy("first", "id"))).filter(F.col("slot") <= SLOTS)
        seen = Observation()
        kept = _sorted(heads, "at", count).observe(seen, F.max("slot").alias("most"))
        name = self._write(kept.select("at", "bits", "id", F.when(F.col("slot") == SLOTS, F.col("first")).alias("last")), "entries")
        if (seen.get["most"] or 0) < SLOTS:
            return {"entries": name, "rest": None}
        ends = self._read(name).filter("last IS NOT NULL").select("at", "last", F.col("id").alias("last_id"))
        rest = entries.join(ends, "at").filter((F.col("first") > F.col("last")) | ((F.col("first") == F.col("last")) & (F.col("id") > F.col("last_id")))).drop("last", "last_id")
        return {"entries": name, "rest": self._write(_sorted(_second(rest), "place"), "rest")}

    def _merge(self, level: int) -> list[str]:
        """Merges runs where a level has too many; gives what they were stored in."""
        stale: list[str] = []
        while len(same := [r for r in self.runs if r["level"] == level]) >= RUNS_OF_A_LEVEL:
            ledger = self._write(_sorted(self._ledger(*same), "id"), "ledger")
            merged = {"level": level + 1, "contents": _contents(same), "ledger": ledger, **self._write_entries(self._read(ledger))}
            self.runs = [r for r in self.runs if r not in same] + [merged]
            stale += [name for r in same for name in (r["entries"], r["rest"], r["ledger"]) if name]
            level += 1
        return stale

    def _sparse(self, stored: DataFrame, rows: int, column: str, asked: DataFrame, many: int) -> DataFrame:
        """``stored``, of which only the ranges are read that hold what is ``asked``, where that hits fewer pages than its ``rows`` have."""
        if many > ASKED or many * PAGE_ROWS > rows:
            return stored
        values = sorted(r[0] for r in asked.distinct().collect())
        ranges = ranges_of(values)
        if not ranges or sum(b - a for a, b in ranges) > SPARSE * max(1, values[-1] - values[0]):
            return stored
        return stored.filter(_in_ranges(F.col(column), ranges))

    def _search(self, fresh: DataFrame, new: int, runs: list[dict], scratch: list[str]) -> DataFrame | None:
        """``id``, the words and ``best``, the first record within the radius found in the ranges of ``runs`` and of the batch itself, of ``fresh`` contents that have one."""
        asked = _entries(fresh, self.widths, "first")
        places = asked.select("at", "bits", F.col("id").alias("asker"))
        # of a crowded range of the batch only the first entries are met, as in the runs
        heads = asked.withColumn("slot", F.row_number().over(Window.partitionBy("at").orderBy("first", "id"))).filter(F.col("slot") <= SLOTS)
        entries = heads.select("at", "bits", "id")
        if runs:
            stored = self._read(*(r["entries"] for r in runs)).select("at", "bits", "id")
            entries = entries.unionAll(self._sparse(stored, _contents(runs) * len(self.widths), "at", places.select("at"), new * len(self.widths)))
        near = entries.alias("r").join((F.broadcast(places) if new <= BROADCAST else places).alias("q"), "at")
        near = near.filter((F.col("asker") != F.col("id")) & (F.bit_count(F.col("q.bits").bitwiseXOR(F.col("r.bits"))) <= RADIUS)).select("asker", "id")
        return self._verified(near, fresh, new, runs, scratch)

    def _search_rest(self, fresh: DataFrame, new: int, best: DataFrame | None, runs: list[dict], scratch: list[str]) -> DataFrame | None:
        """``best`` as it is after the rest of crowded ranges is searched for contents that one of them could precede."""
        crowded = [r for r in runs if r["rest"]]
        if not crowded:
            return best
        rest = self._read(*(r["rest"] for r in crowded))
        heads = rest.groupBy("at").agg(F.min("first").alias("head"))
        if best is not None:
            best, _ = self._keep(best, scratch)
        askers = _with_best(_entries(fresh, self.widths, *WORDS, "first"), best, new)
        askers = askers.join(heads, "at").filter(F.col("best").isNull() | (F.col("head") < F.col("best"))).drop("head")
        askers = _second(askers).select("place", "bits", F.col("id").alias("asker"), "best")
        more = rest.select("place", "bits", "id", "first").alias("r").join(askers.alias("q"), "place")
        more = more.filter((F.col("asker") != F.col("id")) & (F.col("best").isNull() | (F.col("first") < F.col("best"))) & (F.bit_count(F.col("q.bits").bitwiseXOR(F.col("r.bits"))) <= RADIUS))
        more = self._verified(more.select("asker", "id").distinct(), fresh, new, runs, scratch)
        both = [b for b in (best, more) if b is not None]
        return reduce(DataFrame.unionByName, both).groupBy("id", *WORDS).agg(F.min("best").alias("best")) if both else None

    def _verified(self, near: DataFrame, fresh: DataFrame, new: int, runs: list[dict], scratch: list[str]) -> DataFrame | None:
        """Of pairs of ``asker`` and ``id``, the first record of each asker (as ``id`` and its words) whose signature is within the radius."""
        near, pairs = self._keep(near, scratch)
        if not pairs:
            return None
        stored = [self._sparse(self._ledger(*old), _contents(old), "id", near.select("id"), pairs)] if (old := [r for r in runs if "ledger" in r]) else []
        known = reduce(DataFrame.unionAll, [d.select("id", *WORDS, "first") for d in (*stored, fresh)])
        askers = fresh.select(F.col("id").alias("asker"), *WORDS)
        found = known.join(F.broadcast(near) if pairs <= BROADCAST_PAIRS else near, "id").alias("r")
        found = found.join((F.broadcast(askers) if new <= BROADCAST else askers).alias("q"), "asker").filter(_within("q", "r"))
        by_asker = found.groupBy(F.col("asker").alias("id"), *(F.col(f"q.{w}").alias(w) for w in WORDS))
        return by_asker.agg(F.min("r.first").alias("best"))
