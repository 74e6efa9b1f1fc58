"""Passages of evaluation items inside documents.

Windows of consecutive words of an item and of a document get a 64-bit SimHash of their
words, weighted by their length.  Windows are item-sized, so that an item that leaked
whole is found although words of it were changed, and short, so that a part of it is:

* item-sized windows have the largest length of :func:`ladder` (a doubling of
  ``window``) that the item fills, and the item has two of them, at its begin and end;
* short windows of ``window`` words, as long as the shortest passage that counts, stand at
  every word of an item.

Documents have windows of all these lengths at every word.  A fingerprint is cut into
``radius + 1`` blocks; two fingerprints that differ in at most ``radius`` bits agree in
one block at least, so looking a document's windows up by block finds every item window
of their length within the radius.  What is found is verified by the exact similarity of
the two windows' shingles of :data:`SHINGLE` words, weighted by their letters (weighted
Jaccard similarity), and the length of the longest passage that both have word by word
is measured on the windows whose words are equal.

Items are handled in blocks of at most :data:`QUERY_WINDOWS` windows, each a broadcast of
bounded size (about 100 bytes a window) against one scan of the documents; documents are
never shuffled.  A long text is taken in slices that overlap by a window.

Defined cases:

* null and empty texts and texts of fewer than ``window`` words have no row;
* a document or item that comes several times counts once by its key;
* texts are compared whole, whatever their length;
* words are compared by 64-bit hashes;
* columns of the input other than those named are ignored, whatever their names;
* empty tables give an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, RADIUS, SIMILARITY, SHINGLE = 10, 3, 0.8, 5
#: Windows of items in a broadcast.
QUERY_WINDOWS = 1_048_576
#: Words of documents fingerprinted together, about; a longer text is cut into slices of so many.
BATCH_WORDS = 200_000
#: Letters of a word that count for its weight, at most.
HEAVIEST = 8
#: Letters that no decomposition takes apart.
LETTERS = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ħ": "h", "ı": "i"})


@functools.lru_cache(maxsize=1)
def _patterns():
    import regex

    return regex.compile(r"</?[a-zA-Z][^<>]*>"), regex.compile(r"[\p{M}\p{Cf}]+"), regex.compile(r"[\p{L}\p{N}]+")


def plain_words(text: str | None) -> list[str]:
    """The words of a text without case, accents, markup, punctuation and invisible characters."""
    if not text:
        return []
    tag, unseen, word = _patterns()
    text = tag.sub(" ", text)
    if not text.isascii():
        text = unseen.sub("", unicodedata.normalize("NFKD", text))
    return word.findall(text.casefold().translate(LETTERS))


def ladder(words: int, window: int) -> int:
    """The largest doubling of ``window`` that a text of so many words fills; 0 if it has fewer than ``window``."""
    size = window if words >= window else 0
    while size and 2 * size <= words:
        size *= 2
    return size


class Fingerprinter:
    """SimHashes of word windows; the words' hashes and signs are kept from batch to batch."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.signs = np.zeros((0, 64), np.int8)
        self.weights = np.zeros(0, np.int8)

    def look_up(self, words: list[str]) -> np.ndarray:
        """An index into hashes and weights for each word."""
        if len(self.ids) > 4 * BATCH_WORDS:
            self._clear()
        ids = self.ids
        before = len(ids)
        out = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        if len(ids) > before:
            fresh = list(ids)[before:]
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in fresh), np.uint64, len(fresh))
            weights = np.fromiter((min(len(w), HEAVIEST) for w in fresh), np.int8, len(fresh))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
            self.hashes = np.concatenate([self.hashes, hashes])
            self.weights = np.concatenate([self.weights, weights])
            self.signs = np.concatenate([self.signs, (2 * bits - 1) * weights[:, None]])
        return out

    def windows(self, ids: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        """For each size, the SimHash of the window at each position that has one.

        Sums wrap around; the sum of a window is a difference of two of them and is
        right in the narrowest whole number that holds it.
        """
        out = []
        sums: dict[type, np.ndarray] = {}
        for size in sizes:
            if len(ids) < size:
                out.append(np.zeros(0, np.uint64))
                continue
            kind = next(t for t in (np.int8, np.int16, np.int32) if size * HEAVIEST <= np.iinfo(t).max)
            if kind not in sums:
                sums[kind] = np.zeros((len(ids) + 1, 64), kind)
                np.cumsum(self.signs[ids], axis=0, dtype=kind, out=sums[kind][1:])
            of = sums[kind]
            out.append(np.packbits(of[size:] - of[:-size] > 0, axis=1).view(np.uint64).ravel())
        return out


@dataclass
class ItemWindows:
    """The windows of a bounded block of items, found by the blocks of their fingerprints among those of their size."""

    window: int
    radius: int
    keys: list = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    #: For each size the owner, start and fingerprint of its windows, and for each block its values in order.
    by_size: dict[int, tuple] = field(default_factory=dict)
    hashes: np.ndarray | None = None
    weights: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def seal(self) -> ItemWindows:
        prints = Fingerprinter()
        ids = [prints.look_up(w) for w in self.words]
        lengths = np.array([len(i) for i in ids])
        self.offsets = np.cumsum([0, *lengths])[:-1]
        flat = np.concatenate(ids)
        self.hashes, self.weights = prints.hashes[flat], prints.weights[flat].astype(np.int32)
        own = np.array([ladder(n, self.window) for n in lengths])
        edges = [round(64 * i / (self.radius + 1)) for i in range(self.radius + 2)]
        for size in sorted({self.window, *own.tolist()} - {0}):
            owner, start, found = [], [], []
            for n in np.flatnonzero(own >= self.window if size == self.window else own == size).tolist():
                of = prints.windows(ids[n], [size])[0]
                at = np.arange(len(of)) if size == self.window else np.unique([0, len(of) - 1])
                owner.append(np.full(len(at), n))
                start.append(at)
                found.append(of[at])
            if not found:
                continue
            found = np.concatenate(found)
            blocks = []
            for low, high in zip(edges, edges[1:], strict=False):
                value = (found >> np.uint64(low)) & np.uint64(2 ** (high - low) - 1)
                order = np.argsort(value, kind="stable")
                blocks.append((np.uint64(low), np.uint64(2 ** (high - low) - 1), value[order], order))
            self.by_size[size] = np.concatenate(owner), np.concatenate(start), found, blocks
        return self

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of a position in ``prints`` and an item window of that size within the radius."""
        _, _, own_prints, blocks = self.by_size[size]
        found = []
        for low, mask, values, order in blocks:
            own = (prints >> low) & mask
            first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            many = last - first
            at = np.flatnonzero(many)
            for part in np.array_split(at, max(1, int(many.sum()) // 4_000_000)):
                count = many[part]
                left = np.repeat(part, count)
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                right = order[np.repeat(first[part], count) + inner]
                close = np.bitwise_count(prints[left] ^ own_prints[right]) <= self.radius
                found.append(left[close] * np.int64(len(own_prints)) + right[close])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // len(own_prints), pairs % len(own_prints)


def _shingles(hashes: np.ndarray, weights: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of the shingles of the windows at ``at``, a row for each window."""
    words = at[:, None] + np.arange(size)
    many = size - SHINGLE + 1
    hash_, weight = np.zeros((len(at), many), np.uint64), np.zeros((len(at), many), np.int64)
    for i in range(SHINGLE):
        hash_ = hash_ * np.uint64(0x9E3779B97F4A7C15) + hashes[words[:, i : i + many]]
        weight += weights[words[:, i : i + many]]
    return hash_, weight


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each row of ``a`` and ``b``, counted as often as they come."""
    rows, many = a[0].shape
    if not rows:
        return np.zeros(0)
    row = np.repeat(np.arange(rows), 2 * many)
    hash_ = np.concatenate([a[0], b[0]], axis=1).ravel()
    order = np.lexsort((hash_, row))
    row, hash_ = row[order], hash_[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (hash_[1:] != hash_[:-1])])
    group = np.cumsum(new) - 1
    mine, others = (np.zeros((rows, many), np.int64) for _ in range(2))
    in_a = np.bincount(group, np.concatenate([a[1], others], axis=1).ravel()[order])
    in_b = np.bincount(group, np.concatenate([mine, b[1]], axis=1).ravel()[order])
    starts = np.flatnonzero(new)
    both = np.bincount(row[starts], np.minimum(in_a, in_b), rows)
    return both / np.bincount(row[starts], np.maximum(in_a, in_b), rows)


def _runs(doc: np.ndarray, owner: np.ndarray, start: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, owner, words): the passages that equal windows make up where they follow one another in both texts."""
    order = np.lexsort((place, place - start, owner, doc))
    doc, owner, start, place = doc[order], owner[order], start[order], place[order]
    new = np.ones(len(doc), bool)
    if len(doc) > 1:
        new[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], owner[first], np.diff([*first, len(doc)]) + window - 1


#: Pairs of windows that are verified together, about, in words.
VERIFIED_WORDS = 2_000_000


def _matches(texts: list[list[str]], prints: Fingerprinter, items: ItemWindows, least: float) -> Iterator[tuple[int, int, int, float]]:
    """(number of the text, number of the item, longest passage in words, best similarity) of a batch of texts in words."""
    words = [w for t in texts for w in t]
    bounds = np.cumsum([0, *map(len, texts)])
    sizes = sorted(items.by_size)
    ids = prints.look_up(words)
    hashes, weights = prints.hashes[ids], prints.weights[ids].astype(np.int32)
    best: dict[tuple[int, int], tuple[int, float]] = {}
    for size, found in zip(sizes, prints.windows(ids, sizes), strict=True):
        owners, starts, _, _ = items.by_size[size]
        place, wanted = items.near(found, size)
        doc = np.searchsorted(bounds, place, "right") - 1
        inside = place + size <= bounds[doc + 1]
        place, wanted, doc = place[inside], wanted[inside], doc[inside]
        owner, start = owners[wanted], starts[wanted]
        other = items.offsets[owner] + start
        for part in np.array_split(np.arange(len(place)), max(1, len(place) * size // VERIFIED_WORDS)):
            own = _shingles(hashes, weights, place[part], size), _shingles(items.hashes, items.weights, other[part], size)
            alike = similarities(*own)
            for d, o, s in zip(doc[part][alike >= least].tolist(), owner[part][alike >= least].tolist(), alike[alike >= least].tolist(), strict=True):
                n, most = best.get((d, o), (0, 0.0))
                best[d, o] = n, max(most, s)
            if size == items.window:
                part = part[alike == 1.0]
                same = (hashes[place[part][:, None] + np.arange(size)] == items.hashes[other[part][:, None] + np.arange(size)]).all(1)
                part = part[same]
                for d, o, n in zip(*(x.tolist() for x in _runs(doc[part], owner[part], start[part], place[part], size)), strict=True):
                    most, s = best[d, o]
                    best[d, o] = max(most, n), s
    for (d, o), (n, s) in best.items():
        yield d, o, n, s


def _slices(words: list[str], overlap: int) -> Iterator[list[str]]:
    """Parts of at most :data:`BATCH_WORDS` words and an overlap, so that no window is lost."""
    for start in range(0, max(len(words), 1), BATCH_WORDS):
        yield words[start : start + BATCH_WORDS + overlap]


def _item_blocks(items: DataFrame, key: str, text: str, window: int, radius: int) -> Iterator[ItemWindows]:
    block, size = ItemWindows(window, radius), 0
    rows = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("key IS NOT NULL").dropDuplicates(["key"])
    for row in rows.toLocalIterator():
        words = plain_words(row["text"])
        # a very long item goes to several blocks; parts overlap so that no window is lost
        for start in range(0, max(len(words) - window + 1, 0), QUERY_WINDOWS):
            part = words[start : start + QUERY_WINDOWS + window - 1]
            if size and size + len(part) > QUERY_WINDOWS:
                yield block.seal()
                block, size = ItemWindows(window, radius), 0
            block.keys.append(row["key"])
            block.words.append(part)
            size += len(part)
    if size:
        yield block.seal()


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
    radius: int = RADIUS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``(doc_key, item_key, words, similarity)``: each pair with windows at least so similar, and its longest common passage in words, 0 if none reaches ``window``."""
    spark = documents.sparkSession
    kinds = documents.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, words int, similarity double"
    rows = documents.select(F.col(f"`{doc_key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    found: DataFrame | None = None

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, prints = shared.value, Fingerprinter()
            overlap = max(block.by_size, default=1) - 1
            for batch in batches:
                keys = batch.column("key").to_pylist()
                out: list[tuple] = []
                texts: list[list[str]] = []
                owners: list = []
                size = 0

                def flush() -> None:
                    if size >= window:
                        out.extend((owners[d], block.keys[o], n, s) for d, o, n, s in _matches(texts, prints, block, similarity))
                    texts.clear()
                    owners.clear()

                for key, t in zip(keys, batch.column("text"), strict=True):
                    for part in _slices(plain_words(t.as_py()), overlap):
                        if size and size + len(part) > BATCH_WORDS:
                            flush()
                            size = 0
                        texts.append(part)
                        owners.append(key)
                        size += len(part)
                flush()
                columns = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field("key").type), pa.array(columns[1], item_type), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64())],
                    names=["doc", "item", "words", "similarity"],
                )

        return rows.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.schema[item_key].dataType)
    for block in _item_blocks(items, item_key, text, window, radius):
        part = search(spark.sparkContext.broadcast(block))
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    pairs = found.groupBy("doc", "item").agg(F.max("words").alias("words"), F.max("similarity").alias("similarity"))
    return pairs.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "words", "similarity")
