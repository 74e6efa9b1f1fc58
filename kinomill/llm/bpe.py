"""Encoding a corpus by replaying the merges of a public byte-level vocabulary.

Every text is split once by the vocabulary's pattern.  Texts are taken in chunks of
bounded size; a chunk lists its distinct words, and its texts become lists of places in
that list.  The words of all chunks are then brought together by word, so that every
distinct word of the corpus is encoded exactly once: over the distinct words of a
partition an inverted index from symbol pair to word positions is kept, and every merge
is applied in rank order at all of its positions at once, which touches only the
neighbours of those positions.  So the work of merging follows the number of distinct
words, not the length of the corpus.  Last, the ids go back to the chunks, whose texts
are put together by array operations.

A chunk names a word once, so however common a word is it has no more rows than there
are chunks, and no partition of words is crowded by it.

Defined cases:

* a null and an empty text give the empty list; a blank text is encoded like any other;
* strings of special tokens are ordinary text;
* texts of any length are encoded whole; repeated rows give repeated results;
* columns of the input other than those named are ignored, whatever their names;
* an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinomill.lineage import scratch_path

#: The pattern that splits text before the merges; a fixed value of the vocabulary. Below it what it says of ASCII.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\x0b\x0c\rA-Za-z0-9]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+"""
#: Code points of the texts of a chunk, about; a longer text is a chunk of its own.
CHUNK_CHARS = 4_000_000
#: Rows of words that are replayed together, about.
REPLAY_WORDS = 100_000


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a rank file: a base64 token and its id a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=1)
def _splitters():
    import regex

    return re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall


def split(text: str) -> list[str]:
    """The words of a text by the pattern."""
    ascii_words, words = _splitters()
    return ascii_words(text) if text.isascii() else words(text)


class Merges(dict):
    """From a pair of ids, as ``left << 20 | right``, to ``id << 40 | pair`` of its merge, or None where there is no such merge; filled as pairs are asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.spelling = ranks, {i: token for token, i in ranks.items()}

    def __missing__(self, pair: int) -> int | None:
        merge = self.ranks.get(self.spelling[pair >> 20] + self.spelling[pair & 0xFFFFF])
        found = self[pair] = None if merge is None else merge << 40 | pair
        return found


class MergeReplay:
    """Encodes many distinct words together."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.merges = Merges(ranks)

    def encode(self, words: Iterable[bytes]) -> list[list[int]]:
        """The ids of each word."""
        symbols: list[int] = []
        starts = [0]
        ranks, single, merges = self.ranks, self.single, self.merges
        for word in words:
            whole = ranks.get(word)
            if whole is None:
                symbols += [single[b] for b in word]
            else:
                symbols.append(whole)
            symbols.append(-1)
            starts.append(len(symbols))
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))

        #: Where each pair stands, under the number that orders it by the rank of its merge.
        index: dict[int, list[int]] = {}
        for i, (left, right) in enumerate(zip(symbols, symbols[1:], strict=False)):
            if left >= 0 and right >= 0:
                merge = merges[left << 20 | right]
                if merge is not None:
                    if merge in index:
                        index[merge].append(i)
                    else:
                        index[merge] = [i]
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            merge = heapq.heappop(queue)
            places = index.pop(merge)
            places.sort()  # overlapping pairs of equal symbols merge from the left
            left, right, joined = merge >> 20 & 0xFFFFF, merge & 0xFFFFF, merge >> 40
            for i in places:
                if symbols[i] != left or symbols[j := after[i]] != right:
                    continue  # a neighbour was merged away since this place was noted
                symbols[i] = joined
                symbols[j] = -2
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                if h >= 0 and symbols[h] >= 0:
                    fresh = merges[symbols[h] << 20 | joined]
                    if fresh is not None:
                        if fresh in index:
                            index[fresh].append(h)
                        else:
                            index[fresh] = [h]
                            heapq.heappush(queue, fresh)
                if symbols[k] >= 0:
                    fresh = merges[joined << 20 | symbols[k]]
                    if fresh is not None:
                        if fresh in index:
                            index[fresh].append(i)
                        else:
                            index[fresh] = [i]
                            heapq.heappush(queue, fresh)
        return [[s for s in symbols[a:b] if s >= 0] for a, b in zip(starts, starts[1:], strict=False)]


def _lists(lists: Iterable[Iterable[int]]) -> pa.ListArray:
    """An Arrow array of lists of 32-bit numbers."""
    flat, offsets = array("i"), array("i", [0])
    for x in lists:
        flat.extend(x)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))


def _in_parts(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about ``chars`` together; a longer text is a slice of its own."""
    start = size = 0
    for i, n in enumerate(pa.compute.utf8_length(batch.column("text")).to_pylist()):
        n = n or 0
        if size and size + n > chars:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def chunked(df: DataFrame, key: str = "doc_id", text: str = "text", chars: int = CHUNK_CHARS) -> DataFrame:
    """``(chunk, key, at, words)``: for each text its words' places in the list of its chunk, and a row with that list (and null ``at``) for each chunk."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "key", "at", "words"]
        number = TaskContext.get().partitionId() << 33
        places: dict[str, int] = {}
        size = 0

        def close(key_type: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([number]), pa.nulls(1, key_type), pa.nulls(1, pa.list_(pa.int32())), pa.array([list(places)], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        key_type = None
        for batch in batches:
            key_type = batch.column("key").type
            for part in _in_parts(batch, chars):
                texts = part.column("text").to_pylist()
                add = sum(len(t) for t in texts if t)
                if size and size + add > chars:
                    yield close(key_type)
                    number, size = number + 1, 0
                    places.clear()
                size += add
                at = _lists([places.setdefault(w, len(places)) for w in split(t)] if t else () for t in texts)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(part)), part.column("key"), at, pa.nulls(len(part), pa.list_(pa.string()))], names=names)
        if size:
            yield close(key_type)

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"chunk long, key {kind}, at array<int>, words array<string>")


def replayed(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Replaces ``word`` by ``ids``; equal words follow one another and are encoded once."""
    encoder = MergeReplay(load_ranks(vocabulary))
    last: str | None = None
    ids_of_last: list[int] = []

    def encode(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal last, ids_of_last
        table = pa.Table.from_batches(group).combine_chunks()
        words = table.column("word").to_pylist()
        known = {last: ids_of_last} if last is not None else {}
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(fresh, encoder.encode(w.encode() for w in fresh), strict=True))
        last, ids_of_last = words[-1], known[words[-1]]
        ids = _lists(known[w] for w in words)
        return pa.RecordBatch.from_arrays([table.column("chunk").combine_chunks(), table.column("place").combine_chunks(), ids], names=["chunk", "place", "ids"])

    group: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            group.append(batch)
        if sum(b.num_rows for b in group) >= REPLAY_WORDS:
            yield encode(group)
            group = []
    if group:
        yield encode(group)


def _put_together(texts: pa.Table, words: pa.Table) -> pa.Table:
    """``key`` and ``ids`` of the texts of a chunk."""
    at, ids = texts.column("at").combine_chunks(), words.column("ids").combine_chunks()
    place = np.empty(words.num_rows, np.int64)  # the row of the word at each place of the chunk's list
    place[words.column("place").to_numpy()] = np.arange(words.num_rows)
    begins, lengths = ids.offsets.to_numpy().astype(np.int64), pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    values = ids.values.to_numpy()
    rows = place[at.flatten().to_numpy()]
    many = lengths[rows]
    ends = np.concatenate([[0], np.cumsum(many)])
    inner = np.arange(ends[-1]) - np.repeat(ends[:-1], many)
    flat = values[np.repeat(begins[rows], many) + inner] if len(rows) else np.zeros(0, np.int32)
    words_before = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(at).to_numpy(zero_copy_only=False))])
    out = pa.ListArray.from_arrays(pa.array(ends[words_before].astype(np.int32)), pa.array(flat, pa.int32()))
    return pa.table({"key": texts.column("key"), "ids": out})


def encode_corpus(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", chars: int = CHUNK_CHARS) -> DataFrame:
    """``(key, ids)`` for every row; ``vocabulary`` is the path of a rank file that every executor can read."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    split_once, path = chunked(df, key, text, chars), scratch_path(spark, "chunks")
    split_once.write.parquet(path)
    chunks = spark.read.schema(split_once.schema).parquet(path)
    named = chunks.filter("words IS NOT NULL").select("chunk", F.posexplode("words").alias("place", "word"))
    encoded = named.repartition("word").sortWithinPartitions("word").mapInArrow(lambda batches: replayed(batches, vocabulary), "chunk long, place int, ids array<int>")
    texts = chunks.filter("words IS NULL").select("chunk", "key", "at")
    whole = texts.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(_put_together, f"key {kind}, ids array<int>")
    return whole.withColumnRenamed("key", key)
