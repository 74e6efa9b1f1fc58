import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinomill.llm import bpe
from kinomill.llm.bpe_queries import TOKENIZERS

RANKS = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files")
TEXTS = ["", "  ", "\n\n\t x", "Hello world's end, isn't it?", "aaaaaaaaaaaaaaaaaaa", "<|endoftext|> plain", "冬天的花园 école ​﻿", "1234567 ٣٤ x²", "\x00\x1c\x85  ", "🙂🙂 'S 're"]


def reference():
    ranks = bpe.load_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    replay = bpe.MergeReplay(bpe.load_ranks(RANKS))
    return [[i for ids in replay.encode(w.encode() for w in bpe.split(t or "")) for i in ids] for t in texts]


def test_texts_against_a_library():
    enc = reference()
    assert encode(TEXTS) == [enc.encode_ordinary(t) for t in TEXTS]
    assert encode([None, ""]) == [[], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text_and_round_trip(texts):
    enc = reference()
    ids = encode(texts)
    assert ids == [enc.encode_ordinary(t) for t in texts]
    assert [enc.decode(i) for i in ids] == texts


def test_replay_of_words_together_equals_words_alone():
    replay = bpe.MergeReplay(bpe.load_ranks(RANKS))
    rng = random.Random(0)
    words = ["".join(rng.choice("abcde ein") for _ in range(rng.randint(1, 30))).encode() for _ in range(500)]
    assert replay.encode(words) == [replay.encode([w])[0] for w in words]


def test_corpus(spark):
    long = "the winter garden " * 30_000
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, long])] + [(0, TEXTS[0], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.encode_corpus(df, RANKS)
    assert out.columns == ["doc_id", "ids"] and dict(out.dtypes)["ids"] == "array<int>"
    enc = reference()
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == {i: enc.encode_ordinary(t or "") for i, t, _ in rows}
    assert out.count() == len(rows)


def test_every_distinct_word_is_encoded_once(monkeypatch):
    asked = []
    encode_words = bpe.MergeReplay.encode
    monkeypatch.setattr(bpe.MergeReplay, "encode", lambda self, words: encode_words(self, asked.extend(words := list(words)) or words))
    monkeypatch.setattr(bpe, "REPLAY_WORDS", 7)
    words = sorted(w for w in ["a", " b", " winter", "冬"] for _ in range(10))
    rows = [pa.RecordBatch.from_pydict({"chunk": [i], "place": pa.array([0], pa.int32()), "word": [w]}) for i, w in enumerate(words)]
    out = pa.Table.from_batches(list(bpe.replayed(iter(rows), RANKS))).to_pylist()
    assert sorted(asked) == sorted({w.encode() for w in words})
    enc = reference()
    assert [r["ids"] for r in out] == [enc.encode_ordinary(w) for w in words]


def test_many_chunks(spark):
    rows = [(i, " ".join(f"word{j % 97}" for j in range(i, i + 60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert bpe.chunked(df, chars=900).select("chunk").distinct().count() > 10
    enc = reference()
    assert {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df, RANKS, chars=900).collect()} == {i: enc.encode_ordinary(t) for i, t in rows}


def test_empty_table(spark):
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), RANKS).count() == 0
