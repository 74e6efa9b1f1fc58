"""Arithmetic on vectors held as arrays of single precision."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def inner_product(a: Column, b: Column) -> Column:
    """Products in single precision, their sum in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("float") * y.cast("float")).cast("double")), F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column, undefined: float = 0.0, squares: Column | None = None) -> Column:
    """The cosine in single precision, within -1 and 1; ``undefined`` for empty, unequal or zero vectors.

    ``squares`` is the product of the vectors' inner products with themselves; give it
    where each vector meets many others, so that it is not computed for every pair.
    """
    squares = inner_product(a, a) * inner_product(b, b) if squares is None else squares
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / F.sqrt(squares)))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (squares != 0), value).otherwise(undefined).cast("float")


def cosine_to(a: Column, query: Sequence[float], undefined: float = 0.0) -> Column:
    """:func:`cosine` to one given vector."""
    given = np.asarray(query, np.float32)
    square = float((given * given).astype(np.float64).sum())
    return cosine(a, F.lit([float(x) for x in given]).cast("array<float>"), undefined, inner_product(a, a) * F.lit(square))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda total, x: total + x))


def unit(a: Column) -> Column:
    """The vector of length 1; a zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: (x.cast("double") / length).cast("float"))).otherwise(a)


def mean_of_top(scores: Column, n: int = 3) -> Column:
    """The mean of the ``n`` highest scores above -1, else -1."""
    best = F.slice(F.sort_array(F.filter(scores, lambda s: s > -1), asc=False), 1, n)
    total = F.aggregate(best, F.lit(0.0).cast("float"), lambda t, s: (t + s).cast("float"))
    return F.when(F.size(best) > 0, (total / F.size(best)).cast("float")).otherwise(F.lit(-1.0).cast("float"))


def to_bytes(a: Column) -> Column:
    """Little-endian single precision."""

    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(pack, T.BinaryType())(a)


def from_bytes(b: Column) -> Column:
    """The vector of :func:`to_bytes`; empty if the length is no multiple of four."""

    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda x: None if x is None else (np.frombuffer(x, "<f4").tolist() if len(x) % 4 == 0 else []))

    return F.pandas_udf(unpack, T.ArrayType(T.FloatType()))(b)


def _embedded(lists: list[Sequence[str]], dimensions: int) -> np.ndarray:
    """A row of length 1 for each list of tokens; every distinct token is hashed once."""
    words = [np.asarray(x, object) for x in lists]
    sizes = np.array([len(w) for w in words], np.int64)
    codes, distinct = pd.factorize(np.concatenate(words)) if sizes.sum() else (np.zeros(0, np.int64), np.zeros(0, object))
    digests = [hashlib.blake2b(token.encode(), digest_size=8).digest() for token in distinct]
    places = np.array([int.from_bytes(d[:4], "big") % dimensions for d in digests], np.int64)
    signs = np.array([1.0 if d[4] & 1 else -1.0 for d in digests])
    cells = np.repeat(np.arange(len(words)) * dimensions, sizes) + places[codes]
    vectors = np.bincount(cells, signs[codes], len(words) * dimensions).reshape(len(words), dimensions)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(lengths > 0, lengths, 1.0)).astype(np.float32)


def _checked(dimensions: int) -> int:
    if dimensions < 8:
        raise ValueError("at least 8 dimensions")
    return dimensions


def hashed_tokens(tokens: Column, dimensions: int = 256) -> Column:
    """A vector of length 1 in which each token adds 1 or -1 to a place, both chosen by its hash."""
    _checked(dimensions)

    def embed(lists: pd.Series) -> pd.Series:
        return pd.Series(list(_embedded([[] if x is None else x for x in lists], dimensions)))

    return F.pandas_udf(embed, T.ArrayType(T.FloatType()))(tokens)


def case_folded_tokens(text: str | None) -> list[str]:
    """Words of Latin letters and digits, then single Chinese characters, their pairs and triples, of the case-folded text."""
    folded = (text or "").casefold()
    signs = re.findall("[\u4e00-\u9fff]", folded)
    return re.findall("[a-z0-9]+", folded) + signs + ["".join(signs[i : i + n]) for n in (2, 3) for i in range(len(signs) - n + 1)]


def hashed_texts(text: Column, dimensions: int = 256) -> Column:
    """:func:`hashed_tokens` of :func:`case_folded_tokens`; a null text gives the zero vector."""
    _checked(dimensions)

    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_embedded([case_folded_tokens(t) for t in texts], dimensions)))

    return F.pandas_udf(embed, T.ArrayType(T.FloatType()))(text)


def hashed_bytes(content: Column, dimensions: int = 512) -> Column:
    """A vector of length 1 from the 64-byte hash of a content, repeated."""

    def embed(blobs: pd.Series) -> pd.Series:
        def one(blob) -> list[float] | None:
            if blob is None:
                return None
            digest = np.frombuffer(hashlib.blake2b(blob, digest_size=64).digest(), np.uint8)
            vector = np.resize(digest, dimensions) / 127.5 - 1.0
            length = np.linalg.norm(vector)
            return (vector / length if length else vector).astype(np.float32).tolist()

        return blobs.map(one)

    return F.pandas_udf(embed, T.ArrayType(T.FloatType()))(content)
