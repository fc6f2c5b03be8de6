"""Tokens, trigrams and the deterministic hashing embedder."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramite.functions.normalize import trimmed
from engramite.schema import EMBEDDING_DIM

#: Texts whose vectors are made together.
ROWS_AT_ONCE = 256
_SPLIT = regex.compile(r"[^\p{L}\p{N}]+")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a text without any is one token, an empty or null one ``_empty_``."""
    clean = F.coalesce(trimmed(text), F.lit(""))
    found = F.filter(F.split(F.lower(clean), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.when(clean == "", F.lit("_empty_")).otherwise(clean)))


def trigrams(token: Column) -> Column:
    """Runs of three characters of a token; a token of fewer than three characters is its own."""
    n = F.char_length(token)
    return F.when(n < 3, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(token, i, F.lit(3))))


def _word(text: str) -> int:
    return struct.unpack(">I", hashlib.md5(text.encode()).digest()[:4])[0]


@lru_cache(maxsize=200_000)
def _feature(name: str, dim: int) -> tuple[int, float]:
    return _word("tok:" + name) % dim, (-1.0 if _word("sgn:" + name) % 2 else 1.0) * (1.0 + math.log(1 + len(name.encode())))


@lru_cache(maxsize=200_000)
def _features(token: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signed weights of a token at the first position."""
    grams = [token] if len(token) < 3 else [token[i : i + 3] for i in range(len(token) - 2)]
    # trigrams are far fewer than tokens
    found = [_feature.__wrapped__(token, dim), *(_feature("tri:" + g, dim) for g in grams)]
    weights = np.array([w for _, w in found])
    weights[1:] *= 0.5
    return np.array([b for b, _ in found]), weights


def hashed_vectors(texts: list[str | None], dim: int = EMBEDDING_DIM) -> np.ndarray:
    """The unit vectors of texts, one a row: signed buckets of tokens and trigrams, weighed by 1 / (1 + position)."""
    out = np.zeros((len(texts), dim))
    for start in range(0, len(texts), ROWS_AT_ONCE):
        part = texts[start : start + ROWS_AT_ONCE]
        number: dict[str, int] = {}
        found: list[int] = []
        sizes = []
        for text in part:
            clean = (text or "").strip()
            words = [t for t in _SPLIT.split(clean.lower()) if t] or [clean or "_empty_"]
            found += [number.setdefault(t, len(number)) for t in words]
            sizes.append(len(words))
        features = [_features(t, dim) for t in number]
        width = np.array([b.size for b, _ in features])
        buckets, weights = (np.concatenate([f[k] for f in features]) for k in (0, 1))
        begin, token, size = np.cumsum(width) - width, np.array(found), np.array(sizes)
        row = np.repeat(np.arange(size.size), size)
        scale = 1.0 / (np.arange(token.size) - (np.cumsum(size) - size)[row] + 1)
        # a text's equal tokens together
        pairs, at = np.unique(row * len(number) + token, return_inverse=True)
        scale = np.bincount(at, scale)
        row, token = np.divmod(pairs, len(number))
        n = width[token]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[token], n)
        whole = np.bincount(np.repeat(row, n) * dim + buckets[at], weights[at] * np.repeat(scale, n), size.size * dim).reshape(-1, dim)
        norm = np.sqrt((whole * whole).sum(axis=1, keepdims=True))
        out[start : start + len(part)] = whole / np.where(norm <= 1e-12, 1.0, norm)
    return out


def hashed_vector(text: str | None, dim: int = EMBEDDING_DIM) -> np.ndarray:
    return hashed_vectors([text], dim)[0]


def spread(rows: DataFrame) -> DataFrame:
    """The same rows for work that is heavy on the CPU: an input of fewer partitions than cores is dealt out to all of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def embedded(df: DataFrame, text: str, into: str = "embedding", dim: int = EMBEDDING_DIM) -> DataFrame:
    """``df`` with a hashed vector of each text; a blank or null text has a null vector.

    Rows stay where they are: no explode, no shuffle.  A column named ``into`` is replaced.
    """
    kept = [c for c in df.columns if c != into]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema.add(into, T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            blank = np.array([not (t and t.strip()) for t in texts], dtype=bool)
            flat = hashed_vectors(texts, dim).astype(np.float32).ravel()
            column = pa.FixedSizeListArray.from_arrays(pa.array(flat), dim, mask=pa.array(blank)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, into])

    return df.mapInArrow(run, schema)


def bucket_weights(df: DataFrame, key: str, text: str, dim: int = EMBEDDING_DIM, digits: int | None = None) -> DataFrame:
    """(key, bucket, value): the buckets of each text's vector that aren't 0, as doubles; blank texts count as ``_empty_``.

    With ``digits``, values are rounded to so many, halves away from 0, as SQL does, and those that round to 0 are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                vectors = hashed_vectors(part.column(1).to_pylist(), dim)
                if digits is not None:
                    vectors = np.copysign(np.floor(np.abs(vectors) * 10.0**digits + 0.5) / 10.0**digits, vectors)
                row, at = np.nonzero(vectors)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at, pa.int64()), pa.array(vectors[row, at])], ["key", "bucket", "value"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"key {kind}, bucket long, value double").withColumnRenamed("key", key)
