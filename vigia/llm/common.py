"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in chunks of about this many bytes, whatever the Arrow batch size, so that a worker's
#: memory does not depend on the length of the texts (one text is never cut: a longer one is a chunk of its own).
CHUNK_BYTES = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S29 = np.uint64(29)
_S32 = np.uint64(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every bit of the input."""
    h = (h ^ (h >> _S32)) * _MIX
    return (h ^ (h >> _S29)) * _MUL ^ (h >> _S32)


_BASE = _MUL
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random 64-bit number for each byte.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Byte tables for words: as they are, and with A-Z in lower case.
AS_IS = bytes(range(256))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def powers(n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the hash base and of its inverse, kept in ``cache`` for the next chunk."""
    if len(cache.get("power", ())) <= n:
        one = np.ones(1, np.uint64)
        for name, x in (("power", _BASE), ("inverse", _INV)):
            cache[name] = np.concatenate([one, np.cumprod(np.full(n + n // 4 + 1, x))])
    return cache["power"], cache["inverse"]


def span_hashes(codes: np.ndarray, cache: dict):
    """A function (lo, hi) -> hash of the codes in [lo, hi), for arrays of bounds: a polynomial hash from running sums
    (equal stretches have equal hashes wherever they stand; mix before use)."""
    power, inverse = powers(len(codes), cache)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:len(codes)])])
    return lambda lo, hi: (total[hi] - total[lo]) * inverse[lo]


def split_words(texts: list[bytes | None], cache: dict, letters: bytes = AS_IS) -> tuple[np.ndarray, ...]:
    """Words (runs of anything but ASCII white space, after ``letters``) of all texts, end to end: 64-bit hash, first
    and last + 1 byte within the text, and the number of the first word of each text and of the end."""
    size = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    start = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(b" ".join(t or b"" for t in texts).translate(letters) + b" ", np.uint8)
    solid = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13)))])
    begin = np.flatnonzero(solid[1:] & ~solid[:-1])
    end = np.flatnonzero(solid[:-1] & ~solid[1:])  # the last byte is a space
    h = mix(span_hashes(BYTE_CODES[raw], cache)(begin, end) + (end - begin).astype(np.uint64))
    first = np.append(np.searchsorted(begin, start), len(begin))
    base = np.repeat(start, np.diff(first))
    return h, begin - base, end - base, first


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (empty if there are fewer words)."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0]
    g = h[:m].copy()
    for j in range(1, n):
        g = g * _MUL + h[j:j + m]
    return mix(g + np.uint64(n))


def shingle_sets(texts: list[bytes | None], n: int, cache: dict) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles, with A-Z in lower case; with fewer words
    the whole sequence is one shingle, without words there is none."""
    h, _, _, first = split_words(texts, cache, LOWER)
    g = ngrams(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a:b - n + 1]))
        else:
            out.append(ngrams(h[a:b], b - a) if b > a else h[:0])
    return out


def chunks(frames: Iterator[pd.DataFrame], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pd.DataFrame]:
    """Cut the frames of a mapInPandas iterator into pieces of at most ``limit`` bytes of ``column`` (or one row)."""
    for pdf in frames:
        if len(pdf) == 0:
            continue
        size = pdf[column].map(lambda x: len(x) if x is not None else 0).to_numpy()
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield pdf.iloc[a:b].reset_index(drop=True)


#: Rows that travel to Python at once.  Spark's default of 10,000 whole texts is more than two workers and their JVM
#: should hold.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Let the session send at most ``BATCH_ROWS`` rows to Python at once; a smaller setting stays.  The setting is read
    when a plan runs, after the operator has returned it, so it is not put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system.  Spark keeps Python workers for later tasks, and what their allocators hold
    on to counts against the executor until then."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_chunks(df: DataFrame, schema: str, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
               column: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """``mapInPandas`` with bounded pieces: ``make()`` runs once per task and returns the function that turns one
    piece into an output frame."""
    bound_batches(df.sparkSession)

    def run(frames):
        f = make()
        for pdf in chunks(frames, column, limit):
            yield f(pdf)
        f = pdf = None
        give_back()
    return df.mapInPandas(run, schema)


def size_of(df: DataFrame, columns: list[str]) -> tuple[int, ...]:
    """Row count and the sum of each column, in one aggregate (a single row reaches the driver)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_s{i}")
                                                  for i, c in enumerate(columns)]).first()
    return tuple(int(x) for x in row)
