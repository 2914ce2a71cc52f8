"""Packing documents into training sequences by best-fit decreasing.

A document's ids (with a closing id) are cut into full windows while they are longer than a window; the rests are
placed longest first, each into the open window with the least room that still holds it.  A segment tree over the
remaining capacities finds that window in log2(window) steps.

Packing runs inside the task that encodes the texts, over buffers of a bounded number of tokens: nothing is shuffled,
memory does not grow with the input, and a lost task repeats its own part with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import bound_batches, chunks, give_back
from vigia.llm.tokens import JSON, RANKS, Encoder

#: Tokens packed together by one task (4 bytes each).
BUFFER_TOKENS = 1 << 22
#: Sequence ids are partition * 2**36 + number within the partition.
PARTITION_BITS = 36


class CapacityTree:
    """Multiset of open windows keyed by remaining capacity 0..size, with a search for the tightest that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << (size).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the smallest capacity >= need, or None."""
        i = need + self.leaves
        if not self.count[i]:
            # climb to the first subtree to the right that is not empty
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        window = self.open[capacity].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each length (1..size), and the number of windows; equal lengths keep their order."""
    tree, n = CapacityTree(size), 0
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            capacity, w, n = size, n, n + 1
        else:
            capacity, w = found
        window[i], offset[i] = w, size - capacity
        if capacity > need:
            tree.add(capacity - need, w)
    return window, offset, n


def pack(docs: DataFrame, size: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
         buffer_tokens: int = BUFFER_TOKENS, ranks: str = RANKS, json_file: str = JSON) -> DataFrame:
    """Pack every document into sequences of at most ``size`` tokens.

    Returns one row per piece: doc_id, start (ids of the document before the piece), length, ids (binary, unsigned
    32-bit little-endian), doc_tokens (with the closing id), sequence_id, offset (place in the sequence).  A null or
    empty text is the closing id alone; null ids and repeated rows are packed like others; an empty table gives no
    rows.  Other columns are not read."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(frames):
        enc = Encoder(ranks, json_file)
        at = TaskContext.get().partitionId() << PARTITION_BITS
        held: list[tuple] = []
        tokens = 0

        def flush():
            nonlocal at
            lengths = np.fromiter((x[2] for x in held), np.int64, len(held))
            window, offset, n = best_fit_decreasing(lengths, size)
            out = pd.DataFrame(held, columns=["doc_id", "start", "length", "ids", "doc_tokens"])
            out["sequence_id"], out["offset"] = at + window, offset
            at += n
            return out

        for pdf in chunks(frames):
            for key, t in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(enc(t), np.uint32(end_id)).astype("<u4")
                raw, n = ids.tobytes(), len(ids)
                for a in range(0, n, size):
                    held.append((key, a, min(size, n - a), raw[4 * a:4 * (a + size)], n))
                tokens += n
                if tokens >= buffer_tokens:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()
        held = enc = None
        give_back()

    bound_batches(docs.sparkSession)
    # ids travel as text: pandas would turn a column of integers with nulls into floats
    out = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (binary as in :func:`pack`), doc_ids in order of
    place.  A sequence holds at most ``size`` tokens, so its group is small."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), rows.alias("rows")).select(
        "sequence_id", "n_tokens",
        F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"])).alias("ids"),
        F.transform("rows", lambda r: r["doc_id"]).alias("doc_ids"))
