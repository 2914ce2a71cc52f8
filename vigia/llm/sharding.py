"""Sharding by sampled splitters (sample sort).

1. Every record gets a range key: the hash of its text, then its id, so that equal texts are neighbours in key order.
2. Records are sampled with a probability in proportion to their size; quantiles of the sample are the splitters of
   many more ranges than shards.  These splitters lie between texts, so equal texts share a range.
3. Records are range-partitioned by the splitters.  A range that holds much more than its share (sampling error, or a
   very frequent text) is subdivided by splitters drawn from that range alone; a frequent text is first set apart and
   then cut by its ids, until no range is overfull.
4. Ranges are dealt to the shards by their exact bytes, largest first to the shard that holds least.  A window over
   each range numbers its records; with the counts of the shard's earlier ranges this is the slot.

Only the sample and one row per range (a fixed number per shard) reach the driver.  No range or task grows with the
number of copies of a text.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigia.llm.common import size_of
from vigia.session import materialize

#: Ranges per shard before subdivision, and sampled keys per range.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 16, 8
#: A range is subdivided when it holds more than this multiple of its share of bytes or rows.
OVERFULL = 3.0
#: Length of the part of a key that is the text's hash; a suffix that sorts after every id.
HASH_CHARS, AFTER_IDS = 16, "3"


def _key(text_hash: Column, doc_id: Column) -> Column:
    """Fixed-width hexadecimal key that sorts like (hash, id); a null id comes first."""
    return F.concat(F.lpad(F.hex(text_hash), 16, "0"),
                    F.when(doc_id.isNull(), F.lit("0" * 17)).otherwise(
                        F.concat(F.when(doc_id < 0, F.lit("1")).otherwise(F.lit("2")), F.lpad(F.hex(doc_id), 16, "0"))))


def _range_of(splitters: list[str]):
    cuts = np.array(splitters, dtype="S33")

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy().astype("S33"), side="right").astype(np.int32))
    return place


def _quantiles(keys: list[str], n: int) -> list[str]:
    keys = sorted(keys)
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []


def _between_texts(keys: list[str], n: int) -> list[str]:
    """Splitters that set texts apart; a text that fills several quantiles gets a range of its own."""
    cuts = [k[:HASH_CHARS] for k in _quantiles(keys, n)]
    return sorted({*cuts, *(k + AFTER_IDS for k in cuts if cuts.count(k) > 1)})


def _deal(ranges: list, n_shards: int) -> list[tuple[int, int, int]]:
    """(range, shard, first slot), largest range first to the shard with the fewest bytes."""
    heap, dealt, rows = [(0, i) for i in range(n_shards)], [], [0] * n_shards
    for r in sorted(ranges, key=lambda r: (-r.bytes, r.range)):
        held, i = heapq.heappop(heap)
        dealt.append((r.range, i, rows[i]))
        rows[i] += r.rows
        heapq.heappush(heap, (held + r.bytes, i))
    return dealt


def shard(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 8,
          max_rounds: int = 8) -> DataFrame:
    """Place every row of ``docs`` in one of ``n_shards`` shards of nearly equal size in bytes.

    Returns one row per input row: doc_id, size (UTF-8 bytes of the text plus ``overhead``), text_crc32, shard
    (0 .. n_shards-1), slot (place in the shard, gapless from 0).  A null text has size ``overhead`` and the checksum
    of the empty string; null ids are placed like others; repeated rows are separate records; an empty table gives an
    empty result.  Other columns of ``docs`` are not read.  Equal texts share a shard unless together they are an
    overfull range."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        _key(F.xxhash64(body), F.col(doc_id).cast("long")).alias("key"),
        F.xxhash64(body, F.col(doc_id), F.lit(7)).alias("draw")))
    n, total = size_of(slim, ["size"])
    if n == 0:
        kind = slim.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
    ranges = n_shards * RANGES_PER_SHARD
    share, row_share = total / ranges, n / ranges
    # a uniform number that depends on the row alone, so that a repeated task draws the same sample
    uniform = F.pmod(F.col("draw"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def draw(frame: DataFrame, p) -> list[str]:
        return [r.key for r in frame.filter(uniform < p).select("key").collect()]

    by_size = F.col("size") * F.lit(ranges * SAMPLES_PER_RANGE / max(total, 1))
    splitters = _between_texts(draw(slim, by_size), ranges)
    for _ in range(max_rounds):
        placed = slim.withColumn("range", _range_of(splitters)("key"))
        per = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                                          F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        over = [r for r in per if r.lo != r.hi and (r.bytes > OVERFULL * share or r.rows > max(64, OVERFULL * row_share))]
        if not over:
            break
        # drawn by size and by rows, since a range of many small records is overfull too
        hot, want = placed.filter(F.col("range").isin([r.range for r in over])), len(over) * SAMPLES_PER_RANGE * 4
        keys = draw(hot, F.col("size") * F.lit(want / sum(r.bytes for r in over)) + F.lit(want / sum(r.rows for r in over)))
        drawn: dict[int, list[str]] = {}
        for k in keys:
            drawn.setdefault(bisect.bisect_right(splitters, k), []).append(k)
        more = set(splitters)
        for r in over:
            parts = max(2, int(max(r.bytes / share, r.rows / row_share)) + 1)
            one_text = r.lo[:HASH_CHARS] == r.hi[:HASH_CHARS]
            more.update((_quantiles if one_text else _between_texts)(drawn.get(r.range, []), parts))
            more.add(r.hi if one_text else r.hi[:HASH_CHARS])
        splitters = sorted(more)
    dealt = F.broadcast(spark.createDataFrame(_deal(per, n_shards), "range int, shard int, first long"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("key", "size", "text_crc32")) - 1
    return placed.withColumn("nth", nth).join(dealt, "range").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write ``docs`` as Parquet under ``path``, one folder per shard, each in slot order.  ``placed`` comes from
    :func:`shard`; ids must be unique for the records to be told apart."""
    keyed = docs.join(placed.select(F.col(doc_id), "shard", "slot"), doc_id)
    keyed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
