"""Intermediate tables in the shared folder, bounded sums of vectors, and connected components."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.session import checkpoint_dir


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder of ``spark.checkpoint.dir`` and read it back: the lineage ends
    at a table that outlives any executor, in columns and compressed."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Cells per block in which vectors travel.
VECTOR_BLOCK = 1 << 16


def vector_sum(df: DataFrame, cells: int, make: Callable[[], Callable[[pd.DataFrame], np.ndarray]],
               column: str | None = None, limit: int = 0, spread: int = 32) -> np.ndarray:
    """Sum over all rows of vectors of ``cells`` counts.

    ``make()`` gives a function that turns a piece of ``df`` (of at most ``limit`` bytes of ``column``, if given) into
    the cells it adds one to, repeats included.  Each task keeps one dense vector; vectors are added block by block in two rounds of streaming tasks, so no task holds more
    than its blocks and the driver receives one vector of a fixed size."""
    from vigia.llm.common import bound_batches, chunks, give_back
    bound_batches(df.sparkSession)
    block = min(cells, VECTOR_BLOCK)

    def count(frames):
        f, total, some = make(), np.zeros(cells, np.uint32), False
        for pdf in chunks(frames, column, limit) if column else frames:
            total += np.bincount(f(pdf), minlength=cells).astype(np.uint32)
            some = True
        if some:
            salt = TaskContext.get().partitionId() % spread
            for b in range(0, cells, block):
                part = total[b:b + block]
                if part.any():
                    yield pd.DataFrame({"block": [b], "salt": [salt], "v": [zlib.compress(part.tobytes(), 1)]})
        f = total = None
        give_back()

    def add(frames):
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in frames:
            for b, s, v in zip(pdf["block"], pdf["salt"], pdf["v"]):
                got = np.frombuffer(zlib.decompress(v), np.uint32)
                held[b, s] = held[b, s] + got if (b, s) in held else got
        for (b, s), v in held.items():
            yield pd.DataFrame({"block": [b], "salt": [s], "v": [zlib.compress(v.tobytes(), 1)]})

    schema = "block int, salt int, v binary"
    rows = df.mapInPandas(count, schema)
    rows = rows.repartition("block", "salt").mapInPandas(add, schema).withColumn("salt", F.lit(0))
    rows = rows.repartition("block").mapInPandas(add, schema)
    out = np.zeros(cells, np.uint32)
    for r in rows.collect():
        part = np.frombuffer(zlib.decompress(r["v"]), np.uint32)
        out[r["block"]:r["block"] + len(part)] = part
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long), as (node, component) with the smallest node of the
    component; nodes without an edge do not occur.

    Alternating large-star and small-star rounds: each is a few aggregates and joins over the edges, whose result is a
    table in the shared folder, and the number of rounds grows with the logarithm of a component's size.  No edge
    list reaches the driver or a single task: a star's minimum is a partial aggregate, and the join that hands it out
    is one that AQE can split."""
    e = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(),
             "edges")
    last = None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        small = small.select(F.col("m").alias("a"), F.col("b")).unionByName(
            small.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
        e = save(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                e.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
        last = now
    raise RuntimeError("connected components did not settle")
