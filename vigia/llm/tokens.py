"""Token ids of the public byte-level BPE vocabulary, and exact length histograms.

Ids are those of ``tokenizers`` with ``byte_bpe_50k.json``.  They are computed by tiktoken from the same vocabulary in
rank form, which gives the same ids about three times as fast (tests compare the two); a text that holds the string of
a special token is encoded by ``tokenizers`` itself, since only that library turns the string into the special id, and
so is a text with a run of white space too long for tiktoken's pattern.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigia.llm.common import map_chunks
from vigia.llm.scratch import save

#: Vocabulary files (names for ``public_tokenizers.path`` or absolute paths).
RANKS, JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
#: Lengths per block of the suffix sums.
BLOCK = 4096


def _path(name: str) -> str:
    import public_tokenizers
    return name if "/" in name else public_tokenizers.path(name)


class Encoder:
    """Callable that turns a text (null: empty) into a numpy array of unsigned 32-bit ids."""

    def __init__(self, ranks: str = RANKS, json_file: str = JSON):
        import public_tokenizers
        import tiktoken
        with open(_path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.json_file, self.slow = json_file, None

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if SPECIAL in text:
            return self.by_tokenizers(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern's search for the end of a very long run ran out of stack
            return self.by_tokenizers(text)

    def by_tokenizers(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(_path(self.json_file))
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def length_histogram(docs: DataFrame, text: str = "text", ranks: str = RANKS, json_file: str = JSON) -> DataFrame:
    """Exact histogram of encoded lengths over every whole text: (n_tokens, n_docs), one row per length that occurs.

    Null and empty texts have 0 tokens; repeated rows count each time; an empty table gives no rows.  Each task counts
    its own texts before anything is shuffled, so the shuffle carries lengths, not documents."""
    def make():
        enc = Encoder(ranks, json_file)

        def count(pdf):
            n, c = np.unique(np.fromiter((len(enc(t)) for t in pdf["text"]), np.int64, len(pdf)), return_counts=True)
            return pd.DataFrame({"n_tokens": n, "n_docs": c.astype(np.int64)})
        return count
    part = map_chunks(docs.select(F.col(text).alias("text")), "n_tokens long, n_docs long", make)
    return part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_report(histogram: DataFrame) -> DataFrame:
    """Answers for every context limit from an exact histogram, by suffix sums.

    One row per length L that occurs, taken as the limit: n_docs with exactly L tokens, docs_over (longer than L),
    tokens_over (all tokens of those), fit_tokens (tokens of the documents that fit), truncated_total (sum of
    min(length, L) over all documents), total_docs, total_tokens, and quantile: the part of the documents with at
    most L tokens, so that the q-quantile is the smallest L with quantile >= q.  A limit between two lengths has the
    row of the next lower length plus (limit - L) * docs_over truncated tokens.

    The sums run within blocks of ``BLOCK`` lengths and over one row per block, so no task orders all lengths."""
    histogram = save(histogram, "lengths")  # read twice below; the texts are encoded once
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    per = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
                     F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
                     F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    x = (h.withColumn("d_in", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
         .withColumn("t_in", F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)))
         .join(per, "block"))
    over, t_over = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    fit = F.col("total_tokens") - t_over
    return x.select(
        "n_tokens", "n_docs", over.alias("docs_over"), t_over.alias("tokens_over"), fit.alias("fit_tokens"),
        (fit + over * F.col("n_tokens")).alias("truncated_total"), "total_docs", "total_tokens",
        ((F.col("total_docs") - over) / F.col("total_docs")).alias("quantile"))
