"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

For each benchmark item, windows of the item's length slide over every text (a shorter text is one window).  A window's SimHash is the sign of the
weighted sum of its words' hash bits, taken from running sums.  Items are indexed by the blocks of their fingerprint
(``BLOCKS`` = 2 halves): two fingerprints that differ in at most ``RADIUS`` = 23 bits differ in at most 11 bits in one
of the halves, so all items whose half is that near, found by the distinct values of the half, are all items within the
radius.  (A random window meets 0.11 candidates per item; blocks of 16 and 8 bits give 0.42 and 1.16.)  Candidates are
verified by the weighted containment of the item's word shingles in the window, where rare shingles weigh more.

Windows whose shingles weigh too little to reach the least containment of any item of their length get no fingerprint
(a bound that loses nothing).  The benchmark goes to the tasks
in blocks of a bounded number of items; the documents are read once per block, and nothing is shuffled but matches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import bound_batches, chunks, map_chunks, mix, ngrams, split_words

#: Words per shingle, the least weighted containment of an item, and the Hamming radius of the search.
SHINGLE, MIN_SIMILARITY, RADIUS = 3, 0.6, 23
#: Items that are sent to the tasks at once.
BLOCK_ITEMS = 20_000
#: Blocks of a fingerprint.
BLOCKS = 2
#: Windows of a text that are fingerprinted from the same running sums, and pairs of half values compared at a time.
PIECE, BATCH_PAIRS = 1 << 14, 1 << 20

_U = np.uint64
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(texts: list[str | None], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in lower case, with the first word of each text and the end; ASCII punctuation
    and white space separate."""
    h, _, _, first = split_words([t.lower().encode("utf-8", "ignore") if t else None for t in texts], cache, _PLAIN)
    return h, first


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Index:
    """One block of benchmark items: shingle weights, and fingerprints by item length with their blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        h, first = plain_words([t for _, t in items], {})
        words = [(i, h[a:b]) for (i, _), a, b in zip(items, first[:-1], first[1:]) if b > a]
        self.ids = np.array([i for i, _ in words], np.int64)
        self.length = np.array([len(h) for _, h in words], np.int64)
        grams = [np.unique(ngrams(h, min(SHINGLE, len(h)))) for _, h in words]
        n = max(1, len(words))
        flat = np.concatenate(grams) if grams else np.empty(0, _U)
        self.shingles, df = np.unique(flat, return_counts=True)
        self.weight = np.log1p(n / df)
        self.vocabulary, wdf = np.unique(np.concatenate([np.unique(h) for _, h in words]) if words else flat,
                                         return_counts=True)
        self.word_weight = np.maximum(1, np.round(8 * np.log1p(n / wdf))).astype(np.int32)
        self.rare = int(np.round(8 * np.log1p(n)))
        self.grams = [np.searchsorted(self.shingles, g) for g in grams]
        self.total = np.array([self.weight[g].sum() for g in self.grams])
        self.short = sorted({int(x) for x in self.length if x < SHINGLE})
        self.by_length: dict[int, tuple] = {}
        for m in np.unique(self.length).tolist():
            who = np.flatnonzero(self.length == m)
            prints = np.concatenate([self.fingerprints(words[w][1], np.zeros(1, np.int64), m) for w in who])
            self.by_length[m] = (who, prints, _block_values(prints), float(self.total[who].min()))
        #: the least weight of shingles that any item can do with
        self.least = min((x[3] for m, x in self.by_length.items() if m >= SHINGLE), default=np.inf)

    def places(self, h: np.ndarray, k: int) -> np.ndarray:
        """The number of the item shingle of ``k`` words that begins at each word, or -1."""
        grams = ngrams(h, k)
        out = np.full(len(h), -1, np.int64)
        if len(grams) and len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, grams), len(self.shingles) - 1)
            out[:len(grams)] = np.where(self.shingles[at] == grams, at, -1)
        return out

    def weights(self, place: np.ndarray) -> np.ndarray:
        """Running sums of the weights of the shingles at ``place``, one more than places."""
        w = np.where(place >= 0, self.weight[place], 0.0) if len(self.weight) else np.zeros(len(place))
        return np.concatenate([[0.0], np.cumsum(w)])

    def bits(self, h: np.ndarray) -> np.ndarray:
        """Running sums of the words' weighted hash bits (+ for 1, - for 0), one row more than words."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[at] == h if len(self.vocabulary) else np.zeros(len(h), bool)
        w = np.where(known, self.word_weight[at] if len(self.vocabulary) else 0, self.rare).astype(np.int32)
        on = np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
        return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(on * w[:, None], axis=0, dtype=np.int32)])

    def fingerprints(self, h: np.ndarray, starts: np.ndarray, m: int, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.bits(h) if sums is None else sums
        return np.packbits(sums[starts + m] > sums[starts], axis=1).view(_U).reshape(-1)


def _halves(prints: np.ndarray) -> np.ndarray:
    """The blocks of each fingerprint, one row per fingerprint."""
    return prints.view(f"u{8 // BLOCKS}").reshape(-1, BLOCKS)


def _block_values(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block its distinct values, and the items by value: (values, first item of each and end, items)."""
    out = []
    for block in _halves(prints).T:
        values, which = np.unique(block, return_inverse=True)
        out.append((values, np.searchsorted(np.sort(which), np.arange(len(values) + 1)), np.argsort(which, kind="stable")))
    return out


_byte_tables = _block_values  # its earlier name


def _near(prints: np.ndarray, known: np.ndarray, blocks: list, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, distance) of all pairs within the radius, each once, by window."""
    pairs = []
    for block, (values, first, items) in zip(_halves(prints).T, blocks):
        mine, which = np.unique(block, return_inverse=True)
        step = max(1, BATCH_PAIRS // len(values))
        for a in range(0, len(mine), step):
            at, value = np.nonzero(np.bitwise_count(mine[a:a + step, None] ^ values[None, :]) <= radius // BLOCKS)
            n = first[value + 1] - first[value]  # items of the value; then windows of the half
            item = items[np.repeat(first[value], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at = np.repeat(at + a, n)
            order = np.argsort(which, kind="stable")
            lo = np.searchsorted(which[order], at)
            n = np.searchsorted(which[order], at, "right") - lo
            win = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            item = np.repeat(item, n)
            ok = hamming(prints[win], known[item]) <= radius
            pairs.append(win[ok] * len(known) + item[ok])
    both = np.unique(np.concatenate(pairs))
    win, it = both // len(known), both % len(known)
    return win, it, hamming(prints[win], known[it])


def _best_window(index: Index, item: int, place: np.ndarray, starts: np.ndarray, size: int, distance: np.ndarray,
                 least: float) -> tuple | None:
    """(start, similarity, distance) of the window (of ``size`` shingles at ``place``) that holds most of an item, if it
    is above ``least`` or equal to it (ties: the first).  Windows are tried by an upper bound, the weight of the item's
    shingles in them with repeats, from running sums."""
    own, lo = index.grams[item], int(starts[0])
    there = place[lo:int(starts[-1]) + size]
    at = np.minimum(np.searchsorted(own, there), len(own) - 1)
    mine = own[at] == there
    sums = np.concatenate([[0.0], np.cumsum(np.where(mine, index.weight[own[at]], 0.0))])
    bound = (sums[starts - lo + size] - sums[starts - lo]) / index.total[item] + 1e-9
    best = None
    for i in np.lexsort((starts, -bound)).tolist():
        if bound[i] < (best[1] if best else least):
            break
        a = int(starts[i]) - lo
        got = float(index.weight[own[np.unique(at[a:a + size][mine[a:a + size]])]].sum() / index.total[item])
        if got >= least and (best is None or (-got, a) < (-best[1], best[0] - lo)):
            best = int(starts[i]), got, int(distance[i])
    return best


def scan(h: np.ndarray, place: np.ndarray, index: Index, min_similarity: float = MIN_SIMILARITY) -> list[tuple]:
    """Matches of one text, given as word hashes and the item shingles that begin there: (item id, start word, words,
    similarity, distance), the best window of each item (ties: the first).

    The text is scanned in pieces of ``PIECE`` windows, so that the running sums of hash bits do not grow with it."""
    best: dict[int, tuple] = {}
    by_k = {SHINGLE: (place, index.weights(place))}
    reach = max(index.by_length, default=0)
    for a in range(0, len(h), PIECE):
        sums = None
        for m, (who, known, blocks_, least) in index.by_length.items():
            k = min(SHINGLE, m)
            m = min(m, len(h))  # a shorter text is its own window
            if m < k:
                continue
            if k not in by_k:
                own = index.places(h, k)
                by_k[k] = own, index.weights(own)
            mine, weight = by_k[k]
            starts = np.arange(a, max(a, min(a + PIECE, len(h) - m + 1)))
            # a shingle that a window repeats counts more than once here, so the sum is at least what containment counts
            starts = starts[weight[starts + m - k + 1] - weight[starts] >= min_similarity * least - 1e-6]
            if not len(starts):
                continue
            if sums is None:
                sums = index.bits(h[a:a + PIECE + reach])
            win, it, dist = _near(index.fingerprints(h, starts - a, m, sums), known, blocks_, RADIUS)
            for i in np.unique(it).tolist():
                item, mine_of = int(who[i]), it == i
                had = best.get(item)
                got = _best_window(index, item, mine, starts[win[mine_of]], m - k + 1, dist[mine_of],
                                   had[2] if had else min_similarity)
                if got and (had is None or got[1] > had[2]):
                    best[item] = got[0], m, got[1], got[2]
    return [(int(index.ids[i]), *x) for i, x in sorted(best.items())]


def scan_all(texts: list[str | None], index: Index, cache: dict, min_similarity: float = MIN_SIMILARITY) -> list[list]:
    """Matches of each text (see :func:`scan`).  Texts are scanned if the item shingles in them weigh enough."""
    h, first = plain_words(texts, cache)
    place = index.places(h, SHINGLE)
    for back in range(1, SHINGLE):  # no shingle runs from one text into the next
        at = first[1:] - back
        place[at[at >= 0]] = -1
    weight = index.weights(place)
    enough = weight[first[1:]] - weight[first[:-1]] >= min_similarity * index.least - 1e-6
    if index.short:
        enough |= True
    return [scan(h[a:b], place[a:b], index, min_similarity) if go and b > a else []
            for a, b, go in zip(first[:-1].tolist(), first[1:].tolist(), enough.tolist())]


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = BLOCK_ITEMS) -> list:
    """The benchmark as a list of indexes of about ``size`` items, each broadcast.  Null and empty items are left out."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter(
        "i is not null and t is not null").distinct()
    n = max(1, -(-items.count() // size))
    part = F.pmod(F.xxhash64("i"), F.lit(n))
    return [spark.sparkContext.broadcast(Index(sorted((r["i"], r["t"]) for r in items.filter(part == b).collect())))
            for b in range(n)]


def matches(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY, doc_id: str = "doc_id",
            text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, start_word, n_window_words, similarity,
    distance (bits between the fingerprints), for the most similar window (ties: the first).

    Null and empty texts hold nothing; rows with a null id are reported with a null id, repeated rows each; an empty
    table on either side gives no rows; other columns are not read."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id string, item_id long, start_word long, n_window_words long, similarity double, distance long"
    out = None
    for shared in blocks(benchmark, item_id, item_text):
        def make(shared=shared):
            cache: dict = {}

            def read(pdf):
                found = scan_all(list(pdf["text"]), shared.value, cache, min_similarity)
                got = [(d, *m) for d, ms in zip(pdf["doc_id"], found) for m in ms]
                return pd.DataFrame(got, columns=["doc_id", "item_id", "start_word", "n_window_words", "similarity", "distance"])
            return read
        part = map_chunks(rows, schema, make)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def clean(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY, text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no benchmark item (see :func:`matches`)."""
    bound_batches(docs.sparkSession)
    for shared in blocks(benchmark, item_id, item_text):
        docs = docs.filter(~_holds(shared, min_similarity)(F.col(text)))
    return docs


def _holds(shared, min_similarity: float):
    @F.pandas_udf("boolean")
    def holds(t: pd.Series) -> pd.Series:
        cache: dict = {}
        return pd.Series([bool(ms) for pdf in chunks([t.to_frame("t")], "t")
                          for ms in scan_all(list(pdf["t"]), shared.value, cache, min_similarity)], dtype=bool)
    return holds
