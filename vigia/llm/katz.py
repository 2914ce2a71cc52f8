"""Katz backoff language model over words: pairs of words, backing off to single words and the unknown word.

The counts are Good-Turing discounted.  What the discounts free in a history goes to the words not seen after it, in
proportion to the model below, by a backoff weight that makes the probabilities of all words (the unknown one included)
add up to one: alpha(h) = freed(h) / (1 - sum of the lower probabilities of the words seen after h).  A token's
probability is evaluated recursively: the discounted pair if it was seen, else alpha of its history times the
discounted single word if that was seen, else times the mass of the unknown word.

Counts and weights are tables with one row per bucket, and a bucket belongs to the hash of the history.  Tasks sort and
count their texts in blocks, so a pair travels once per block, packed.  Every word is a history once (the end follows
the last), so a bucket also knows the counts of its own words; buckets ask each other for the counts of the words that
follow.  A text is scored the same way: its pairs go to the buckets of their histories, pairs never seen go on to the
bucket of their word, and the sums come back to the text.

Histories that hold more than a bucket's share of all tokens are dealt to several buckets by the following word; their
totals, one row each, are put together on the driver (at most twice as many as there are buckets).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import LOWER, bound_batches, chunks, give_back, mix, size_of, split_words
from vigia.llm.scratch import save

#: Tokens counted together by one task, and tokens of the corpus per bucket.
BLOCK_TOKENS, BUCKET_TOKENS = 2_000_000, 2_000_000
#: Counts above this are not discounted (fewer, where the counts of counts do not allow it).
MOST_DISCOUNTED = 5
#: The history of a first word, and the token behind the last one.
BEGIN, END = np.uint64(0x1B0E5F3A9C2D4E71), np.uint64(0xD5A1E7C3B2946F08)
_U = np.uint64


# --- packed arrays ---------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed bytes: the first bytes of all numbers, then the second ones, and so on."""
    head = [len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))]
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.compress(np.array(head, np.int64).tobytes() + b"".join(planes), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    head = np.frombuffer(raw, np.int64, 1 + 2 * int(np.frombuffer(raw, np.int64, 1)[0]))
    out, at = [], head.nbytes
    for code, n in zip(head[1::2].tolist(), head[2::2].tolist()):
        kind = np.dtype(chr(code))
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours (the first number from zero), which sums undo in wrapping arithmetic."""
    return np.diff(a, prepend=a.dtype.type(0))


def undo(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


def runs(first: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the runs that begin at ``first`` and fill n places."""
    return np.diff(np.append(first, n))


def find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, there) of each wanted number in the ascending ``known``."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * _U(0x9E3779B97F4A7C15) + w)


# --- dealing pairs to buckets ----------------------------------------------

@dataclass
class Deal:
    """How pairs of words are dealt to buckets: by history, hot histories (ascending) to ``spread`` buckets each."""

    buckets: int
    hot: np.ndarray
    spread: np.ndarray

    def home(self, h: np.ndarray) -> np.ndarray:
        return (mix(h + _U(1)) % _U(self.buckets)).astype(np.int64)

    def bucket(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        at, hot = find(self.hot, h)
        away = np.where(hot, (mix(w + _U(2)) % self.spread[at].astype(_U)).astype(np.int64) if len(self.hot) else 0, 0)
        return (self.home(h) + away) % self.buckets


def blocks(frames: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, word hashes, number of the first word of each text and of the end) of as many texts as have ``size``
    tokens."""
    cache: dict = {}
    ids, hashes, counts, tokens = [], [], [], 0
    for pdf in chunks(frames):
        h, _, _, first = split_words([t.encode("utf-8", "ignore") if t else None for t in pdf["text"]], cache, LOWER)
        ids += list(pdf["id"])
        hashes.append(h), counts.append(np.diff(first))
        tokens += len(h) + len(pdf)
        if tokens >= size:
            yield ids, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            ids, hashes, counts, tokens = [], [], [], 0
    if ids:
        yield ids, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def pieces(h: np.ndarray, first: np.ndarray, deal: Deal, with_texts: bool) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed pairs) of one block: histories with the number of their pairs, words, the word of each pair, how
    often it occurs and, ``with_texts``, the text of each occurrence."""
    names, rank = np.unique(h, return_inverse=True)
    names = np.append(names, [END, BEGIN])
    word = np.insert(rank, first[1:], len(names) - 2)
    hist = np.insert(rank, first[:-1], len(names) - 1)
    bucket = deal.bucket(names, names)[hist]
    if len(deal.hot):
        hot = find(deal.hot, names)[1][hist]
        bucket[hot] = deal.bucket(names[hist[hot]], names[word[hot]])
    wide = len(names).bit_length()
    if 2 * wide + deal.buckets.bit_length() < 64:
        key = (bucket << (2 * wide)) | (hist << wide) | word
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
    else:
        order = np.lexsort((word, hist, bucket))
        new = np.append(True, (np.diff(word[order]) != 0) | (np.diff(hist[order]) != 0))
    at = np.flatnonzero(new)
    times = runs(at, len(order))
    b, hist, word = bucket[order[at]], hist[order[at]], word[order[at]]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first) + 1)[order] if with_texts else None
    ends = np.append(np.flatnonzero(np.diff(b)) + 1, len(b))
    lo = 0
    for hi in ends.tolist():
        if hi > lo:
            hs, start = np.unique(hist[lo:hi], return_index=True)
            ws, which = np.unique(word[lo:hi], return_inverse=True)
            arrays = [gaps(names[hs]), runs(start, hi - lo).astype(np.uint32), gaps(names[ws]), which.astype(np.uint32),
                      times[lo:hi].astype(np.uint32)]
            if with_texts:
                arrays.append(text[at[lo]:at[hi - 1] + times[hi - 1]].astype(np.uint32))
            yield int(b[lo]), pack(*arrays)
        lo = hi


def open_piece(blob: bytes) -> list[np.ndarray]:
    arrays = unpack(blob)
    arrays[0], arrays[2] = undo(arrays[0]), undo(arrays[2])
    return arrays


# --- learning --------------------------------------------------------------

@dataclass
class Discount:
    """Share of a count that is kept: ``kept[r - 1]`` for small counts r, ``rest`` beyond."""

    kept: list[float]
    rest: float = 1.0

    def of(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([1.0, *self.kept, self.rest])
        return table[np.minimum(counts, len(table) - 1).astype(np.int64)]


def discount(of_count: list[int], total: int) -> Discount:
    """Katz's Good-Turing discounts from the counts of counts (``of_count[r - 1]`` types occur r times) of ``total``
    tokens: with a = (k + 1) n[k+1] / n[1], a count r <= k keeps ((r + 1) n[r+1] / (r n[r]) - a) / (1 - a).

    k is the largest up to ``MOST_DISCOUNTED`` for which all of these lie between 0 and 1.  Where none does (small or
    odd corpora), all counts keep the same share, and what they free is the Good-Turing mass n[1] / total of unseen
    types, or one token's share where that is nothing or all."""
    n = [0, *of_count]
    for k in range(MOST_DISCOUNTED, 1, -1):
        if all(n[1:k + 2]):
            a = (k + 1) * n[k + 1] / n[1]
            kept = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)] if a < 1 else []
            if kept and all(0 < x < 1 for x in kept):
                return Discount(kept)
    free = n[1] / total if 0 < n[1] < total else 1 / (total + 1)
    return Discount([], 1 - free)


@dataclass
class Katz:
    """A model: the tables of counts and weights, and numbers of fixed size."""

    counts: DataFrame       # bucket, pairs, words
    weights: DataFrame      # bucket, weights
    deal: Deal
    size: dict[int, int]    # bucket -> training tokens
    n_bytes: int            # of the training texts
    n_texts: int
    n_tokens: int
    n_words: int            # distinct, the end included
    single: Discount
    double: Discount
    unknown: float          # probability of the unknown word
    hot_count: np.ndarray   # of the hot histories: tokens, divisor and backoff weight
    hot_total: np.ndarray
    hot_alpha: np.ndarray

    def lower(self, counts: np.ndarray) -> np.ndarray:
        """Probability of single words by count."""
        return np.where(counts > 0, self.single.of(counts) * counts / max(1, self.n_tokens), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n_tokens + 0.1 * (self.n_words + 1)))

    def far(self) -> Katz:
        """The model without its tables, for use inside tasks."""
        return Katz(None, None, *[getattr(self, f) for f in list(self.__dataclass_fields__)[2:]])


def hot_histories(docs: DataFrame, n_bytes: int, n_texts: int, share: int) -> Deal:
    """Buckets for texts of so many bytes, and the histories with more than ``share`` tokens.

    A task names the words that hold at least half a bucket's share of its tokens; a word with more than ``share``
    tokens is named for half of them at least."""
    most = n_bytes // 2 + 2 * n_texts  # tokens, at most
    least = share / (2 * max(1, most))

    def count(frames):
        for ids, h, _ in blocks(frames, BLOCK_TOKENS):
            names, n = np.unique(h, return_counts=True)
            many = n >= least * (len(h) + len(ids))
            yield pd.DataFrame({"h": np.append(names[many], END).view(np.int64), "n": np.append(n[many], len(h) + len(ids))})
        give_back()
    named = docs.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(
        (F.col("n") >= share / 2) | (F.col("h") == int(END.view(np.int64)))).collect()
    got = {_U(r["h"] & (2**64 - 1)): r["n"] for r in named}
    tokens = got.pop(END, 0)  # the row of the end holds all tokens
    got[BEGIN] = n_texts
    hot = np.array(sorted(got), _U)
    buckets = max(1, -(-tokens // share))
    return Deal(buckets, hot, np.array([min(buckets, got[h] // share + 1) for h in hot], np.int64))


def learn(docs: DataFrame, text: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> Katz:
    """Learn the model from every whole text: words are runs of anything but ASCII white space with A-Z in lower case,
    and the end of the text is a token.  Null texts are empty; repeated rows count each time; without any text every
    word is unknown; other columns are not read.  The rows are read three times."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.lit(None).cast("string").alias("id"), F.col(text).alias("text"))
    n_texts, n_bytes = size_of(docs.select(F.octet_length("text").alias("n")), ["n"])
    deal = hot_histories(docs, n_bytes, n_texts, bucket_tokens)
    small = MOST_DISCOUNTED + 1

    def scan(frames):
        for _, h, first in blocks(frames, BLOCK_TOKENS):
            for bucket, blob in pieces(h, first, deal, False):
                yield pd.DataFrame({"bucket": [bucket], "blob": [blob]})
        give_back()

    def merge(pdf):
        hs, ws, ns = [], [], []
        for blob in pdf["blob"]:
            h, m, w, which, n = open_piece(blob)
            hs.append(np.repeat(h, m)), ws.append(w[which]), ns.append(n.astype(np.int64))
        h, w, n = np.concatenate(hs), np.concatenate(ws), np.concatenate(ns)
        g = pair(h, w)
        order = np.argsort(g)
        at = np.flatnonzero(np.diff(g[order], prepend=~g[order[0]]) != 0)
        n, h, w = np.add.reduceat(n[order], at), h[order[at]], w[order[at]]
        names, rank = np.unique(w, return_inverse=True)
        order = np.lexsort((rank, h))
        n, h, rank = n[order], h[order], rank[order]
        hist, start = np.unique(h, return_index=True)
        per = np.add.reduceat(n, start)
        hot = find(deal.hot, hist)[1]
        pairs = pack(gaps(hist), runs(start, len(n)).astype(np.uint32), gaps(names), rank.astype(np.uint32), n)
        row = {"bucket": int(pdf["bucket"].iloc[0]), "pairs": pairs, "words": pack(gaps(hist[~hot]), per[~hot]),
               "tokens": int(n.sum()), "n_words": int((~hot).sum()), "word_tokens": int(per[~hot].sum()),
               "singles": np.bincount(np.minimum(per[~hot], small + 1), minlength=small + 2)[1:small + 1],
               "doubles": np.bincount(np.minimum(n, small + 1), minlength=small + 2)[1:small + 1],
               "hot": hist[hot].view(np.int64), "hot_tokens": per[hot]}
        give_back()
        return pd.DataFrame([row])

    counts = save(docs.mapInPandas(scan, "bucket int, blob binary").groupBy("bucket").applyInPandas(
        merge, "bucket int, pairs binary, words binary, tokens long, n_words long, word_tokens long, singles array<long>, "
               "doubles array<long>, hot array<long>, hot_tokens array<long>"), "katz-counts")

    size = {r["bucket"]: r["tokens"] for r in counts.select("bucket", "tokens").collect()}
    names = [(c, i) for c in ("singles", "doubles") for i in range(small)]
    got = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n_words", "word_tokens")],
                     *[F.coalesce(F.sum(F.col(c)[i]), F.lit(0)) for c, i in names]).first()
    n_words, n_tokens, singles, doubles = got[0], got[1], list(got[2:2 + small]), list(got[2 + small:])
    hot_count = np.zeros(len(deal.hot), np.int64)
    for r in counts.select(F.explode(F.arrays_zip("hot", "hot_tokens")).alias("x")).groupBy("x.hot").agg(
            F.sum("x.hot_tokens").alias("n")).collect():
        hot_count[find(deal.hot, np.array([r["hot"]], np.int64).view(_U))[0][0]] = r["n"]
    for c in [*hot_count[(deal.hot != BEGIN) & (hot_count > 0)].tolist(), *([n_texts] if n_texts else [])]:
        n_words, n_tokens = n_words + 1, n_tokens + c
        if c <= small:
            singles[c - 1] += 1
    single, double = discount(singles, n_tokens), discount(doubles, n_tokens)
    seen = np.arange(1, small + 1)
    keep = single.of(seen)
    loose = float(((1 - keep) * seen * singles).sum()) + (1 - single.rest) * (n_tokens - float((seen * singles).sum()))
    zero = np.zeros(len(deal.hot))
    model = Katz(counts, None, deal, size, n_bytes, n_texts, n_tokens, n_words, single, double,
                 loose / n_tokens if n_tokens else 1.0, hot_count, zero, zero)
    _weigh(model)
    return model


def _known_counts(model: Katz, words: np.ndarray) -> np.ndarray:
    """Counts of the end and of hot words, -1 for others."""
    at, hot = find(model.deal.hot, words)
    out = np.where(hot, model.hot_count[at] if len(model.deal.hot) else 0, -1)
    out[words == END] = model.n_texts
    return out


def _weigh(model: Katz) -> None:
    """Fill in the backoff weights: buckets ask for the counts of the words that follow their histories."""
    far, deal = model.far(), model.deal

    def ask(frames):
        for pdf in frames:
            for bucket, blob in zip(pdf["bucket"], pdf["pairs"]):
                w = undo(unpack(blob)[2])
                w = w[_known_counts(far, w) < 0]
                home = deal.home(w)
                order = np.argsort(home, kind="stable")
                ends = np.append(np.flatnonzero(np.diff(home[order])) + 1, len(w))
                lo = 0
                for hi in ends.tolist():
                    if hi > lo:
                        yield pd.DataFrame({"bucket": [int(home[order[lo]])], "back": [bucket],
                                            "blob": [pack(gaps(w[order[lo:hi]]))]})
                    lo = hi

    def answer(asked, told):
        h, n = unpack(told["words"].iloc[0])
        h = undo(h)
        out = []
        for back, blob in zip(asked["back"], asked["blob"]):
            at, there = find(h, undo(unpack(blob)[0]))
            out.append((back, pack(n[at[there]]) if there.all() else None, blob))
        return pd.DataFrame(out, columns=["bucket", "n", "blob"])

    def weigh(table, told):
        hist, m, words, which, n = unpack(table["pairs"].iloc[0])
        hist, words = undo(hist), undo(words)
        count = _known_counts(far, words)
        for c, blob in zip(told["n"], told["blob"]):
            count[find(words, undo(unpack(blob)[0]))[0]] = unpack(c)[0]
        start = np.concatenate([[0], np.cumsum(m[:-1], dtype=np.int64)])
        total = np.add.reduceat(n, start).astype(float)
        free = np.add.reduceat((1 - far.double.of(n)) * n, start)
        below = np.add.reduceat(far.lower(count)[which], start)
        hot = find(deal.hot, hist)[1]
        alpha, total[~hot] = backoff(total, free, below, far.unknown)[0], backoff(total, free, below, far.unknown)[1][~hot]
        return pd.DataFrame([{"bucket": int(table["bucket"].iloc[0]), "weights": pack(total, alpha),
                              "hot": hist[hot].view(np.int64), "free": free[hot], "below": below[hot]}])

    t = model.counts
    asked = t.select("bucket", "pairs").mapInPandas(ask, "bucket int, back int, blob binary")
    told = asked.groupBy("bucket").cogroup(t.select("bucket", "words").groupBy("bucket")).applyInPandas(
        lambda a, b: answer(a, b) if len(a) else pd.DataFrame(columns=["bucket", "n", "blob"]), "bucket int, n binary, blob binary")
    weights = save(t.select("bucket", "pairs").groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(
        weigh, "bucket int, weights binary, hot array<long>, free array<double>, below array<double>"), "katz-weights")
    model.weights = weights.select("bucket", "weights")
    free, below = np.zeros(len(deal.hot)), np.zeros(len(deal.hot))
    # added in the order of buckets: the same sums on every run
    parts = weights.select("bucket", F.explode(F.arrays_zip("hot", "free", "below")).alias("x")).select("bucket", "x.*")
    for r in sorted(parts.collect()):
        at = find(deal.hot, np.array([r["hot"]], np.int64).view(_U))[0][0]
        free[at] += r["free"]
        below[at] += r["below"]
    model.hot_alpha, model.hot_total = backoff(model.hot_count.astype(float), free, below, model.unknown)


def backoff(total: np.ndarray, free: np.ndarray, below: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, divisor) of histories with ``total`` tokens, of which the discounts free ``free``, and whose words have
    lower probabilities of ``below``.  A history that frees nothing gets one token more, which is free."""
    stiff = free <= 0
    divisor = total + stiff
    return np.where(stiff, 1.0, free) / np.maximum(divisor, 1) / np.maximum(1 - below, unknown), divisor


# --- scoring ---------------------------------------------------------------

def _sums(text: np.ndarray, score: np.ndarray, base: np.ndarray, known: np.ndarray) -> bytes:
    """Packed sums per text of values per token."""
    ids, at = np.unique(text, return_inverse=True)
    return pack(ids.astype(np.uint32), np.bincount(at, score), np.bincount(at, base), np.bincount(at, known).astype(np.uint32))


class Bucket:
    """One bucket of a model, opened."""

    def __init__(self, model: Katz, pairs: bytes | None, weights: bytes | None):
        self.model = model
        if pairs is None:
            self.hist, self.g, self.n = np.empty(0, _U), np.empty(0, _U), np.empty(0, np.int64)
            self.count, self.total, self.alpha = np.empty(0, np.int64), np.empty(0), np.empty(0)
            return
        hist, m, words, which, n = unpack(pairs)
        self.hist, words = undo(hist), undo(words)
        self.count = np.add.reduceat(n, np.concatenate([[0], np.cumsum(m[:-1], dtype=np.int64)]))
        self.total, self.alpha = unpack(weights)
        g = pair(np.repeat(self.hist, m), words[which])
        order = np.argsort(g)
        self.g, self.n = g[order], n[order]

    def histories(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, divisor, backoff weight) of histories; unknown ones have no tokens and a weight of one."""
        at, there = find(self.hist, h)
        count, total, alpha = np.zeros(len(h), np.int64), np.ones(len(h)), np.ones(len(h))
        count[there], total[there], alpha[there] = self.count[at[there]], self.total[at[there]], self.alpha[at[there]]
        at, hot = find(self.model.deal.hot, h)
        hot &= self.model.hot_count[at] > 0 if len(self.model.deal.hot) else False
        for a, b in ((count, self.model.hot_count), (total, self.model.hot_total), (alpha, self.model.hot_alpha)):
            a[hot] = b[at[hot]]
        return count, total, alpha

    def score(self, blob: bytes) -> tuple[bytes, list[tuple[int, bytes]]]:
        """Sums of a piece per text, and the tokens (by home bucket of the word) whose single word is still to score."""
        model = self.model
        hist, m, words, which, times, text = open_piece(blob)
        count, total, alpha = self.histories(hist)
        base = np.where(hist == BEGIN, 0.0, model.base(count))  # a history is the token before
        known = np.where(hist == BEGIN, 0, count > 0)
        w = words[which]
        at, seen = find(self.g, pair(np.repeat(hist, m), w))
        n = np.where(seen, self.n[at] if len(self.n) else 0, 1)
        value = np.where(seen, np.log10(model.double.of(n) * n / np.repeat(total, m)), np.repeat(np.log10(alpha), m))
        there = _known_counts(model, w)
        at_hand = ~seen & (there >= 0)
        value[at_hand] += np.log10(model.lower(there[at_hand]))
        sums = _sums(text, np.repeat(value, times), np.repeat(np.repeat(base, m), times), np.repeat(np.repeat(known, m), times))
        left = ~seen & (there < 0)
        if not left.any():
            return sums, []
        text = text[np.repeat(left, times)]
        w = np.repeat(w[left], times[left])
        home = model.deal.home(w)
        order = np.lexsort((w, home))
        home, w, text = home[order], w[order], text[order]
        out, lo = [], 0
        for hi in np.append(np.flatnonzero(np.diff(home)) + 1, len(home)).tolist():
            names, start = np.unique(w[lo:hi], return_index=True)
            out.append((int(home[lo]), pack(gaps(names), runs(start, hi - lo).astype(np.uint32), text[lo:hi])))
            lo = hi
        return sums, out


def score(docs: DataFrame, model: Katz, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens (words and the end), n_known (tokens that training held),
    base_score (single words with 0.1 added to every count), score (log10 probability of the text by the model).

    A null or empty text is its end alone; null ids and repeated rows are scored each; an empty table gives no rows;
    other columns are not read.  ``docs`` must give its rows in the same order when a task is repeated, as a stored
    table does; save what comes out of a shuffle first."""
    kind = docs.schema[doc_id].dataType.simpleString()
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    far, deal = model.far(), model.deal
    n_bytes = size_of(rows.select(F.octet_length("text").alias("n")), ["n"])[1]
    grown = n_bytes / max(1, model.n_bytes)
    salts = {b: int(n * grown / (2 * BUCKET_TOKENS)) + 1 for b, n in model.size.items()}

    def scan(frames):
        at = TaskContext.get().partitionId() << 24
        for ids, h, first in blocks(frames, BLOCK_TOKENS):
            meta = json.dumps(ids).encode()
            yield pd.DataFrame({"bucket": [at % deal.buckets], "salt": [0], "block": [at],
                                "ids": [zstandard.compress(meta)], "blob": [pack(np.diff(first) + 1)]})
            for bucket, blob in pieces(h, first, deal, True):
                yield pd.DataFrame({"bucket": [bucket], "salt": [at % salts.get(bucket, 1)], "block": [at], "ids": [None],
                                    "blob": [blob]})
            at += 1
        give_back()

    columns = ["bucket", "block", "ids", "blob"]

    def evaluate(asked, told):
        pairs, weights = (next((x for x in told[c] if x is not None), None) for c in ("pairs", "weights"))
        opened = Bucket(far, pairs, weights)
        out = []
        for block, ids, blob in zip(asked["block"], asked["ids"], asked["blob"]):
            if ids is not None:
                out.append((None, block, ids, blob))
                continue
            sums, left = opened.score(blob)
            out.append((None, block, None, sums))
            out += [(b, block, None, x) for b, x in left]
        opened = None
        give_back()
        return pd.DataFrame(out, columns=columns).astype({"bucket": "Int32"})

    def single(asked, told):
        h, n = unpack(told["words"].iloc[0]) if len(told) else (np.empty(0, _U), np.empty(0, np.int64))
        h, out = undo(h), []
        for block, blob in zip(asked["block"], asked["blob"]):
            w, times, text_no = unpack(blob)
            at, there = find(h, undo(w))
            value = np.log10(far.lower(np.where(there, n[at] if len(n) else 0, 0)))
            zero = np.zeros(len(text_no))
            out.append((block, None, _sums(text_no, np.repeat(value, times), zero, zero)))
        return pd.DataFrame(out, columns=["block", "ids", "blob"])

    end_base = float(far.base(np.array([far.n_texts]))[0])

    def finish(pdf):
        meta = pdf[pdf["ids"].notna()].iloc[0]
        ids, tokens = json.loads(zstandard.decompress(meta["ids"])), unpack(meta["blob"])[0]
        total, base, known = np.zeros(len(ids)), np.full(len(ids), end_base), np.full(len(ids), int(far.n_texts > 0))
        # added in the order of their bytes: the same sums on every run
        for blob in sorted(pdf["blob"][pdf["ids"].isna()]):
            who, a, b, c = unpack(blob)
            total[who] += a
            base[who] += b
            known[who] += c
        return pd.DataFrame({"doc_id": pd.array(ids, "string"), "n_tokens": tokens, "n_known": known, "base_score": base,
                             "score": total})

    asked = rows.mapInPandas(scan, "bucket int, salt int, block long, ids binary, blob binary")
    many = [F.lit(x) for b, s in salts.items() if s > 1 for x in (b, s - 1)]
    last = F.coalesce(F.try_element_at(F.create_map(*many), "bucket"), F.lit(0)) if many else F.lit(0)
    salt = F.explode(F.sequence(F.lit(0), last))
    null = F.lit(None).cast("binary")
    table = model.counts.select("bucket", "pairs", null.alias("weights")).unionByName(
        model.weights.select("bucket", null.alias("pairs"), "weights")).withColumn("salt", salt)
    scored = save(asked.groupBy("bucket", "salt").cogroup(table.groupBy("bucket", "salt")).applyInPandas(
        evaluate, "bucket int, block long, ids binary, blob binary"), "katz-sums")
    rest = scored.filter("bucket is not null").groupBy("bucket").cogroup(
        model.counts.select("bucket", "words").groupBy("bucket")).applyInPandas(
        lambda a, b: single(a, b) if len(a) else pd.DataFrame(columns=["block", "ids", "blob"]), "block long, ids binary, blob binary")
    parts = scored.filter("bucket is null").drop("bucket").unionByName(rest)
    out = parts.groupBy("block").applyInPandas(finish, "doc_id string, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
