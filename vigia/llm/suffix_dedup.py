"""Removal of long repeated byte strings by suffix arrays.

Candidate stretches (see ``repeats``) are dealt to shards.  Each shard concatenates its stretches and builds a suffix
array by prefix doubling (Larsson-Sadakane refinement, in numpy), then the longest common prefixes of neighbouring
suffixes by Kasai's method, all stretches in step.  Neighbours that share at least ``window`` bytes form a run: one
repeated string and all its places in the shard.  Runs of different shards of one group are merged by binary search
of their string hashes, those of a large anchor's groups by a shuffle of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import BYTE_CODES, map_chunks, mix
from vigia.llm.repeats import Units, covered, keyed, repeated_spans, with_spans

WINDOW, ANCHOR = 200, 32
#: Symbols of one shard's suffix array: positions and two ranks share a 63-bit sort key.
SHARD_SYMBOLS = 1 << 20

_U = np.uint64


def byte_units(texts: list[bytes], cache: dict) -> Units:
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.arange(len(raw)) - np.repeat(first[:-1], size)
    return Units(BYTE_CODES[raw], np.zeros(len(raw), np.uint8), first, at, at + 1)


#: Bits of a position, of a symbol, and of a rank in a sort key.
_BITS, _SYMBOL_BITS = 21, 14


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks.  Symbols are integers below 2**14; ends of stretches carry distinct symbols, so that no
    two suffixes are equal.  At most 2**21 - 1 symbols.

    A rank is the place at which a suffix's group of equal prefixes begins.  Each round doubles the prefix: a group is
    sorted by the ranks that its suffixes have one prefix further on, and suffixes alone in their group are done."""
    n = len(symbols)
    index = np.arange(n, dtype=np.int64)
    if n == 0:
        return index, index
    mask = (1 << _BITS) - 1
    two = np.concatenate([symbols[1:], [0]]).astype(np.int64) + 1
    key = np.sort((((symbols.astype(np.int64) + 1) << _SYMBOL_BITS | two) << _BITS) | index)
    h, group = 2, np.zeros(n, np.int64)
    rank, todo = np.empty(n, np.int64), np.ones(n, bool)
    while True:
        who, pair = key & mask, key >> _BITS
        place = index[:len(who)]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        border = np.concatenate([[True], group[1:] != group[:-1]])
        run = np.maximum.accumulate(np.where(new, place, 0))
        run -= np.maximum.accumulate(np.where(border, place, 0))
        rank[who] = group + run
        todo[who[new & np.append(new[1:], True)]] = False
        left = np.flatnonzero(todo)
        if not len(left):
            sa = np.empty(n, np.int64)
            sa[rank] = index
            return sa, rank
        ahead = np.concatenate([rank[h:] + 1, np.zeros(min(h, n), np.int64)])[:n]
        key = np.sort((rank[left] << 2 * _BITS) | (ahead[left] << _BITS) | left)
        group = key >> 2 * _BITS
        h *= 2


def common_prefixes(raw: np.ndarray, sa: np.ndarray, rank: np.ndarray, begin: np.ndarray, stop: np.ndarray,
                    cap: int) -> np.ndarray:
    """Kasai's longest common prefix of each suffix with its predecessor, up to ``cap``, in array order.

    ``begin`` and ``stop`` bound the stretches; a prefix ends with its stretch.  Each stretch is a lane: from one
    position to the next the prefix falls by at most one, and all lanes move together, eight bytes at a time."""
    n = len(raw)
    lcp = np.zeros(n, np.int32)
    if not len(begin):
        return lcp
    room = np.repeat(stop, stop - begin + 1) - np.arange(n)  # bytes to the end of the stretch
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n, 8), (1, 1)).copy().view(_U).reshape(-1)
    size = stop - begin
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    length = np.zeros(len(begin), np.int64)
    for step in range(int(size[0])):
        m = int(np.searchsorted(-size, -step, side="left"))
        i = begin[:m] + step
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        most = np.minimum(np.minimum(room[i], room[j]), cap)
        most[r == 0] = 0
        l = np.minimum(np.maximum(length[:m] - 1, 0), most)
        active = np.flatnonzero(l < most)
        while len(active):
            at = l[active]
            diff = words[i[active] + at] ^ words[j[active] + at]
            low = diff & (~diff + _U(1))  # lowest bit that differs
            same = np.where(diff == 0, 8, np.log2(np.maximum(low, _U(1)).astype(np.float64)).astype(np.int64) >> 3)
            l[active] = np.minimum(at + same, most[active])
            active = active[(same == 8) & (l[active] < most[active])]
        length[:m] = l
        lcp[r] = l
    return lcp


def _window_hashes(raw: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` bytes from each position."""
    h, width, out, done = BYTE_CODES[raw], 1, None, 0
    parts = []
    while width <= window:
        if window & width:
            parts.append((h, width))
        if width * 2 > window:
            break
        p = _U(pow(0x9E3779B97F4A7C15, width, 1 << 64))
        h = h[:len(h) - width] * p + h[width:]
        width *= 2
    for h, width in parts:
        if out is None:
            out, done = h, width
        else:
            p = _U(pow(0x9E3779B97F4A7C15, width, 1 << 64))
            m = min(len(out), len(h) - done)
            out, done = out[:m] * p + h[done:done + m], done + width
    return mix(out)


def _shard_runs(texts: list[bytes], many: np.ndarray, place: np.ndarray, window: int, hashed: bool):
    """Runs of one shard: the run of each position (-1 where no whole window begins), the stretches, and for each run
    its string's hash, whether a whole class repeats it, and its lowest and highest place."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    stop = begin + size
    symbols = raw.astype(np.int64) + len(texts)
    symbols[stop] = np.arange(len(texts))
    sa, rank = suffix_array(symbols)
    lcp = common_prefixes(raw, sa, rank, begin, stop, window)
    lcp = lcp < window
    head = np.cumsum(lcp, dtype=np.int32) - 1  # run of each place in the array
    # whole windows, and the runs that hold one, numbered anew
    pos = np.concatenate([np.arange(b, e - window + 1) for b, e in zip(begin.tolist(), stop.tolist())])
    which, r = np.unique(head[rank[pos]], return_inverse=True)
    n = len(which)
    run = np.full(len(raw), -1, np.int32)
    run[pos] = r
    owner = np.searchsorted(begin, pos, side="right") - 1
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    where = place[owner] + pos - begin[owner]
    np.minimum.at(low, r, where)
    np.maximum.at(high, r, where)
    twice = np.zeros(n, bool)
    twice[r[many[owner]]] = True
    keys = np.zeros(n, _U)
    if hashed and n:
        keys[r] = _window_hashes(raw, window)[pos]
    return run, begin, size, keys, twice, low, high


def resolve_bytes(pdf: pd.DataFrame, window: int = WINDOW, limit: int = SHARD_SYMBOLS) -> list:
    """Covered spans of each context in ``pdf`` (n, key, lo, text): the windows that occur at another place."""
    texts = list(pdf["text"])
    many = pdf["n"].to_numpy() > 1
    # places of one document never meet those of another: documents are numbered within the group
    number = np.unique(pdf["key"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    place = (number << 36) + pdf["lo"].to_numpy().astype(np.int64)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    cut = np.cumsum(size) // limit
    shards = [np.flatnonzero(cut == x) for x in np.unique(cut)]
    runs = [_shard_runs([texts[i] for i in s], many[s], place[s], window, len(shards) > 1) for s in shards]
    repeated = [twice | (low != high) for *_, twice, low, high in runs]
    order = [np.argsort(x[3], kind="stable") for x in runs] if len(runs) > 1 else []
    for a, (_, _, _, keys, _, low, high) in enumerate(runs):
        for b, by in enumerate(order):
            own, twice_b, low_b, high_b = runs[b][3][by], runs[b][4], runs[b][5], runs[b][6]
            if a == b or not len(own):
                continue
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            other = by[at]
            repeated[a] |= (own[at] == keys) & (twice_b[other] | (low_b[other] != low) | (high_b[other] != high))
    out: list = [None] * len(texts)
    for s, (run, begin, size_, *_), again in zip(shards, runs, repeated):
        hit = (run >= 0) & np.append(again, False)[run]
        for i, b, n in zip(s.tolist(), begin.tolist(), size_.tolist()):
            out[i] = _spans(hit[b:b + n], window)
    return out


def _spans(hit: np.ndarray, window: int) -> list[list[int]]:
    """The bytes covered by the windows that begin where ``hit`` is set."""
    starts = np.flatnonzero(hit)
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window) + 1
    return [[int(p[0]), int(p[-1]) + window] for p in np.split(starts, breaks)]


def tally_bytes(pdf: pd.DataFrame, window: int = WINDOW, limit: int = SHARD_SYMBOLS) -> pd.DataFrame:
    """(h, low, high) of each distinct window of the contexts in ``pdf`` (n, key, lo, text).  A place is a hash of the
    document and the window's start; a window of a class with several members has the least and the greatest place."""
    texts = list(pdf["text"])
    many = pdf["n"].to_numpy() > 1
    key, lo = pdf["key"].to_numpy().view(_U), pdf["lo"].to_numpy().astype(_U)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    cut, out, ends = np.cumsum(size) // limit, [], np.iinfo(np.int64)
    for x in np.unique(cut):
        s = np.flatnonzero(cut == x)
        run, begin, _, keys, twice, *_ = _shard_runs([texts[i] for i in s], many[s], np.zeros(len(s), np.int64), window, True)
        pos = np.flatnonzero(run >= 0)
        owner = np.searchsorted(begin, pos, side="right") - 1
        at = mix(mix(key[s])[owner] + lo[s][owner] + (pos - begin[owner]).astype(_U)).view(np.int64)
        low, high = np.full(len(keys), ends.max), np.full(len(keys), ends.min)
        np.minimum.at(low, run[pos], at)
        np.maximum.at(high, run[pos], at)
        low[twice], high[twice] = ends.min, ends.max
        out.append(pd.DataFrame({"h": keys.view(np.int64), "low": low, "high": high}))
    return pd.concat(out, ignore_index=True)


def locate_bytes(pdf: pd.DataFrame, again: pd.DataFrame, window: int = WINDOW) -> list:
    """Covered spans of each context in ``pdf`` (text): its windows whose hash is in ``again`` (h)."""
    texts = list(pdf["text"])
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(size)])
    hit = np.isin(_window_hashes(np.frombuffer(b"".join(texts), np.uint8), window).view(np.int64), again["h"].to_numpy())
    # no window runs from one context into the next
    return [_spans(hit[b:b + n - window + 1], window) for b, n in zip(begin.tolist(), size.tolist())]


def repeated_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, doc_id: str = "doc_id",
                   text: str = "text", carry: bool = False) -> DataFrame:
    """Every row of ``docs`` (key, id, text as bytes) with ``spans``: the bytes covered by a ``window``-byte string
    that also starts anywhere else, in this document or another.  With ``carry`` the struct ``doc`` holds the whole row.

    Null and empty texts, and texts shorter than ``window``, have no spans.  Repeated rows are separate documents, so
    all of a repeated row of ``window`` bytes or more is covered; null ids are ids like others; an empty table gives
    no rows; other columns are not read."""
    rows = keyed(docs, doc_id, text)
    spans = repeated_spans(rows, byte_units, window, anchor, lambda pdf: resolve_bytes(pdf, window),
                           lambda pdf: tally_bytes(pdf, window), lambda pdf, again: locate_bytes(pdf, again, window),
                           earlier_only=False)
    return with_spans(keyed(docs, doc_id, text, carry), spans, ["key", "id", "text", *(["doc"] if carry else [])])


def _remaining():
    @F.pandas_udf("string")
    def remaining(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            gone = covered(s, len(t))
            # a character that loses some of its bytes goes whole
            out.append(np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)
    return remaining


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, doc_id: str = "doc_id",
                    text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, with all their columns, less the repeated bytes (see :func:`repeated_bytes`).  Where bytes
    go, ``n_chars`` (if there is such a column) is counted again; rows of which nothing is left but white space go,
    rows that lose nothing stay as they are."""
    rows = repeated_bytes(docs, window, anchor, doc_id, text, carry=True)
    same = rows.filter("spans is null").select("doc.*")
    less = rows.filter("spans is not null").select("doc", _remaining()("text", "spans").alias("left")).filter(
        F.regexp_replace("left", r"\s+", "") != "")
    fixed = {text: F.col("left"), n_chars: F.char_length("left").cast("long")}
    return same.unionByName(less.select(*[fixed[c].alias(c) if c in fixed else F.col(f"doc.`{c}`").alias(c)
                                          for c in docs.columns]))


def cut(rows: DataFrame) -> DataFrame:
    """(key, id, kept, n_bytes, n_removed, n_spans) for rows with spans from :func:`repeated_bytes`; ``kept`` holds the
    remaining bytes in order, and a span is a maximal removed run."""
    def make():
        def read(pdf):
            out = []
            for t, s in zip(pdf["text"], pdf["spans"]):
                gone = covered(s, len(t))
                kept = t if not gone.any() else np.frombuffer(t, np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                out.append((kept, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
            cols = pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            return pd.concat([pdf[["key", "id"]].reset_index(drop=True), cols], axis=1)
        return read
    schema = "key long, id string, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    slim = rows.select("key", F.col("id").cast("string").alias("id"), "text", "spans")
    return map_chunks(slim, schema, make).withColumn("id", F.col("id").cast("long"))
