"""Repeated windows: the parts that byte-wise and word-wise repeat removal share.

A window is W consecutive units (bytes or words) of one document.  To find windows that occur in more than one place
without shuffling every window, each window names one anchor: its k-gram that comes first in an order that depends on
the k-gram alone (a minimizer).  Equal windows name the same anchor at the same place, so only anchors that occur
twice can lie in repeated windows.  An anchor's context is the stretch of the windows that name it.

1. Anchors are counted (one row of two numbers per anchor goes through the shuffle, summed on the way).
2. Occurrences of the anchors that recur are kept, with the hash of their context.  Occurrences with an equal context
   form a class, in which every window around the anchor is repeated.
3. Where one anchor has several contexts, one text per class is fetched and the caller's method (suffix arrays or
   automata) tells which windows the classes share.  Classes are dealt out by anchor, so equal windows meet.
   An anchor with more context bytes than one task should hold is dealt out by context as well: each part tells its
   windows' hashes with the lowest and highest place, these are merged by hash, and the repeated ones go back.
4. The classes' spans go back to all occurrences, and from there to the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import CHUNK_BYTES, give_back, map_chunks, mix, span_hashes
from vigia.llm.scratch import save, vector_sum

#: Cells of the bit filter on documents (a power of two).
FILTER_CELLS = 1 << 22
#: Context bytes that are resolved together in one group, on average.
GROUP_BYTES = 3 << 18
#: Context bytes of one anchor beyond which its contexts are dealt to several groups, and of what is resolved at once.
ANCHOR_BYTES = 3 << 19

_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)


@dataclass
class Units:
    """The units of a chunk of documents, end to end: a hash and a rank (lower comes first in the anchor order) for
    each, the first unit of each document, and the byte at which each unit begins and ends in its document."""

    hashes: np.ndarray
    rank: np.ndarray
    first: np.ndarray  # one entry per document and one for the end
    begin: np.ndarray
    end: np.ndarray


#: Bits of the place in a sort key; longer chunks are searched in slices.
_PLACE_BITS = 21


def find_anchors(u: Units, window: int, k: int, cache: dict) -> dict[str, np.ndarray]:
    """Anchors of all windows: doc (number in the chunk), f (hash of the k-gram), c (hash of the context and of the
    anchor's place in it), lo and hi (units of the context in the document), b_lo and b_hi (its bytes)."""
    n = len(u.hashes)
    if n < window:
        return {x: np.empty(0, np.int64) for x in ("doc", "f", "c", "lo", "hi", "b_lo", "b_hi")}
    m = n - k + 1
    span = span_hashes(u.hashes, cache)
    gram = mix(span(slice(0, m), slice(k, n + 1)))
    # the order of a k-gram: its rank, then a hash; k-grams across two documents come last
    order = (u.rank[:m].astype(_U) << _U(56)) | (mix(gram) >> _U(8)) & ~_U((1 << _PLACE_BITS) - 1)
    for j in range(1, k):
        at = u.first[1:] - j
        order[at[(at >= 0) & (at < m)]] = _TOP & ~_U((1 << _PLACE_BITS) - 1)
    # starts of whole windows
    edge = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(u.first) >= window)
    np.add.at(edge, u.first[long], 1)
    np.add.at(edge, u.first[long + 1] - window + 1, -1)
    fits = np.cumsum(edge[:n]) > 0
    width, size, found, begun = window - k + 1, 1 << _PLACE_BITS, [], []
    for a in range(0, max(1, m - width + 1), size - width + 1):
        low = order[a:a + size]
        low = low | np.arange(len(low), dtype=_U)  # the first of equal k-grams wins
        step = 1
        while step * 2 <= width:
            low = np.minimum(low[:len(low) - step], low[step:])
            step *= 2
        if width > step:
            low = np.minimum(low[:len(low) - (width - step)], low[width - step:])
        starts = np.flatnonzero(fits[a:a + len(low)])
        found.append((low[starts] & _U((1 << _PLACE_BITS) - 1)).astype(np.int64) + a)
        begun.append(starts + a)
    # the windows that name one place start one after the other
    places, starts = np.concatenate(found), np.concatenate(begun)
    new = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(places) else np.empty(0, np.int64)
    where, lo = places[new], starts[new]
    hi = starts[np.append(new[1:], len(places)) - 1] + window if len(new) else lo
    d = np.searchsorted(u.first, where, side="right") - 1
    base = u.first[d]
    c = mix(span(lo, hi) + ((where - lo).astype(_U) << _U(32)) + (hi - lo).astype(_U))
    return {"doc": d, "f": gram[where].view(np.int64), "c": c.view(np.int64), "lo": lo - base, "hi": hi - base,
            "b_lo": u.begin[lo], "b_hi": u.end[hi - 1]}


def _rows_of(docs: DataFrame, units: Callable[[list, dict], Units], window: int, k: int, full: bool) -> DataFrame:
    """Anchors as rows: f and id, and with ``full`` also c, key, and the context's bounds in units and in bytes (two
    numbers below 2**31 in one long each, to keep the shuffle narrow)."""
    def make():
        cache: dict = {}

        def read(pdf):
            a = find_anchors(units(list(pdf["text"]), cache), window, k, cache)
            ids = pdf["id"].to_numpy()[a["doc"]]
            if not full:
                return pd.DataFrame({"f": a["f"], "id": ids})
            return pd.DataFrame({"f": a["f"], "id": ids, "c": a["c"], "key": pdf["key"].to_numpy()[a["doc"]],
                                 "u": (a["lo"] << 32) | a["hi"], "b": (a["b_lo"] << 32) | a["b_hi"]})
        return read
    schema = "f long, id long" + (", c long, key long, u long, b long" if full else "")
    return map_chunks(docs, schema, make, limit=CHUNK_BYTES // 2)


def _pair(column: str, lo: str, hi: str) -> list[Column]:
    """The two numbers of a packed pair."""
    return [F.shiftright(column, 32).cast("int").alias(lo), F.col(column).bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias(hi)]


def _cell(value: str | Column) -> Column:
    """The cell of the filter that a value belongs to."""
    return F.shiftrightunsigned(F.xxhash64(value), 64 - (FILTER_CELLS.bit_length() - 1))


def id_filter(ids: DataFrame, column: str = "key") -> np.ndarray:
    """Bits of a filter of fixed size over the values of ``column``."""
    cells = ids.select(_cell(column).alias("cell"))
    return np.packbits(vector_sum(cells, FILTER_CELLS, lambda: lambda pdf: pdf["cell"].to_numpy()) > 0)


def maybe_in(bits: np.ndarray, column: str | Column, spark) -> Column:
    """Whether a value may be among those of the filter; values that are among them always pass.

    The bits are a scalar subquery over one row, tested by built-in functions: no row travels to Python for it."""
    whole = spark.createDataFrame([(bytearray(bits.tobytes()),)], "bits binary").scalar()
    cell = _cell(column)
    byte = F.conv(F.hex(F.substring(whole, (F.shiftright(cell, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, (7 - cell.bitwiseAND(7)).cast("int")) == 1


def keyed(docs: DataFrame, doc_id: str, text: str, carry: bool = False) -> DataFrame:
    """(key, id, text) with the text as bytes (null: empty).  ``key`` hashes id and text, so that rows which are equal
    in both share their spans, and rows which only share an id do not.  With ``carry`` all columns of ``docs`` come
    along in the struct ``doc``."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    return docs.select(F.xxhash64(F.col(doc_id), body).alias("key"), F.col(doc_id).cast("long").alias("id"),
                       body.cast("binary").alias("text"), *whole)


def repeated_spans(docs: DataFrame, units: Callable[[list, dict], Units], window: int, k: int,
                   resolve: Callable[[pd.DataFrame], list], tally: Callable[[pd.DataFrame], pd.DataFrame],
                   locate: Callable[[pd.DataFrame, pd.DataFrame], list], earlier_only: bool) -> DataFrame:
    """(key, spans): for each key the units covered by repeated windows, as a list of structs (lo, hi).

    ``docs`` comes from :func:`keyed`.  With ``earlier_only`` a window counts as repeated in a document only if it
    starts in a document of a smaller id as well, otherwise if it starts anywhere else.  ``resolve`` gets the classes
    of a few anchors as a frame (f, c, n, id, key, lo, hi, text) and returns for each row the list of covered (lo,
    hi) units of its context.  Of an anchor with many contexts, ``tally`` gets a part and returns one row for each
    distinct window (h, low, high: its hash, lowest and highest place), and ``locate`` gets the part with the windows
    of it that have two places in all (h, low) and returns what ``resolve`` does."""
    spark = docs.sparkSession
    docs = docs.filter("id is not null") if earlier_only else docs.withColumn("id", F.lit(0).cast("long"))
    seen = _rows_of(docs, units, window, k, full=False)
    if earlier_only:
        recur = seen.groupBy("f").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
    else:
        recur = seen.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a table of its own, so that the join below has fresh exchanges and a frequent anchor's rows can be split
    recur = save(recur.select("f"), "recurring")
    found = save(_rows_of(docs, units, window, k, full=True).join(recur, "f"), "anchors")
    classes = found.groupBy("f", "c").agg(F.count(F.lit(1)).alias("n"),
                                          F.min(F.struct("id", "key", "u", "b")).alias("x"))
    classes = save(classes.select("f", "c", "n", "x.id", "x.key", *_pair("x.u", "lo", "hi"), *_pair("x.b", "b_lo", "b_hi")),
                   "classes")
    # with several contexts, unless each is repeated as a whole anyway
    mixed = classes.groupBy("f").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"),
                                     F.sum(F.col("b_hi") - F.col("b_lo")).alias("bytes"))
    mixed = mixed.filter("k > 1" if earlier_only else "k > 1 and least = 1")
    large = F.col("bytes") > ANCHOR_BYTES
    total, most = (int(x) for x in mixed.agg(*[F.coalesce(F.sum(F.when(x, F.col("bytes"))), F.lit(0))
                                               for x in (~large, large)]).first())
    # groups of whole anchors from 0 up, groups of parts of large anchors from -1 down
    salt = F.pmod(F.xxhash64("c"), F.ceil(F.col("bytes") / GROUP_BYTES))
    group = F.when(large, -1 - F.pmod(F.xxhash64("f", salt), F.lit(max(1, most // GROUP_BYTES)))).otherwise(
        F.pmod(F.xxhash64("f"), F.lit(max(1, total // GROUP_BYTES))))
    open_classes = classes.join(mixed.select("f", "bytes"), "f").withColumn("g", group.cast("int"))
    # the texts of the classes' representatives; the bit filter keeps most other documents out of the shuffle
    wanted = open_classes.groupBy("key").agg(
        F.collect_list(F.struct("g", "f", "c", "n", "id", "lo", "hi", "b_lo", "b_hi")).alias("w"))
    wanted = save(wanted, "wanted")
    bits = id_filter(wanted)
    one = docs.filter(maybe_in(bits, "key", spark)).select("key", "text").join(wanted, "key").dropDuplicates(["key"])
    pieces = one.select("key", "text", F.explode("w").alias("w")).select(
        "key", "w.g", "w.f", "w.c", "w.n", "w.id", "w.lo", "w.hi",
        F.expr("substring(text, w.b_lo + 1, w.b_hi - w.b_lo)").alias("text"))
    if most:
        pieces = save(pieces, "pieces")
    schema, limit = "f long, c long, spans array<array<int>>", ANCHOR_BYTES

    def settle(pdf):
        out = pd.concat([pd.DataFrame({"f": x["f"], "c": x["c"], "spans": resolve(x)}) for x in _by_anchor(pdf, limit)])
        give_back()
        return out
    solved = pieces.filter("g >= 0").groupBy("g").applyInPandas(settle, schema)
    if most:
        parts = pieces.filter("g < 0")

        def count(pdf):
            out = tally(pdf).assign(g=pdf["g"].iloc[0])[["h", "low", "high", "g"]]
            give_back()
            return out

        def settle_part(pdf, again):
            out = pd.DataFrame({"f": pdf["f"], "c": pdf["c"], "spans": locate(pdf, again) if len(pdf) else []})
            give_back()
            return out
        tallies = parts.groupBy("g").applyInPandas(count, "h long, low long, high long, g int")
        again = tallies.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                         F.collect_set("g").alias("gs")).filter("low < high")
        again = save(again.select("h", "low", F.explode("gs").alias("g")), "again")
        solved = solved.unionByName(parts.groupBy("g").cogroup(again.groupBy("g")).applyInPandas(settle_part, schema))
    solved = save(solved.filter(F.size("spans") > 0), "solved")
    own = classes.select("f", "c", "n", F.col("id").alias("first_id")).join(solved, ["f", "c"], "left")
    # a table of its own, so that the join with the members has fresh exchanges and a class of very many can be split
    own = save(own.filter("n > 1 or spans is not null"), "own")
    # a whole class is repeated: all its members, or all but those of the smallest id
    whole = (F.col("id") > F.col("first_id")) if earlier_only else (F.col("n") > 1)
    span = F.when(whole, F.array(F.array(F.lit(0), F.col("hi") - F.col("lo")))).otherwise(F.col("spans"))
    members = found.select("f", "c", "id", "key", *_pair("u", "lo", "hi"))
    spans = members.join(own, ["f", "c"]).select("key", F.transform(
        span, lambda s: F.struct((s[0] + F.col("lo")).alias("lo"), (s[1] + F.col("lo")).alias("hi"))).alias("s"))
    # equal rows give equal spans, which count once
    return spans.filter(F.size("s") > 0).groupBy("key").agg(F.flatten(F.collect_set("s")).alias("spans"))


def _by_anchor(pdf: pd.DataFrame, limit: int) -> list[pd.DataFrame]:
    """The rows of ``pdf`` in frames of whole anchors, each of at most ``limit`` bytes of text (or one anchor)."""
    size = pdf["text"].map(len)
    if size.sum() <= limit:
        return [pdf]
    out, held = [[]], 0
    for f, n in size.groupby(pdf["f"]).sum().items():
        if out[-1] and held + n > limit:
            out.append([])
            held = 0
        out[-1].append(f)
        held += n
    return [pdf[pdf["f"].isin(fs)].reset_index(drop=True) for fs in out]


def with_spans(docs: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` (which has ``key``) with its spans, null where there are none.  Rows that
    the bit filter rules out are not shuffled."""
    spans = save(spans, "spans")
    maybe = maybe_in(id_filter(spans), "key", docs.sparkSession)
    tagged = docs.withColumn("_maybe", maybe)
    joined = tagged.filter("_maybe").join(spans, "key", "left").select(*columns, "spans")
    rest = tagged.filter("not _maybe").select(*columns, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return joined.unionByName(rest)


def covered(spans, n: int) -> np.ndarray:
    """Mask of n units from a list of structs (lo, hi)."""
    if spans is None or len(spans) == 0:
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int32)
    lo = np.fromiter((s["lo"] for s in spans), np.int64, len(spans))
    hi = np.fromiter((s["hi"] for s in spans), np.int64, len(spans))
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0
