"""Removal of repeated word phrases by Aho-Corasick automata.

Phrases are windows of ``window`` words.  Stretches of documents in which a phrase may recur (see ``repeats``) are
dealt to shards by anchor.  A shard confirms the phrases that occur in documents of different ids, compiles one
automaton of them with pyahocorasick (a word is one letter of the automaton), and streams the stretches through it to
locate every occurrence; a phrase's payload is the smallest document id that holds it.  The phrases of an anchor with
very many contexts are confirmed across its shards by their hashes.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import map_chunks, ngrams, split_words
from vigia.llm.repeats import Units, covered, keyed, repeated_spans, with_spans

WINDOW, ANCHOR = 13, 3


def word_units(texts: list[bytes], cache: dict) -> Units:
    """Words as units; the anchor order puts k-grams that begin with a long word first, which recur by chance less
    often than others."""
    h, begin, end, first = split_words(texts, cache)
    return Units(h, (255 - np.minimum(end - begin, 255)).astype(np.uint8), first, begin, end)


def _spell(texts: list[bytes]) -> list[str]:
    """Each text with one letter for each word."""
    letters: dict[bytes, str] = {}

    def spell(text: bytes) -> str:
        out = []
        for w in text.split():
            x = letters.get(w)
            if x is None:
                n = len(letters) + 1
                x = letters[w] = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
            out.append(x)
        return "".join(out)
    return [spell(t) for t in texts]


def resolve_phrases(pdf: pd.DataFrame, window: int = WINDOW) -> list:
    """Covered spans of each context in ``pdf`` (id, text): its windows that a context of a smaller id holds too."""
    ids = pdf["id"].tolist()
    spelt = _spell(list(pdf["text"]))
    low: dict[str, int] = {}
    twice: set[str] = set()
    for d, s in zip(ids, spelt):
        for i in range(len(s) - window + 1):
            p = s[i:i + window]
            was = low.get(p)
            if was is None:
                low[p] = d
            elif was != d:
                twice.add(p)
                if d < was:
                    low[p] = d
    return _stream(ids, spelt, {p: low[p] for p in twice}, window)


def _stream(ids: list[int], spelt: list[str], low: dict[str, int], window: int) -> list:
    """Covered spans of each spelt context: the phrases of ``low`` whose smallest id is below its own."""
    if not low:
        return [[] for _ in ids]
    automaton = ahocorasick.Automaton()
    for p, first in low.items():
        automaton.add_word(p, first)
    automaton.make_automaton()
    out = []
    for d, s in zip(ids, spelt):
        spans: list[list[int]] = []
        for end, first in automaton.iter(s):
            if first < d:
                a = end - window + 1
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = end + 1
                else:
                    spans.append([a, end + 1])
        out.append(spans)
    return out


def _phrases(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of each phrase."""
    h, _, _, first = split_words(texts, {})
    g = ngrams(h, window).view(np.int64)
    n = np.maximum(np.diff(first) - window + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return g[first[:-1][owner] + at], owner, at


def tally_phrases(pdf: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """(h, low, high) of each distinct phrase of the contexts in ``pdf`` (id, text): hash, smallest and largest id."""
    h, owner, _ = _phrases(list(pdf["text"]), window)
    rows = pd.DataFrame({"h": h, "id": pdf["id"].to_numpy()[owner]}).groupby("h")["id"]
    return rows.agg(low="min", high="max").reset_index()


def locate_phrases(pdf: pd.DataFrame, again: pd.DataFrame, window: int = WINDOW) -> list:
    """Covered spans of each context in ``pdf`` (id, text): its phrases among those of ``again`` (h, low) whose
    smallest id is below its own."""
    texts = list(pdf["text"])
    spelt = _spell(texts)
    h, owner, at = _phrases(texts, window)
    known = dict(zip(again["h"].tolist(), again["low"].tolist()))
    hit = np.flatnonzero(np.isin(h, again["h"].to_numpy()))
    low = {spelt[o][a:a + window]: known[x] for x, o, a in zip(h[hit].tolist(), owner[hit].tolist(), at[hit].tolist())}
    return _stream(pdf["id"].tolist(), spelt, low, window)


def repeated_phrases(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Every row of ``docs`` (key, id, text as bytes) with ``spans``: the words covered by a window of ``window``
    words that also starts in a document with a smaller id.

    Words are runs of anything but ASCII white space.  Null and empty texts, and texts of fewer than ``window`` words,
    have no spans.  A null id is neither smaller nor larger: such rows keep everything and repeat nothing.  Repeated
    rows have one id, so neither removes the other; an empty table gives no rows; other columns are not read."""
    rows = keyed(docs, doc_id, text)
    spans = repeated_spans(rows, word_units, window, anchor, lambda pdf: resolve_phrases(pdf, window),
                           lambda pdf: tally_phrases(pdf, window), lambda pdf, again: locate_phrases(pdf, again, window),
                           earlier_only=True)
    return with_spans(rows, spans, ["key", "id", "text"])


def cut(rows: DataFrame) -> DataFrame:
    """(key, id, kept, n_words, n_removed, kept_sha256) for rows with spans from :func:`repeated_phrases`; ``kept``
    holds the remaining words joined by one space."""
    def make():
        def read(pdf):
            out = []
            for t, s in zip(pdf["text"], pdf["spans"]):
                words = t.split()
                gone = covered(s, len(words))
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words)
                out.append((kept, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            cols = pd.DataFrame(out, columns=["kept", "n_words", "n_removed", "kept_sha256"])
            return pd.concat([pdf[["key", "id"]].reset_index(drop=True), cols], axis=1)
        return read
    schema = "key long, id string, kept binary, n_words long, n_removed long, kept_sha256 string"
    slim = rows.select("key", F.col("id").cast("string").alias("id"), "text", "spans")
    return map_chunks(slim, schema, make).withColumn("id", F.col("id").cast("long"))
