"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A document is parsed against every automaton: the
longest prefix of the rest that occurs in the labelled text is one phrase, then the parse goes on behind it.  A text
of the same language needs few long phrases, another language many short ones (Ziv-Merhav cross entropy).  The phrase
rate is normalised by the logarithm of the labelled text's length, and the lowest rate wins.

Automata are dense transition tables of a bounded size, sent to the tasks once.  A task parses many texts at a time:
texts are cut into blocks of ``BLOCK`` symbols, each block is a lane, and numpy steps all lanes together.  A phrase
does not cross a block's end, which adds at most one phrase per block and language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigia.llm.common import CHUNK_BYTES, bound_batches, chunks, give_back

#: Labelled texts taken per language (about; drawn by a hash of the id) and the symbols used of them.
SAMPLE_DOCS, SAMPLE_SYMBOLS = 200, 40_000
#: Symbols per lane, and distinct symbols of an alphabet.  With more letters than symbols the most frequent
#: ``SINGLE`` keep one of their own; the others are spelt with a first symbol and one (``PAIRS`` first symbols) or two
#: symbols out of ``TRAIL``, enough for all letters of Unicode.
BLOCK, MAX_ALPHABET = 512, 200
SINGLE, PAIRS, TRAIL = 92, 8, 64
UNKNOWN = "und"
#: A document with more phrases than this times its symbols, and ``SPARE`` more, resembles none of the languages: the
#: first phrases of a text are short in its own language too.
MAX_RATE, SPARE = 0.50, 4

_FLAG = 1 << 30


def normalise(text: str | None) -> str:
    """Letters in lower case, each run of anything else as one space, none at the ends."""
    return " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())


def suffix_automaton(symbols: np.ndarray) -> tuple[list[dict[int, int]], int]:
    """Transitions of the suffix automaton of one symbol sequence (state 0 is the root)."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go, len(go)


def parse_table(symbols: np.ndarray, size: int) -> np.ndarray:
    """Flat table over (state, symbol): next state times ``size``; where the phrase ends, the state that the symbol
    begins the next phrase with, plus a flag.  A symbol that the labelled text lacks is a phrase of its own: it leads
    to the last state, from which every symbol begins a phrase."""
    go, n = suffix_automaton(symbols)
    begin = np.full(size, n * size, np.int32)
    for c, t in go[0].items():
        begin[c] = t * size
    out = np.tile(begin + _FLAG, n + 1).reshape(n + 1, size)
    out[0] = begin
    for s, row in enumerate(go):
        for c, t in row.items():
            out[s, c] = t * size
    return out.reshape(-1).astype(np.int32)


def spelling(rank: int, letters: int) -> tuple[int, ...]:
    """Symbols (from 2 up) of the letter of this rank by frequency, out of ``letters``."""
    if letters <= MAX_ALPHABET or rank < SINGLE:
        return (rank + 2,)
    trail, rank = 2 + MAX_ALPHABET - TRAIL, rank - SINGLE
    if rank < PAIRS * TRAIL:
        return 2 + SINGLE + rank // TRAIL, trail + rank % TRAIL
    rank -= PAIRS * TRAIL
    return 2 + SINGLE + PAIRS + rank // TRAIL ** 2, trail + rank // TRAIL % TRAIL, trail + rank % TRAIL


class Model:
    """Alphabet and parse tables by language.  Every letter of the labelled texts has a spelling."""

    def __init__(self, texts: dict[str, list[str]], sample_symbols: int = SAMPLE_SYMBOLS):
        joined = {}
        for lang, ts in sorted(texts.items()):
            got, n = [], 0
            for t in ts:
                if n >= sample_symbols:
                    break
                t = normalise(t)
                if t:
                    got.append(t)
                    n += len(t) + 1
            if got:
                joined[lang] = " ".join(got)
        chars, counts = np.unique(np.array(list("".join(joined.values()).replace(" ", "")), dtype="U1"), return_counts=True)
        ranked = chars[np.argsort(-counts, kind="stable")].tolist()
        self.alphabet = {c: spelling(i, len(ranked)) for i, c in enumerate(ranked)}
        self.size = min(len(ranked), MAX_ALPHABET) + 2
        self.langs = list(joined)
        code = {**self.alphabet, " ": (0,)}
        self.tables, self.logs = [], []
        for lang in self.langs:
            seq = np.array([x for c in joined[lang] for x in code[c]], np.int64)
            self.tables.append(parse_table(seq, self.size))
            self.logs.append(float(np.log2(max(2, len(seq)))))

    def codes(self) -> np.ndarray:
        """First symbol of every code point (0 for what is no letter, 1 for unknown letters), and the second and third
        (0: none) where letters have them."""
        out = np.zeros((max(map(len, self.alphabet.values()), default=1), 0x110000), np.uint8)
        out[0] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
        for c, spelt in self.alphabet.items():
            out[:len(spelt), ord(c)] = spelt
        return out


def phrase_rates(texts: list[str], model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rates[text, language], number of symbols) for a batch of texts; texts without letters have 0 symbols."""
    rows = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    points = np.concatenate([x for r in rows for x in (r, np.zeros(1, np.uint32))]) if rows else np.zeros(0, np.uint32)
    sym = codes[0][points]
    if len(codes) > 1:  # letters of several symbols
        more = codes[:, points].T
        some = more > 0
        some[:, 0] = True
        owner, sym = np.repeat(owner, some.sum(axis=1)), more[some]
    # one space for each run of other characters, none before the first letter of a text
    space = sym == 0
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & (owner[1:] == owner[:-1])
    sym, owner = sym[keep], owner[keep]
    if len(sym):  # and none behind the last letter
        last = np.append(owner[1:] != owner[:-1], True)
        keep = ~(last & (sym == 0))
        sym, owner = sym[keep], owner[keep]
    n = np.bincount(owner, minlength=len(rows)).astype(np.int64)
    counts = np.zeros((len(rows), len(model.langs)))
    if len(sym) == 0 or not model.langs:
        return counts, n
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    per = -(-n // BLOCK)
    lane_doc = np.repeat(np.arange(len(rows)), per)
    nth = np.arange(len(lane_doc)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    lane_at = starts[lane_doc] + nth * BLOCK
    lane_len = np.minimum(BLOCK, n[lane_doc] - nth * BLOCK)
    order = np.argsort(-lane_len, kind="stable")
    lane_doc, lane_at, lane_len = lane_doc[order], lane_at[order], lane_len[order]
    active = np.searchsorted(-lane_len, -np.arange(BLOCK), side="left")  # lanes longer than t
    padded = np.concatenate([sym, np.zeros(BLOCK, sym.dtype)])
    steps = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, BLOCK)[lane_at].T)
    for k, table in enumerate(model.tables):
        state, phrases = np.zeros(len(lane_at), np.int32), np.ones(len(lane_at), np.int32)
        for t in range(BLOCK):
            m = active[t]
            if m == 0:
                break
            got = table.take(state[:m] + steps[t, :m])
            phrases[:m] += got >> 30
            state[:m] = got & (_FLAG - 1)
        counts[:, k] = np.bincount(lane_doc, phrases, len(rows)) * model.logs[k]
    scale = max(model.logs)
    return counts / scale / np.maximum(n, 1)[:, None], n


def learn(docs: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_docs: int = SAMPLE_DOCS, sample_symbols: int = SAMPLE_SYMBOLS) -> Model:
    """Fit a model on the labelled rows (a non-null label, and ``train`` if given).

    One aggregate counts the labelled rows of each language; a second pass draws about ``sample_docs`` whole texts of
    each by a hash of the id, in place of all of them.  The sample is bounded by ``sample_docs`` and, after that, by
    ``sample_symbols`` letters a language."""
    rows = docs if train is None else docs.filter(train)
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    per = rows.groupBy(F.col(lang).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(11)), F.lit(1 << 40))
    got = (rows.select(F.col(lang).alias("_l"), F.col(text).alias("_t"), draw.alias("_h"))
           .join(F.broadcast(per), "_l")
           # as doubles: the product of the longs overflows beyond 2**23 rows of a language
           .filter(F.col("_h").cast("double") * F.col("_n") < F.lit(float(1 << 40)) * sample_docs))
    # equal texts once; no text is cut, texts beyond the bound of symbols are not used
    got = got.groupBy("_l", "_t").agg(F.min("_h").alias("_h"))
    # the draw is small; what lies behind more than enough letters stays where it is
    before = Window.partitionBy("_l").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("_b", F.coalesce(F.sum(F.length("_t")).over(before), F.lit(0)))
    got = got.filter(F.col("_b") < 4 * sample_symbols).orderBy("_l", "_h")
    texts: dict[str, list[str]] = {}
    for r in got.toLocalIterator():
        texts.setdefault(r["_l"], []).append(r["_t"])
    return Model(texts, sample_symbols)


def _predict(texts: list[str], m: Model, codes: np.ndarray) -> pd.DataFrame:
    rates, n = phrase_rates(texts, m, codes)
    out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "rate": 0.0, "symbols": n})
    known = n > 0
    if m.langs and known.any():
        best = rates.argmin(axis=1)
        low = rates[np.arange(len(rates)), best]
        second = np.partition(rates, 1, axis=1)[:, 1] if len(m.langs) > 1 else np.full(len(rates), np.inf)
        score = np.where(np.isinf(second), 1.0, 1.0 - low / np.maximum(second, 1e-12))
        out["lang_pred"] = np.where(known, np.array(m.langs, dtype=object)[best], UNKNOWN)
        out["score"] = np.where(known, np.clip(score, 0.0, 1.0), 0.0)
        out["rate"] = np.where(known, low, 0.0)
    return out


def prediction(model: Model, spark: SparkSession, limit: int = CHUNK_BYTES):
    """Column function text -> struct (lang_pred, score, rate, symbols); see :func:`identify`."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rate double, symbols long")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        codes = m.codes()
        for batch in texts:
            parts = [_predict([t or "" for t in pdf["t"]], m, codes)
                     for pdf in chunks([batch.to_frame("t")], "t", limit)]
            yield pd.concat(parts, ignore_index=True) if parts else _predict([], m, codes)
        batch = parts = m = codes = None
        give_back()
    return predict


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, rate, symbols.

    ``lang_pred`` is the language of the lowest phrase rate (ties: first in alphabetical order); ``score`` is one
    minus the ratio of the best to the second rate (1 if there is a single language).  A null text, an empty one and
    one without letters get ``und``, score 0 and rate 0; so does every text if nothing was learned.  Repeated rows are
    predicted alike, an empty table gives no rows, other columns are not read."""
    p = prediction(model, docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), p(F.col(text)).alias("p")).select("doc_id", "p.*")


def accepted(docs: DataFrame, model: Model, text: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text resembles a language that was learned: rows without
    letters and rows with more phrases in the best language than ``max_rate`` times their symbols and ``SPARE`` go."""
    p = prediction(model, docs.sparkSession)(F.col(text))
    return docs.filter((p["lang_pred"] != UNKNOWN) & (p["rate"] * p["symbols"] <= p["symbols"] * max_rate + SPARE))
