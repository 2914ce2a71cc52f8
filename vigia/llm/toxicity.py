"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause.  Its words become symbols: insult and threat terms (learned stems and seeds),
targets, negators, verbs of reported speech, anything else.  Three small transducers rewrite the symbols in turn:
negation marks the terms in its scope, reported speech marks those behind a reporting verb or inside quotes, and the
target machine marks those aimed at somebody.  Their composition is one machine that reads each clause once and emits
the clause's matched patterns.  A text's evidence is the sum over its clauses of the heaviest match of each pattern;
isolated words outside the patterns score nothing.

Weights are learned from labelled texts in two steps: stems by the likelihood ratio of their document counts among
toxic and other texts, and the weight of each pattern by logistic regression around the seeds below.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import map_chunks
from vigia.llm.quality import windows_of, words_of
from vigia.llm.scratch import save
from vigia.session import materialize

#: Bound of the labelled sample, in documents of each label (drawn by a hash of the id).
SAMPLE_TOXIC, SAMPLE_OTHER = 8_000, 24_000
#: Seeds by which copies in the sample are told.
COPY_HASHES = 4
#: Lengths of the stems tried besides whole words, and the least number of toxic texts that hold a term.
STEM_LENGTHS, MIN_SUPPORT = (4, 5, 6), 3
#: Words of the grammar's closed classes and seeds of the threat class.
NEGATORS = frozenset("not no never none isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca jamás ni".split())
TARGETS = frozenset("you your you're they them he she him her these those people everyone du dich dein ihr euch sie tu toi vous ton votre ils elles tú usted ustedes ellos ellas".split())
REPORTERS = frozenset("said says say wrote writes called calls claimed reported quoted according told sagte sagt schrieb nannte dit dis écrit appelé selon dijo dice escribió llamó según".split())
THREATS = frozenset("kill killed murder hurt destroy shoot stab strangle töten umbringen erschießen tuer tuerai matar mataré".split())
THREAT_WEIGHT, MAX_WEIGHT = 3.0, 6.0

SCOPE = 3
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„]")
CLAUSE_END = re.compile(r"[.!?;\n]+")

#: Patterns and the weights that regression starts from and is drawn to.
PATTERNS = {"insult": 4.0, "insult_target": 5.0, "insult_negated": 1.5, "insult_reported": 2.0,
            "threat": 3.0, "threat_target": 5.0, "threat_negated": 1.0, "threat_reported": 1.5}
_NAMES = list(PATTERNS)


class Transducer:
    """Deterministic transducer: ``move(state, symbol) -> (state, symbol)`` over a finite set of states."""

    def __init__(self, start, move):
        self.start, self.move = start, move

    def then(self, other: Transducer) -> Transducer:
        """The composition that feeds this machine's output to ``other``."""
        def move(state, symbol):
            a, mid = self.move(state[0], symbol)
            b, out = other.move(state[1], mid)
            return (a, b), out
        return Transducer((self.start, other.start), move)

    def compiled(self, symbols: str) -> dict:
        """Transition table over all states that can be reached."""
        table, todo = {}, [self.start]
        while todo:
            s = todo.pop()
            if (s, symbols[0]) in table:
                continue
            for x in symbols:
                table[s, x] = self.move(s, x)
                todo.append(table[s, x][0])
        return table


def _negation(left, x):
    if x == "N":
        return SCOPE, "w"
    if x in "IH":
        return max(0, left - 1), (x + "n" if left else x)
    return max(0, left - 1), x


def _report(seen, x):
    if x in ("R", "Q"):
        return (not seen if x == "Q" else True), "w"
    return seen, (x + "r" if seen and x in ("I", "H") else x)


def _target(near, x):
    if x == "T":
        return SCOPE + 1, "w"
    return max(0, near - 1), (x + "t" if near and x in ("I", "H") else x)


SYMBOLS = "wIHTNRQ"
GRAMMAR = Transducer(0, _negation).then(Transducer(False, _report)).then(Transducer(0, _target))
#: Symbol of each word of a closed class; where classes share a word the later one here has it.
_CLOSED = {w: x for x, words in (("Q", "\"“”«»„"), ("R", REPORTERS), ("T", TARGETS), ("N", NEGATORS), ("H", THREATS)) for w in words}
_EMIT = {"I": 0, "It": 1, "In": 2, "Ir": 3, "H": 4, "Ht": 5, "Hn": 6, "Hr": 7}


class Scorer:
    """Reads texts with a lexicon (term -> (weight, whole word?)) and pattern weights."""

    def __init__(self, terms: dict[str, tuple[float, bool]], bias: float, weights: list[float]):
        self.bias, self.weights = bias, np.array(weights)
        self.whole = {t: w for t, (w, whole) in terms.items() if whole}
        self.stems = {t: w for t, (w, whole) in terms.items() if not whole}
        self.lengths = sorted({len(t) for t in self.stems})
        self.table, self.start = GRAMMAR.compiled(SYMBOLS), GRAMMAR.start
        self.find = ahocorasick.Automaton()
        for t in {*self.whole, *self.stems, *THREATS}:
            self.find.add_word(t, len(t))
        self.find.make_automaton()

    def term(self, word: str) -> float:
        """Weight of an insult term, 0 for other words."""
        best = self.whole.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def clause(self, clause: str) -> list[float]:
        """Heaviest match of each pattern in one clause."""
        out, state = [0.0] * len(_NAMES), self.start
        for word in WORD.findall(clause):
            weight = self.term(word)
            x = "I" if weight else _CLOSED.get(word, "w")
            state, mark = self.table[state, x]
            k = _EMIT.get(mark)
            if k is not None:
                out[k] = max(out[k], weight or THREAT_WEIGHT)
        return out

    def evidence(self, text: str | None) -> np.ndarray:
        """Sum over the clauses of the whole text.  Clauses without a term are not parsed: they match no pattern."""
        total = [0.0] * len(_NAMES)
        if not text:
            return np.array(total)
        low, done = text.lower(), 0
        for end, n in self.find.iter(low):
            at = end - n + 1
            if at < done or (at and low[at - 1].isalpha()):
                continue
            # a clause begins after the last one read, so no letter is searched twice
            a = max(done, max(low.rfind(c, done, at) for c in ".!?;\n") + 1)
            m = CLAUSE_END.search(low, at)
            done = m.start() if m else len(low)
            total = [x + y for x, y in zip(total, self.clause(low[a:done]))]
        return np.array(total)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.bias + saturate(evidence) @ self.weights, -30, 30)))


def saturate(evidence: np.ndarray) -> np.ndarray:
    """Evidence of a pattern in 0..1, so that long texts do not outweigh short ones."""
    return 1.0 - np.exp(-evidence / 3.0)


def _fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 30) -> tuple[float, list[float]]:
    """Logistic regression by Newton steps, drawn to the seed weights with strength ``pull``; the bias starts at the
    odds of the labels."""
    rate = min(max(y.mean(), 1e-3), 0.5) if len(y) else 0.1
    seed = np.array([math.log(rate / (1 - rate)) - 1.0, *PATTERNS.values()])
    w, design = seed.copy(), np.column_stack([np.ones(len(y)), x])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + pull * (w - seed)
        hess = (design * (p * (1 - p))[:, None]).T @ design + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), [max(0.0, float(v)) for v in w[1:]]


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str) -> DataFrame:
    """Texts and labels (y) of a bounded sample of the labelled rows."""
    marks = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_d")).agg(
        F.max(F.col(toxic).cast("int")).alias("y"))
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("_d").cast("string"), F.lit(13)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.when(F.col("y") == 1, F.lit(SAMPLE_TOXIC / max(n.get(1, 0), 1))).otherwise(
        F.lit(SAMPLE_OTHER / max(sum(n.values()) - n.get(1, 0), 1)))
    few = F.broadcast(marks.filter(draw < part))  # at most about the two bounds together
    rows = docs.select(F.col(doc_id).alias("_d"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(few, "_d")
    return save(_without_copies(save(rows, "labelled")), "labelled")


def _stems(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.char_length(w) >= n), lambda w: F.substring(w, 1, n))


def _without_copies(rows: DataFrame) -> DataFrame:
    """The sampled texts less copies and most near copies, whose words would look like evidence from many texts: of
    the texts that share the smallest hash of their 3-word windows under one of ``COPY_HASHES`` seeds, one stays."""
    windows = windows_of(words_of(F.col("text")))
    sigs = [F.array_min(F.transform(windows, _seeded(k))) for k in range(COPY_HASHES)]
    left = materialize(rows.select("_d", F.array(*sigs).alias("sig"), F.xxhash64("text").alias("h")))
    for k in range(COPY_HASHES):
        own = F.coalesce(F.get("sig", F.lit(k)), F.col("h"))
        left = left.groupBy(own.alias("g")).agg(F.min(F.struct("_d", "sig", "h")).alias("x")).select("x.*")
    return rows.join(F.broadcast(left.select("_d")), "_d")


def _seeded(k: int):
    return lambda x: F.xxhash64(x, F.lit(k))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          toxic: str = "toxic") -> Scorer:
    """Fit the grammar's lexicon and weights on a bounded sample of ``labels`` (which the caller has restricted to
    the rows that may be learned from).  Without toxic rows the lexicon is empty and only the seeds act."""
    rows = _sample(docs, labels, doc_id, text, toxic)
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.char_length(w) >= min(STEM_LENGTHS))
    # a term is a stem (first letters) or a whole word (marked by a closing =), counted once a text
    stems = [_stems(F.col("w"), n) for n in STEM_LENGTHS]
    terms = F.array_distinct(F.concat(F.transform("w", lambda w: F.concat(w, F.lit("="))), *stems))
    counts = (rows.select("y", F.array_distinct(words).alias("w")).select("y", F.explode(terms).alias("term"))
              .groupBy("term").agg(F.sum(F.col("y").cast("long")).alias("n1"),
                                   F.sum(F.lit(1) - F.col("y")).cast("long").alias("n0"))
              .filter(F.col("n1") >= MIN_SUPPORT))
    size = rows.agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = int(size["n1"] or 0), int((size["n"] or 0) - (size["n1"] or 0))
    lexicon = _lexicon(counts, n1, n0)
    first = Scorer(lexicon, 0.0, [0.0] * len(_NAMES))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        reader = Scorer(shared.value, 0.0, [0.0] * len(_NAMES))

        def read(pdf):
            out = pd.DataFrame([reader.evidence(t) for t in pdf["text"]], columns=_NAMES)
            out["y"] = pdf["y"].to_numpy()
            return out
        return read
    schema = ", ".join(f"{k} double" for k in _NAMES) + ", y int"
    got = map_chunks(rows.select("text", "y"), schema, make)
    got = got.groupBy(*_NAMES, "y").agg(F.count(F.lit(1)).alias("n")).toPandas()  # bounded by the sample
    got = got.loc[got.index.repeat(got["n"])]
    bias, weights = _fit(saturate(got[_NAMES].to_numpy(float)), got["y"].to_numpy(float))
    first.bias, first.weights = bias, np.array(weights)
    return first


def _lexicon(counts: DataFrame, n1: int, n0: int) -> dict[str, tuple[float, bool]]:
    """Terms whose counts among toxic texts cannot be chance: the likelihood ratio of the counts is above twice the
    logarithm of the number of terms tried, so that less than one chance term is expected.  Heavier terms come first,
    then shorter ones: a stem stands for all its extensions, unless a heavier extension holds most of its texts.  All
    such terms are kept; their number is bounded by the words of the bounded sample."""
    if not n1 or not n0:
        return {}
    tried = max(2, counts.count())
    share = n1 / (n1 + n0)
    a, b = F.col("n1"), F.col("n0")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    weight = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    rows = counts.select("term", "n1", ratio.alias("g"), weight.alias("weight")).filter(
        (F.col("g") > 2 * math.log(tried)) & (F.col("weight") > 3.0)).collect()
    out: dict[str, tuple[float, bool]] = {}
    held: dict[str, int] = {}  # the most texts of a kept term, for each beginning of the term
    top = lambda r: min(float(r["weight"]), MAX_WEIGHT)
    for r in sorted(rows, key=lambda r: (-top(r), len(r["term"]), r["term"])):
        whole = r["term"].endswith("=")
        t = r["term"].rstrip("=")
        covered = any(t[:n] in out and not out[t[:n]][1] for n in range(1, len(t) + 1))
        if not covered and held.get(t, 0) < 0.8 * r["n1"]:
            out[t] = (top(r), whole)
            for n in range(1, len(t) + 1):
                held[t[:n]] = max(held.get(t[:n], 0), int(r["n1"]))
    return out


def score(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1) and the evidence of each pattern.

    Null and empty texts have no evidence and the score of the bias alone; repeated rows score alike; an empty table
    gives no rows; other columns are not read."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(scorer_parts(scorer))

    def make():
        reader = Scorer(*shared.value)

        def read(pdf):
            ev = np.array([reader.evidence(t) for t in pdf["text"]]).reshape(len(pdf), len(_NAMES))
            out = pd.DataFrame(ev, columns=_NAMES)
            out.insert(0, "score", reader.score(ev))
            out.insert(0, "doc_id", pdf["doc_id"])
            return out
        return read
    schema = "doc_id string, score double, " + ", ".join(f"{k} double" for k in _NAMES)
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return map_chunks(rows, schema, make).withColumn("doc_id", F.col("doc_id").cast(kind))


def scorer_parts(s: Scorer) -> tuple[dict, float, list[float]]:
    terms = {**{t: (w, False) for t, w in s.stems.items()}, **{t: (w, True) for t, w in s.whole.items()}}
    return terms, s.bias, s.weights.tolist()
