"""The language model against a plain Katz model of dictionaries, whose probabilities must add up to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigia.llm import katz as k
from vigia.llm.queries import QUERIES


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


class Brute:
    """Probabilities of words (None: unknown, '': the end) after histories (None: the begin)."""

    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for t in texts:
            ws = [*words(t), ""]
            self.one.update(ws)
            for h, w in zip([None, *ws], ws):
                self.two[h][w] += 1
        self.n = sum(self.one.values())
        self.d1 = self.discounts(list(self.one.values()))
        self.d2 = self.discounts([c for x in self.two.values() for c in x.values()])
        self.unknown = sum((1 - self.d1(c)) * c for c in self.one.values()) / self.n if self.n else 1.0

    @staticmethod
    def discounts(counts):
        n, total = Counter(counts), sum(counts)
        for top in (5, 4, 3, 2):
            if all(n[r] for r in range(1, top + 2)):
                a = (top + 1) * n[top + 1] / n[1]
                d = {r: ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, top + 1)} if a < 1 else {}
                if d and all(0 < x < 1 for x in d.values()):
                    return lambda c: d.get(c, 1.0)
        free = n[1] / total if 0 < n[1] < total else 1 / (total + 1)
        return lambda c: 1 - free

    def lower(self, w):
        c = self.one.get(w, 0)
        return self.d1(c) * c / self.n if c else self.unknown

    def p(self, h, w):
        after = self.two.get(h)
        if not after:
            return self.lower(w)
        total, free = sum(after.values()), sum((1 - self.d2(c)) * c for c in after.values())
        if free <= 0:
            total, free = total + 1, 1.0
        if w in after:
            return self.d2(after[w]) * after[w] / total
        return free / total / (1 - sum(self.lower(x) for x in after)) * self.lower(w)

    def row(self, t):
        ws = [*words(t), ""]
        base = sum(math.log10((self.one.get(w, 0) + 0.1) / (self.n + 0.1 * (len(self.one) + 1))) for w in ws)
        return (len(ws), sum(w in self.one for w in ws), base, sum(math.log10(self.p(h, w)) for h, w in zip([None, *ws], ws)))

    def check_sums(self):
        for h in list(self.two)[:50]:
            assert sum(self.p(h, w) for w in [*self.one, "\0 never"]) == pytest.approx(1, abs=1e-9)


def prose(n, seed=0, vocabulary=300, length=60):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        w, out = 0, []
        for _ in range(r.randrange(length)):
            w = (w * 7 + int(r.paretovariate(0.8))) % vocabulary if r.random() < 0.7 else int(r.paretovariate(0.7)) % vocabulary
            out.append(f"W{w}" if r.random() < 0.1 else f"w{w}")
        texts.append(" ".join(out))
    return texts


def check(docs_of, train, texts, **options):
    brute = Brute(train)
    model = k.learn(docs_of(train).repartition(3), **options)
    assert (model.n_tokens, model.n_words) == (brute.n, len(brute.one))
    assert model.unknown == pytest.approx(brute.unknown, rel=1e-12)
    rows = {r.doc_id: r for r in k.score(docs_of(texts), model).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts, 1):
        n, known, base, score = brute.row(t)
        assert (rows[i].n_tokens, rows[i].n_known) == (n, known)
        assert rows[i].base_score == pytest.approx(base, rel=1e-11) and rows[i].score == pytest.approx(score, rel=1e-10)
    return brute, model


def test_against_brute_force(docs_of):
    train = prose(400, vocabulary=5000)
    new = prose(60, 1, vocabulary=7000) + [None, "", " \t", "never seen words here", "w1", "W1 w1 w1 never w1"]
    brute, model = check(docs_of, train, train[:40] + new)
    brute.check_sums()
    assert model.single.rest == 1 and model.double.rest == 1  # Good-Turing holds for these counts


def test_many_buckets_and_hot_histories(docs_of, monkeypatch):
    r = random.Random(4)
    train = prose(200) + ["the " + " the ".join(r.choice(["cat", "dog", f"x{i}"]) for _ in range(20)) for i in range(100)]
    monkeypatch.setattr(k, "BUCKET_TOKENS", 300)  # the texts scored are dealt over salts too
    brute, model = check(docs_of, train, train[::9] + prose(40, 7), bucket_tokens=500)
    assert model.deal.buckets > 10 and model.deal.spread.max() > 2 and len(model.deal.hot) >= 2
    brute.check_sums()


def test_history_that_frees_nothing(docs_of):
    train = prose(300) + ["alpha beta gamma"] * 20
    brute, _ = check(docs_of, train, ["alpha beta gamma", "alpha gamma", "beta alpha", "gamma"])
    assert all(c > 5 for c in brute.two["alpha"].values())
    brute.check_sums()


@pytest.mark.parametrize("train", [["a"], ["a b a b"] * 8, ["a b c"], ["", None], ["x y"] * 2 + ["z"]])
def test_small_corpora(docs_of, train):
    brute, _ = check(docs_of, train, ["a b", "", "q", None, "a a a z"])
    brute.check_sums()


def test_odd_rows(docs_of, odd_docs, no_docs):
    assert k.score(no_docs, k.learn(odd_docs)).count() == 0
    nothing = k.learn(no_docs)
    assert [(r.n_tokens, r.n_known, r.score) for r in k.score(docs_of(["a b"]), nothing).collect()] == [(3, 0, 0.0)]
    rows = odd_docs.collect()
    brute = Brute([r.text for r in rows])
    got = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in k.score(odd_docs, k.learn(odd_docs)).collect())
    assert got == Counter((r.doc_id, *brute.row(r.text)[:2], round(brute.row(r.text)[3], 6)) for r in rows)


def test_packed_arrays():
    r = np.random.default_rng(1)
    arrays = [r.integers(0, 1 << 63, 50, np.uint64), np.arange(7, dtype=np.uint32), np.empty(0, np.int64), r.random(3)]
    for a, b in zip(arrays, k.unpack(k.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()
    assert (k.undo(k.gaps(arrays[0])) == arrays[0]).all()


def test_query(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 10 == 0 for d in docs}
    brute = Brute([d.text for d in docs if not held[d.doc_id]])
    rows = {r.doc_id: r for r in QUERIES["op11_lm_scoring"](spark, sf_small).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        n, known, base, score = brute.row(d.text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d.doc_id], n, known, brute.n)
        assert r.base_score == pytest.approx(base, rel=1e-10) and r.score == pytest.approx(score, rel=1e-9)
    new = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)  # better than single words on new texts
