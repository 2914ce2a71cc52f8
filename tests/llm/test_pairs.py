"""N-gram join, suffix-array and phrase dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from vigia.llm import ngram_join, phrase_dedup, repeats, suffix_dedup
from vigia.llm.common import table
from vigia.llm.repeats import find_anchors
from vigia.llm.scratch import components


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(n, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute_components(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(i for i in sets if sets[i])
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n_docs=70):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(vocab, k=r.choice([0, 1, 2, 5, 20, 60, 150]))) for _ in range(n_docs // 2)]
    while len(texts) < n_docs:
        w = r.choice(texts).split()
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(("  " if r.random() < .3 else " ").join(w).upper() if r.random() < .3 else " ".join(w))
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 90), (2, 2, 60), (3, 5, 80), (4, 1, 50), (5, 2, 70)])
def test_components_equal_brute_force(docs_of, seed, n, percent):
    rows = near_copies(seed)
    got = ngram_join.similar_components(docs_of([(i, t, None, None, 0) for i, t in rows]), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, percent)


def test_prefix_scheme_never_misses():
    """Sets that reach the threshold share l tokens of their l-prefixes, for every l and any global order."""
    r = np.random.default_rng(5)
    for _ in range(400):
        percent = int(r.integers(50, 96))
        x = r.permutation(200)[:r.integers(1, 60)]
        y = np.unique(np.concatenate([x[r.random(len(x)) < .95], r.integers(0, 200, r.integers(0, 3))]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        for lx in range(1, ngram_join.MAX_MATCHES + 1):
            for ly in range(1, ngram_join.MAX_MATCHES + 1):
                px, py = ngram_join.prefix_size(len(x), lx, percent), ngram_join.prefix_size(len(y), ly, percent)
                if px <= len(x) and py <= len(y):
                    need = ngram_join.required(len(x), len(y), lx, ly, percent)
                    assert len(np.intersect1d(np.sort(x)[:px], np.sort(y)[:py])) >= need >= min(lx, ly)


def test_prefix_adapts_to_cost():
    rare, common = np.zeros(300), np.full(300, 5000.0)
    assert ngram_join.choose_prefix(rare, 90) == 1
    assert ngram_join.choose_prefix(common, 90) > 1


def test_join_on_odd_rows(odd_docs, no_docs):
    got = ngram_join.similar_components(odd_docs, 3, 90)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and got.columns == ["doc_id", "n_shingles", "component_id"]
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 2, 3, 4, 5, 6, 6, 6, 9]
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert ngram_join.similar_components(no_docs).count() == 0


def test_one_of_each_keeps_whole_rows(odd_docs, no_docs):
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({i: 1 for i in (1, 2, 3, 4, 5, 6, 9, 10)}) + Counter({None: 2})
    assert ngram_join.one_of_each(no_docs).count() == 0


def test_a_row_goes_for_its_own_text_only(docs_of):
    a = " ".join(f"word{i}" for i in range(60))
    b = " ".join(f"other{i}" for i in range(60))
    rows = [(1, a, "en", "s", 1), (2, a + " end", "en", "s", 2), (2, b, "en", "s", 3), (3, b + " end", "en", "t", 4),
            (4, "", "en", "s", 0), (4, "", "en", "s", 0), (5, a[:50], "en", "s", 5), (5, a[:50], "en", "s", 5)]
    kept = sorted((r.doc_id, r.text) for r in ngram_join.one_of_each(docs_of(rows)).collect())
    assert kept == sorted([(1, a), (2, b), (4, ""), (4, ""), (5, a[:50])])


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[100] == got[95] == got[90] == 90


# --- bytes -----------------------------------------------------------------

def brute_bytes(texts, window):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p:p + window] for b in raw for p in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if count[b[p:p + window]] > 1:
                gone[p:p + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def mosaic(seed, letters, n_docs=25):
    r = random.Random(seed)
    parts = ["".join(r.choices(letters, k=r.randrange(3, 60))) for _ in range(12)]
    return ["".join(r.choice(parts) if r.random() < .6 else "".join(r.choices(letters, k=r.randrange(1, 40)))
                    for _ in range(r.randrange(0, 8))) for _ in range(n_docs)]


@pytest.mark.parametrize("seed,letters,window,anchor", [(1, "ab", 20, 6), (2, "abcdefé漢", 24, 8), (3, "abc", 30, 5)])
def test_repeated_bytes_equal_brute_force(docs_of, seed, letters, window, anchor):
    texts = [*mosaic(seed, letters), None, "", "a" * 200]
    rows = suffix_dedup.cut(suffix_dedup.repeated_bytes(docs_of([(i, t, None, None, 0) for i, t in enumerate(texts)]),
                                                        window, anchor))
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.collect()}
    assert got == dict(enumerate(brute_bytes(texts, window)))


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(3)
    for _ in range(30):
        texts = [bytes(r.integers(97, 99, r.integers(0, 30)).astype(np.uint8)) for _ in range(r.integers(1, 6))]
        size = np.array([len(t) for t in texts])
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        symbols = raw.astype(np.int64) + len(texts)
        symbols[begin + size] = np.arange(len(texts))
        sa, rank = suffix_dedup.suffix_array(symbols)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: symbols[i:].tolist())
        lcp = suffix_dedup.common_prefixes(raw, sa, rank, begin, begin + size, 20)
        for k in range(1, len(sa)):
            a, b = symbols[sa[k]:], symbols[sa[k - 1]:]
            same = 0
            while same < min(len(a), len(b)) and a[same] == b[same]:
                same += 1
            assert symbols[sa[k]] < len(texts) or lcp[k] == min(same, 20)


def test_shards_of_a_group_are_merged():
    """The result does not depend on how a group is cut into shards."""
    r = np.random.default_rng(8)
    texts = [bytes(r.integers(97, 99, r.integers(0, 80)).astype(np.uint8)) for _ in range(12)]
    pdf = pd.DataFrame({"n": r.integers(1, 3, 12), "key": np.arange(12), "lo": r.integers(0, 9, 12), "text": texts})
    whole = suffix_dedup.resolve_bytes(pdf, 7)
    assert whole == suffix_dedup.resolve_bytes(pdf, 7, limit=60) and any(whole)


def test_every_window_has_an_anchor_in_reach():
    r = np.random.default_rng(4)
    texts = [bytes(r.integers(97, 100, r.integers(0, 200)).astype(np.uint8)) for _ in range(20)]
    a = find_anchors(suffix_dedup.byte_units(texts, {}), 20, 6, {})
    for d, t in enumerate(texts):
        lo, hi = a["lo"][a["doc"] == d], a["hi"][a["doc"] == d]
        assert all(((lo <= p) & (hi >= p + 20)).any() for p in range(len(t) - 19))


def test_bytes_on_odd_rows(odd_docs, no_docs):
    rows = suffix_dedup.cut(suffix_dedup.repeated_bytes(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    by = {r.id: r for r in rows}
    assert (by[1].n_bytes, by[2].n_removed, by[5].n_bytes) == (0, 0, len(odd_docs.filter("doc_id = 5").first().text))
    assert by[6].n_removed == by[6].n_bytes and by[8].n_removed == by[8].n_bytes and by[7].n_spans == 1
    assert suffix_dedup.cut(suffix_dedup.repeated_bytes(no_docs)).count() == 0
    kept = suffix_dedup.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 5, 9} and not {6, 7, 8} & {r.doc_id for r in kept.collect()}


def test_cut_text_has_whole_characters(docs_of):
    shared = "éè" * 60
    kept = suffix_dedup.without_repeats(docs_of(["début " + shared + " une fin", "x" + shared + "y autre"]), 200).collect()
    for r in kept:
        assert "�" not in r.text and r.n_chars == len(r.text)


# --- phrases ---------------------------------------------------------------

def brute_phrases(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            low[k] = min(low.get(k, i), i)
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if low[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed,window", [(1, 5), (2, 13), (3, 4)])
def test_repeated_phrases_equal_brute_force(docs_of, seed, window):
    r = random.Random(seed)
    vocab = ["a", "of", "the", "wonder", "elephantine", "b,", "é", "X"]
    parts = [" ".join(r.choices(vocab, k=r.randrange(2, 30))) for _ in range(10)]
    texts = ["\n ".join(r.choice(parts) if r.random() < .6 else " ".join(r.choices(vocab, k=r.randrange(1, 20)))
                        for _ in range(r.randrange(0, 6))) for _ in range(30)]
    rows = list(enumerate([*texts, None, ""], 5))
    got = phrase_dedup.cut(phrase_dedup.repeated_phrases(docs_of([(i, t, None, None, 0) for i, t in rows]), window))
    assert {x.id: (x.n_words, x.n_removed, x.kept_sha256) for x in got.collect()} == brute_phrases(rows, window)


def test_phrases_on_odd_rows(odd_docs, no_docs):
    rows = phrase_dedup.cut(phrase_dedup.repeated_phrases(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    gone = {r.id: r.n_removed for r in rows if r.id is not None}
    assert gone[6] == 0 and gone[7] > 70 and gone[8] > 70 and gone[1] == gone[4] == 0
    assert all(r.n_removed == 0 for r in rows if r.id is None)
    assert phrase_dedup.cut(phrase_dedup.repeated_phrases(no_docs)).count() == 0


def test_registered_queries_equal_brute_force(spark, sf_small):
    from vigia.llm.queries import QUERIES
    docs = [(r.doc_id, r.text) for r in table(spark, sf_small, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in QUERIES["op2_suffix_dedup"](spark, sf_small).collect()}
    assert got == dict(zip([i for i, _ in docs], brute_bytes([t for _, t in docs], 200)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op7_phrase_dedup"](spark, sf_small).collect()}
    assert got == brute_phrases(docs, 13)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_join"](spark, sf_small).collect()}
    assert got == brute_components(docs, 3, 90)


# --- an anchor with a context in every document ------------------------------

def footers(n):
    """A footer shorter than the window in every text, with other text around it; some neighbourhoods occur twice."""
    r = random.Random(12)
    own = [[f"x{r.randrange(10**6)}" for _ in range(30)] for _ in range(n)]
    for i in range(0, n, 9):
        own[i][8:22] = own[(i + 5) % n][8:22]
    foot = "all copyrights of this common footer belong".split()
    return [" ".join(w[:15] + foot + w[15:]) for w in own]


def small_groups(monkeypatch, module, name, limit):
    """Groups of a few contexts, and an error where more than ``limit`` bytes are resolved at once."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", limit // 8)
    monkeypatch.setattr(repeats, "ANCHOR_BYTES", limit // 4, raising=False)
    resolve = getattr(module, name)

    def bounded(pdf, window):
        if pdf["text"].map(len).sum() > limit:
            raise ValueError("too many contexts at once")
        return resolve(pdf, window)
    monkeypatch.setattr(module, name, bounded)


def test_bytes_of_an_anchor_in_every_document(docs_of, monkeypatch):
    small_groups(monkeypatch, suffix_dedup, "resolve_bytes", 8_000)
    texts = footers(200)
    texts += texts[:3]
    docs = docs_of([(i, t, None, None, 0) for i, t in enumerate(texts)])
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.cut(suffix_dedup.repeated_bytes(docs, 60, 16)).collect()}
    want = dict(enumerate(brute_bytes(texts, 60)))
    assert got == want and sum(0 < x[1] < x[0] for x in want.values()) > 30


def test_phrases_of_an_anchor_in_every_document(docs_of, monkeypatch):
    small_groups(monkeypatch, phrase_dedup, "resolve_phrases", 8_000)
    texts = footers(300)
    rows = list(enumerate(texts + texts[:3], 5))
    got = phrase_dedup.cut(phrase_dedup.repeated_phrases(docs_of([(i, t, None, None, 0) for i, t in rows]), 13))
    want = brute_phrases(rows, 13)
    assert {x.id: (x.n_words, x.n_removed, x.kept_sha256) for x in got.collect()} == want
    assert sum(0 < x[1] < x[0] for x in want.values()) > 20
