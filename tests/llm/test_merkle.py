"""The manifest against a plain tree built row by row."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from vigia.llm import merkle as m
from vigia.llm.queries import QUERIES


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, i):
    """Siblings to the left and right, level by level."""
    for nodes in levels[:-1]:
        a = i - i % 3
        yield nodes[a:i], nodes[i + 1:a + 3]
        i //= 3


def brute(rows, change=lambda r: r):
    """(id, leaf, subroot, root, proof, folded, verified) of rows (id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = [*climb(trees[s], i), *climb(top, at)]
            node = leaf(change(r))
            for left, right in steps:
                node = h(*left, node, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*[x for a, b in steps for x in a + b]), node,
                        node == top[-1][0]))
    return Counter(out)


def strip_odd(r):
    if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 or r[4] is None:
        return r
    return (*r[:4], r[4].replace("\n", ""))


def received():
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return {"text": F.when(F.coalesce(crc % 2 == 0, F.lit(False)), F.replace("text", F.lit("\n"), F.lit("")))
            .otherwise(F.col("text"))}


def check(docs, rows):
    got = Counter(tuple(r) for r in m.manifest(docs, received()).collect())
    assert got == brute(rows, strip_odd)


def some_rows(n, sources, ids):
    r = random.Random(n)
    return [(ids(i), r.choice(sources), r.choice(["en", None]), i % 9, r.choice(["a\nb", "plain", "", None, "ü\n" * 3]))
            for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 243, 244, 800])
def test_one_group(docs_of, n):
    rows = some_rows(n, ["s"], lambda i: 7 * i)
    check(docs_of(rows, SCHEMA).repartition(3), rows)


def test_groups_in_byte_order(docs_of):
    rows = some_rows(900, [None, "", "é", "z", "Z", "a", "aa", "\U0001F600", "￮"], lambda i: 40_000 - 31 * i)
    check(docs_of(rows, SCHEMA).repartition(4), rows)


def test_many_groups(docs_of):
    rows = [(i, f"source {i * 7919 % 1000}", "en", 1, f"t{i}") for i in range(700)]
    check(docs_of(rows, SCHEMA), rows)


def test_sparse_negative_missing_and_repeated_keys(docs_of):
    r = random.Random(5)
    ids = [None, 0, -1, -(1 << 63), (1 << 63) - 1, 511, 512, 32767, 32768] + [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    rows = some_rows(500, ["s", None], lambda i: r.choice(ids))
    rows += rows[:40] * 3  # equal rows are leaves each
    check(docs_of(rows, SCHEMA).repartition(5), rows)


def test_hot_key(docs_of):
    rows = [(77, "s", "en", 1, "copy\n")] * 400 + [(77, "s", "en", 1, f"other {i}") for i in range(300)] + some_rows(200, ["s"], int)
    check(docs_of(rows, SCHEMA).repartition(6), rows)


def test_rows_in_lower_buckets(spark):
    r = random.Random(3)
    rows = [(k, b, r.randrange(1, 5)) for k in "xy" for b in {r.randrange(-3000, 3000) for _ in range(200)}]
    got = m._before(spark.createDataFrame(rows, "k string, bucket long, n long"), wide=16).collect()
    for x in got:
        assert x.before == sum(n for k, b, n in rows if k == x.k and b < x.bucket)
        assert x.total == sum(n for k, _, n in rows if k == x.k)
    assert len(got) == len(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select(*m.FIELDS).collect()]
    check(odd_docs, rows)
    assert m.manifest(no_docs).count() == 0


def test_query(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select(*m.FIELDS).collect()]
    got = Counter(tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, sf_small).collect())
    assert got == brute(rows, strip_odd)
