"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word n-grams reaches a threshold.  Tokens (n-gram
hashes) have one global order, rarest first by an estimated document frequency.  Of a set with n tokens, the first
``n - ceil(t n) + l`` in that order are its l-prefix; two sets that link share at least l tokens of their l-prefixes.
Each document picks the l whose prefix promises the least work: the postings read plus the estimated candidates, which
fall as more shared tokens are required.  For a pair of sizes n, m that links, the overlap is at least
``t (n + m) / (1 + t)``, and a prefix leaves out ``ceil(t n) - l`` tokens; so their prefixes share at least the overlap
less the larger of the two remainders (:func:`required`), which is l or more.

Steps
1. Sets that are equal are one class from the start, so exact copies are never compared.
2. Frequencies come from a count sketch of a fixed size over all documents (it orders tokens; it decides no link).
3. Leader rounds: each class is verified against the one class it shares most leading tokens with, if they are
   enough, where a token's leader is the class with the most frequent tokens, which is the centre of a group of near
   copies.  Verified links give components.
4. Remaining candidates are pairs in different components that share enough prefix tokens; all that were not compared
   yet are verified.  Pairs inside a component need not be: their links cannot change it.  So a group of k near copies
   costs about k verifications, not k * k.
5. Components of all verified links.

Verification compares whole sets exactly and is dealt out by leader, split into parts of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import CHUNK_BYTES, give_back, map_chunks, shingle_sets
from vigia.llm.repeats import id_filter, maybe_in
from vigia.llm.scratch import components, save, vector_sum

#: Cells of the frequency sketch (a power of two).
SKETCH_CELLS = 1 << 20
#: Largest l, and the cost of verifying a candidate in units of reading a posting.
MAX_MATCHES, VERIFY_COST = 6, 30.0
#: Members of one leader that are verified in one group.
GROUP_MEMBERS = 256
#: Rounds of leaders before the remaining pairs are listed.
LEADER_ROUNDS = 1

_U = np.uint64


def prefix_size(n: int, matches: int, percent: int) -> int:
    """Length of the prefix in which linked sets share ``matches`` tokens."""
    return n - (-(-n * percent // 100)) + matches


def required(n: int, m: int, ln: int, lm: int, percent: int) -> int:
    """Prefix tokens that two sets of n and m tokens with ``ln`` and ``lm`` share at least if they link."""
    overlap = -(-percent * (n + m) // (100 + percent))
    return max(1, overlap - max(-(-n * percent // 100) - ln, -(-m * percent // 100) - lm))


def _required(a: str, b: str, la: str, lb: str, percent: int) -> Column:
    """:func:`required` of columns."""
    part = lambda n, l: F.ceil(F.col(n) * percent / 100) - F.col(l)
    overlap = F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent))
    return F.greatest(F.lit(1), overlap - F.greatest(part(a, la), part(b, lb)))


def choose_prefix(freq: np.ndarray, percent: int, max_matches: int = MAX_MATCHES) -> int:
    """The l of least estimated cost for a set whose tokens, in global order, have these frequencies."""
    n = len(freq)
    total = np.cumsum(freq)
    best, best_cost = 1, None
    for l in range(1, max_matches + 1):
        p = prefix_size(n, l, percent)
        if p > n:
            break
        postings = float(total[p - 1])
        cost = postings + VERIFY_COST * postings / l  # at most postings / l others can share l tokens
        cost += p  # what the prefix itself adds
        if best_cost is None or cost < best_cost:
            best, best_cost = l, cost
    return best


def _class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - (1 << 63)


def _classes(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, cls, text_hash) of every row."""
    def make():
        cache: dict = {}

        def read(pdf):
            sets = shingle_sets(list(pdf["text"]), n, cache)
            return pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": [len(s) for s in sets],
                                 "cls": [_class_of(s) if len(s) else 0 for s in sets], "text_hash": pdf["text_hash"]})
        return read
    return map_chunks(rows.withColumn("text_hash", F.xxhash64("text")),
                      "doc_id string, n_shingles long, cls long, text_hash long", make)


def _sketch(rows: DataFrame, n: int) -> np.ndarray:
    def make():
        cache: dict = {}

        def read(pdf):
            parts = shingle_sets(list(pdf["text"]), n, cache)
            return (np.concatenate(parts) >> _U(64 - (SKETCH_CELLS.bit_length() - 1))).astype(np.int64)
        return read
    return vector_sum(rows, SKETCH_CELLS, make, "text", CHUNK_BYTES)


def _postings(rows: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(token, cls, size, pcm) for the prefix tokens of every document: pcm holds the token's place in the prefix, how
    frequent the set's tokens are (thousandths), and its l."""
    shift = _U(64 - (SKETCH_CELLS.bit_length() - 1))
    # what other tokens add to a cell, on average; only the order and the estimated cost depend on it
    noise = float(np.median(sketch))
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def make():
        cache: dict = {}
        est = shared.value

        def read(pdf):
            out = []
            for s in shingle_sets(list(pdf["text"]), n, cache):
                if not len(s):
                    continue
                f = est[(s >> shift).astype(np.int64)]
                order = np.lexsort((s, f))
                freq = np.maximum(f[order] - noise, 0.0)
                l = choose_prefix(freq, percent)
                p = prefix_size(len(s), l, percent)
                centre = min(32_000, round(1000 * float(np.log1p(freq).mean())))
                out.append((s[order[:p]], _class_of(s), len(s), centre << 8 | l))
            k = [len(x[0]) for x in out]
            if not out:
                return pd.DataFrame({"token": [], "cls": [], "size": [], "pcm": []}).astype("int64")
            return pd.DataFrame({
                "token": np.concatenate([x[0] for x in out]).view(np.int64),
                "cls": np.repeat(np.array([x[1] for x in out], np.int64), k),
                "size": np.repeat(np.array([x[2] for x in out], np.int32), k),
                "pcm": np.repeat(np.array([x[3] for x in out], np.int64), k)
                + (np.concatenate([np.arange(j) for j in k]) << 32)})
        return read
    return map_chunks(rows, "token long, cls long, size int, pcm long", make)


def verify(pairs: DataFrame, rows: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold, by comparing the whole sets.

    ``reps`` (cls, doc_id) names one document of each class.  The members of a leader b are cut into groups of about
    ``GROUP_MEMBERS``, and the leader's text goes to each.  A bit filter of fixed size over the wanted ids drops most
    other documents before the shuffle; a false hit of the filter is dropped by the join."""
    # a table of its own, so that the join has fresh exchanges and a leader of very many members can be split
    members = save(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("k")), "leaders")
    dealt = pairs.join(members, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("k") / GROUP_MEMBERS)).cast("int").alias("part"))
    ask = dealt.select("b", "part", F.col("a").alias("cls")).unionByName(
        dealt.select("b", "part", F.col("b").alias("cls")).distinct())
    wanted = save(ask.join(reps, "cls").select("b", "part", "cls", F.col("doc_id").cast("string").alias("doc_id")), "wanted")
    maybe = maybe_in(id_filter(wanted.select(F.xxhash64("doc_id").alias("key"))), F.xxhash64("doc_id"), rows.sparkSession)
    got = rows.filter(maybe).join(wanted, "doc_id").select("b", "part", "cls", "text")

    def compare(key, pdf):
        b = int(key[0])
        sets = shingle_sets(list(pdf["text"]), n, {})
        # rows that repeat an id with another text are not of the class
        sets = {c: s for c, s in zip(pdf["cls"].tolist(), sets) if _class_of(s) == c}
        own, out = sets.pop(b, None), []
        for c, s in sets.items() if own is not None else ():
            small, large = (s, own) if len(s) <= len(own) else (own, s)
            if 100 * len(small) < percent * len(large):
                continue
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum())
            if 100 * both >= percent * (len(s) + len(own) - both):
                out.append(c)
        sets = own = s = None
        if len(pdf) > GROUP_MEMBERS // 4:  # most groups are a few texts, for which it costs more than it frees
            give_back()
        return pd.DataFrame({"a": np.array(out, np.int64), "b": np.full(len(out), b, np.int64)})
    return got.groupBy("b", "part").applyInPandas(compare, "a long, b long")


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """Groups of documents connected by links of Jaccard similarity >= ``percent`` / 100 between their n-gram sets.

    Words are runs of anything but ASCII white space, with A-Z in lower case; a text of fewer than ``n`` words has its
    whole sequence as its one n-gram.  Returns one row per input row with a non-null id: doc_id, n_shingles,
    component_id (smallest id of the group).  Null and empty texts have no n-grams and are groups of their own.  Rows
    with a null id are returned with a null component and link nothing; repeated rows are equal sets and share a
    component; an empty table gives no rows; other columns are not read."""
    return grouped_rows(docs, n, percent, doc_id, text).select("doc_id", "n_shingles", "component_id")


def grouped_rows(docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """:func:`similar_components` with ``component``, a number of the group (null without n-grams or id), and
    ``text_hash``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    named = rows.filter(F.col("doc_id").isNotNull())
    classes = save(_classes(rows, n).withColumn("doc_id", F.col("doc_id").cast(kind)), "classes")
    known = classes.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    posts = save(_postings(named, n, percent, _sketch(named, n)), "postings")
    # tokens of two classes or more; the leader of a token is its class with the most frequent tokens
    shared = posts.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("token")
    shared = save(shared, "tokens")  # so that the join has fresh exchanges and a frequent token's rows can be split
    posts = posts.join(shared, "token").groupBy("token", "cls").agg(F.first("size").alias("size"), F.first("pcm").alias("pcm"))
    # one row per class: its prefix tokens that some other class has too, in order; a pair cannot share more than
    # either class has left
    heads = posts.groupBy("cls").agg(
        F.first("size").alias("size"), F.first("pcm").alias("pcm"),
        F.sort_array(F.collect_list(F.struct(F.shiftright("pcm", 32).alias("pos"), "token"))).alias("tokens"))
    heads = save(heads.select(
        "cls", "size", F.shiftright(F.col("pcm").bitwiseAND(F.lit((1 << 32) - 1)), 8).cast("int").alias("centre"),
        F.col("pcm").bitwiseAND(F.lit(255)).cast("int").alias("matches"), F.size("tokens").alias("left"),
        F.transform("tokens", lambda t: t["token"]).alias("tokens")), "heads")
    posts = heads.select("cls", "size", "centre", "matches", "left", F.posexplode("tokens").alias("nth", "token"))
    reps = save(known.groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "reps")
    links, comp, tested = None, None, None
    for _ in range(LEADER_ROUNDS):
        at = _across(_with_component(posts, comp))
        lead = at.groupBy("token").agg(F.max(F.struct("centre", "cls", "comp", "size", "matches")).alias("x"))
        need = _required("size", "x.size", "matches", "x.matches", percent)
        near = at.join(lead, "token").filter((F.col("x.comp") != F.col("comp")) & _sizes("size", "x.size", percent)
                                             & (F.col("left") >= need))
        best = near.groupBy(F.col("cls").alias("a"), F.col("x.cls").alias("b")).agg(
            F.count(F.lit(1)).alias("k"), F.first(need).alias("need")).filter("k >= need")
        best = _untested(best, tested).groupBy("a").agg(F.max(F.struct("k", "b")).alias("x"))
        pairs = save(best.select("a", F.col("x.b").alias("b")), "pairs")
        found = save(verify(pairs, named, reps, n, percent), "links")
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        comp = save(components(links), "components")
    at = _across(_with_component(posts, comp))
    one = at.select("token", *[F.col(c).alias(f"{c}_a") for c in ("cls", "comp", "size", "matches", "left", "nth")])
    two = at.select("token", *[F.col(c).alias(f"{c}_b") for c in ("cls", "comp", "size", "matches", "left", "nth")])
    need = _required("size_a", "size_b", "matches_a", "matches_b", percent)
    # the first shared token of a pair that shares enough stands early in both lists
    early = (F.col("nth_a") <= F.col("left_a") - need) & (F.col("nth_b") <= F.col("left_b") - need)
    pairs = one.join(two, "token").filter(
        (F.col("cls_a") < F.col("cls_b")) & (F.col("comp_a") != F.col("comp_b")) & _sizes("size_a", "size_b", percent)
        & early)
    pairs = pairs.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(F.first(need).alias("need"))
    for x in ("a", "b"):
        pairs = pairs.join(heads.select(F.col("cls").alias(x), F.col("tokens").alias(f"tokens_{x}")), x)
    pairs = pairs.filter(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("need")).select("a", "b")
    pairs = save(_untested(pairs, tested), "pairs")
    links = links.unionByName(save(verify(pairs, named, reps, n, percent), "links"))
    comp = save(components(links), "components")
    joined = reps.withColumnRenamed("doc_id", "first").join(comp, F.col("cls") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "cls")).select("cls", "first", "component")
    joined = save(joined, "members")
    least_id = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    final = joined.join(least_id, "component").select("cls", "component_id", "component")
    linked = known.join(final, "cls").select("doc_id", "n_shingles", "component_id", "component", "text_hash")
    alone = classes.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), "text_hash")
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, less those whose group has a row of a smaller id (or of the same id
    with a smaller hash of the text).  A row goes for its own text only: rows that repeat an id with an unrelated text
    stay.  Of rows with the same id and text one stays; rows without n-grams or id stay.

    Only rows that a bit filter suspects are shuffled; the others leave as they were read."""
    groups = save(grouped_rows(docs, n, percent, doc_id, text).filter("component is not null").select(
        "component", "doc_id", "text_hash"), "groups")
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"),
                                            F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = save(groups.join(first, "component").select(
        "doc_id", "text_hash", (F.struct("doc_id", "text_hash") != F.col("first")).alias("goes")).distinct(), "suspects")
    key = F.xxhash64("doc_id", "text_hash")
    maybe = F.coalesce(maybe_in(id_filter(shared.select(key.alias("key"))), key, docs.sparkSession), F.lit(True))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("doc"), F.xxhash64(whole).alias("h"), F.col(doc_id).alias("doc_id"),
                       F.xxhash64(F.col(text).cast("binary")).alias("text_hash")).withColumn("maybe", maybe)
    seen = rows.filter("maybe").join(shared, ["doc_id", "text_hash"], "left").filter("not coalesce(goes, false)")
    firsts = seen.filter("goes is not null").groupBy("doc_id", "text_hash").agg(F.min_by("doc", "h").alias("doc"))
    out = seen.filter("goes is null").select("doc").unionByName(firsts.select("doc")).unionByName(
        rows.filter("not maybe").select("doc"))
    return out.select("doc.*")


def _sizes(a: str, b: str, percent: int) -> Column:
    """Whether two sets are close enough in size to link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Pairs that were not compared yet, in either direction."""
    if tested is None:
        return pairs
    both = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both.distinct(), ["a", "b"], "left_anti")


def _with_component(posts: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return posts.withColumn("comp", F.col("cls"))
    return posts.join(comp.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left").withColumn(
        "comp", F.coalesce("comp", "cls"))


def _across(at: DataFrame) -> DataFrame:
    """Postings of the tokens that occur in two components or more."""
    mixed = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    return at.join(mixed, "token")
