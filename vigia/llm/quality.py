"""Quality rules by distribution divergence, in DataFrame functions only.

Each document has two histograms: its characters by class, and its words over the common words of its language.  The
references are the same histograms summed over every document of a language.  A document fails when the
Jensen-Shannon distance (square root of the divergence to base 2, 0 to 1) of either histogram to its reference is
above a threshold.  Short texts are guarded twice: a histogram is judged only from a minimum length on, and its
threshold is raised by the distance that sampling noise alone gives at that length.

Documents of a null language, or of one that has less than ``MIN_LANG_SHARE`` of all documents, are compared with the
reference of all documents; so the references have at most 1 / MIN_LANG_SHARE + 1 rows and are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigia.session import materialize

MIN_LANG_SHARE = 0.001
#: Common words: the most frequent words of at most this many letters.
COMMON_WORDS, COMMON_LENGTH = 32, 5
#: Thresholds of the distances, and the least number of words and characters at which they are judged.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.45
MIN_CHARS, MIN_WORDS = 200, 50

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
POOLED = ""


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a lambda's parameter is not expanded in its body)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def windows_of(words: Column) -> Column:
    """Hash of each window of three words."""
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(let(words, lambda w: F.transform(
        F.sequence(F.lit(2), F.size(w) - 1), lambda i: F.xxhash64(w[i - 2], w[i - 1], w[i]))))


def repeat_words(windows: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text (``windows`` from :func:`windows_of`).  Only
    texts that have such a window sort theirs."""
    def covered(s):
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(
            (j > 0) & (F.get(s, j - 1)["x"] == F.get(s, j)["x"]), F.lit(False)) | F.coalesce(
            F.get(s, j + 1)["x"] == F.get(s, j)["x"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
        # each start covers up to three words, fewer when the next start comes earlier
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0), lambda a, x: a + x))
    by_hash = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        let(by_hash, covered)).cast("long")


def base_counts(text: Column, words: Column, windows: Column) -> dict[str, Column]:
    """The plain counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.rlike(s, F.lit(f"[^{SPACE[1:-1]}]")))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeat_words(windows),
    }


def char_classes(text: Column) -> Column:
    """Characters by class: small a-z, other letters, capitals A-Z, digits, white space, punctuation, the rest.
    Each class is removed before the next is counted, so later patterns read short strings."""
    steps = ["[a-z]+", r"[^\x00-\x7F]+", r"\s+", "[A-Z]+", r"""[.,;:!?'"()-]+""", "[0-9]+"]

    def rest(t, i):
        if i == len(steps):
            return F.array(F.char_length(t).cast("long"))
        return let(F.regexp_replace(t, steps[i], ""), lambda r: F.concat(
            F.array((F.char_length(t) - F.char_length(r)).cast("long")), rest(r, i + 1)))
    return let(text, lambda t: rest(t, 0))


N_CLASSES = 7


def plain_words(text: Column) -> Column:
    """Words in lower case with punctuation taken as space."""
    return F.array_remove(F.split(F.lower(text), r"""[\s.,;:!?'"()|-]+"""), "")


#: One character for each common word, and how often each occurs in a string of them.
LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[:COMMON_WORDS]


def common_counts(words: Column, common: Column) -> Column:
    """How often each of the ``common`` words occurs in ``words``, and last the count of all others."""
    def letter(ref, w):
        at = F.array_position(ref, w).cast("int") + 1
        return F.when(F.char_length(w) > COMMON_LENGTH, F.lit("")).otherwise(F.substring(F.lit("_" + LETTERS), at, F.lit(1)))
    spelt = let(common, lambda ref: F.array_join(F.transform(words, lambda w: letter(ref, w)), ""))
    each = lambda s: [F.octet_length(s) - F.octet_length(F.replace(s, F.lit(x), F.lit(""))) for x in LETTERS]
    return let(spelt, lambda s: F.array(*[c.cast("long") for c in each(s)],
                                        (F.size(words) - F.octet_length(F.translate(s, "_", ""))).cast("long")))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length (0 if either is empty)."""
    def norm(a):
        return let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(a, lambda x: x / t))

    def part(x, y):
        return F.when(x > 0, x * F.log2(F.lit(2.0) * x / (x + y))).otherwise(0.0)
    div = F.aggregate(F.zip_with(norm(p), norm(q), lambda x, y: part(x, y) + part(y, x)), F.lit(0.0),
                      lambda s, x: s + x) / 2
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), div)))).otherwise(0.0)


def _noise(bins: int, n: Column) -> Column:
    """Distance that a sample of ``n`` draws has from its own distribution over ``bins`` bins, on average."""
    return F.sqrt(F.lit((bins - 1) / (8 * math.log(2))) / F.greatest(n, F.lit(1)))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language and one for all documents (lang = ''): the common words, their counts (the last count
    is that of all other words) and the counts of the character classes, over every document."""
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(F.col(lang), F.lit(POOLED))
    per = docs.groupBy(key.alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    large = F.broadcast(per.withColumn("all", total).filter(
        (F.col("n") >= F.col("all") * MIN_LANG_SHARE) & (F.col("lang") != POOLED)).select("lang"))
    rows = docs.select(key.alias("lang"), body.alias("text"))
    cls = rows.select("lang", char_classes(F.col("text")).alias("c")).groupBy("lang").agg(
        *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(N_CLASSES)])
    # longer words are counted together, so the shuffle carries the short ones only
    words = rows.select("lang", F.explode(F.transform(plain_words(F.col("text")), lambda w: F.when(
        F.char_length(w) <= COMMON_LENGTH, w).otherwise(F.lit("")))).alias("word")).groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("n"))

    def with_pool(df, by, sums):
        known = df.join(large, "lang")
        pool = df.groupBy(*by).agg(*[F.sum(s).alias(s) for s in sums]).withColumn("lang", F.lit(POOLED))
        return known.unionByName(pool.select(known.columns))

    # sums by language and by word, read several times below
    c = materialize(with_pool(materialize(cls), [], [f"c{i}" for i in range(N_CLASSES)]))
    w = materialize(with_pool(materialize(words), ["word"], ["n"]))
    top = w.filter("word <> ''").withColumn("r", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= COMMON_WORDS)
    every = w.groupBy("lang").agg(F.sum("n").alias("all"))
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("t"))
    return (c.select("lang", F.array(*[F.col(f"c{i}") for i in range(N_CLASSES)]).alias("ref_chars"))
            .join(top, "lang", "left").join(every, "lang", "left")
            .withColumn("t", F.coalesce("t", F.array().cast("array<struct<r:int,word:string,n:bigint>>")))
            .withColumn("all", F.coalesce("all", F.lit(0)))
            .select("lang", "ref_chars", F.transform("t", lambda x: x["word"]).alias("ref_words"),
                    # as many counts as LETTERS, then that of all other words
                    F.concat(F.transform("t", lambda x: x["n"]),
                             F.array_repeat(F.lit(0).cast("long"), F.lit(COMMON_WORDS) - F.size("t")),
                             F.array(F.col("all") - F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["n"])))
                    .alias("ref_counts")))


def judge(docs: DataFrame, refs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang") -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, char_distance, word_distance, kept.

    A null text counts as empty; an empty text has distances 0 and fails the base rule on its number of words; a null
    or rare language uses the reference of all documents; repeated rows are judged alike; an empty table gives no
    rows.  Other columns of ``docs`` are not read."""
    body = F.coalesce(F.col(text), F.lit(""))
    refs = F.broadcast(refs.select(F.col("lang").alias("_ref"), "ref_chars", "ref_words", "ref_counts"))
    known = F.broadcast(refs.filter(F.col("_ref") != POOLED).select(F.col("_ref").alias("_known")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.col(lang).alias("lang"))
    rows = rows.join(known, F.col("lang") == F.col("_known"), "left")
    rows = rows.withColumn("_ref", F.coalesce("_known", F.lit(POOLED))).join(refs, "_ref", "left")
    # each array is a column of its own, computed once and read by several expressions
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("windows", windows_of(F.col("words")))
    rows = rows.select("doc_id", "text", "ref_chars", "ref_words", "ref_counts",
                       *[c.alias(k) for k, c in base_counts(F.col("text"), F.col("words"), F.col("windows")).items()])
    rows = rows.withColumn("words", plain_words(F.col("text")))
    rows = rows.withColumn("chars", char_classes(F.col("text"))).withColumn(
        "counts", common_counts(F.col("words"), F.coalesce("ref_words", F.array().cast("array<string>"))))
    n_chars, n_plain = F.char_length("text"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).alias("base_failed"),
        n_chars.alias("n_chars"), n_plain.alias("n_plain"),
        F.coalesce(_distance(F.col("chars"), F.col("ref_chars")), F.lit(0.0)).alias("char_distance"),
        F.coalesce(_distance(F.col("counts"), F.col("ref_counts")), F.lit(0.0)).alias("word_distance"))
    bad = ((F.col("n_chars") >= MIN_CHARS)
           & (F.col("char_distance") > MAX_CHAR_DISTANCE + _noise(N_CLASSES, F.col("n_chars")))) \
        | ((F.col("n_plain") >= MIN_WORDS)
           & (F.col("word_distance") > MAX_WORD_DISTANCE + _noise(COMMON_WORDS + 1, F.col("n_plain"))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & ~bad).alias("kept"), "char_distance", "word_distance")
