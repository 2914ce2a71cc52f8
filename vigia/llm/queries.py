"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole
table.  ``ORACLES`` holds DuckDB SQL for those whose rows SQL can express; the others are tested against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm import (decontaminate, katz, language, merkle, ngram_join, packing, phrase_dedup, quality, sharding,
                       suffix_dedup, tokens, toxicity, whitening)
from vigia.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

N_SHARDS = 24


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


@register
def op1_ngram_join(spark, sf_dir):
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), n=3, percent=90)


@register
def op2_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.cut(suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), window=200))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register
def op3_sharding(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register
def op4_decontamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op5_token_counts(spark, sf_dir):
    return tokens.context_report(tokens.length_histogram(table(spark, sf_dir, "documents")))


@register
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = language.learn(docs, ~held_out)
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rate")


@register
def op7_phrase_dedup(spark, sf_dir):
    rows = phrase_dedup.cut(phrase_dedup.repeated_phrases(table(spark, sf_dir, "documents"), window=13))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@register
def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs))


@register
def op9_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), size=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@register
def op10_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    scorer = toxicity.learn(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, scorer)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register
def op11_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    model = katz.learn(docs.filter(~held_out))
    return katz.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                                          F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


@register
def op12_embedding_whitening(spark, sf_dir):
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@register
def op13_merkle_manifest(spark, sf_dir):
    tampered = F.coalesce(fold("doc_id", 2) == 0, F.lit(False))
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), {"text": text})


# --- SQL ---------------------------------------------------------------------

#: Words of every whole text; a null text has none.
_WORDS = """WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents)"""

ORACLES["op1_ngram_join"] = _WORDS.format(
    text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace("WITH", "WITH RECURSIVE", 1) + """,
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS k FROM s x JOIN s y ON x.g = y.g
                        WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
reach AS (SELECT a AS doc_id, a AS other FROM (SELECT DISTINCT a FROM links)
          UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, MIN(other) AS c FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.doc_id = w.doc_id
"""

# bytes as pairs of hexadecimal digits; a run of starts at most 200 bytes apart is one removed span
ORACLES["op2_suffix_dedup"] = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 400)) AS g FROM (SELECT doc_id, x, unnest(range(1, n - 198)) AS i FROM h)),
twice AS (SELECT g FROM win GROUP BY g HAVING COUNT(*) > 1),
starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win WHERE g IN (SELECT g FROM twice)),
runs AS (SELECT doc_id, MIN(i) AS a, MAX(i) + 200 AS b FROM (
           SELECT doc_id, i, SUM(CASE WHEN before IS NULL OR i - before > 200 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id ORDER BY i) AS r FROM starts) GROUP BY doc_id, r),
gone AS (SELECT doc_id, SUM(b - a) AS n_removed, COUNT(*) AS n_spans FROM runs GROUP BY doc_id),
edge AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM runs),
parts AS (SELECT h.doc_id, string_agg(substr(x, 2 * e.p - 1, 2 * (e.q - e.p)), '' ORDER BY e.p) AS kept FROM h JOIN (
            SELECT doc_id, b AS p, coalesce(next, 1000000000) AS q FROM edge
            UNION ALL SELECT doc_id, 1, MIN(a) FROM runs GROUP BY doc_id) e ON e.doc_id = h.doc_id GROUP BY h.doc_id)
SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN gone ON gone.doc_id = h.doc_id LEFT JOIN parts ON parts.doc_id = h.doc_id
"""

ORACLES["op7_phrase_dedup"] = _WORDS.format(text="text") + """,
win AS (SELECT doc_id, i, ws[i:i + 12] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT g, MIN(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN low USING (g) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT word.doc_id, COUNT(*) AS n_words, COUNT(gone.k) AS n_removed,
                coalesce(string_agg(x, ' ' ORDER BY word.k) FILTER (WHERE gone.k IS NULL), '') AS kept
         FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k GROUP BY word.doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + "))"
_PARENTS = "list_transform(range(0, (len(hs) + 2) // 3), lambda j: sha256(array_to_string(hs[3 * j + 1:3 * j + 3], '')))"
_LEFT, _RIGHT = ("array_to_string(hs[i - i % 3 + 1:i], '')", "array_to_string(hs[i + 2:i - i % 3 + 3], '')")

# CRC-32 of the decimal digits of an id, bit by bit (unsigned); a list_reduce begins with the first of its list
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda j: CAST(ascii(substr(CAST(doc_id AS VARCHAR), j, 1)) AS BIGINT))),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"""

# the siblings of place i (from 0) are those of its run of three, in lists that begin with 1
ORACLES["op13_merkle_manifest"] = f"""WITH RECURSIVE
leaves AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="got")} AS other FROM (
    SELECT *, CASE WHEN {_CRC32} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS got FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
levels AS (SELECT source, 0 AS l, list(leaf ORDER BY i) AS hs FROM placed GROUP BY source
           UNION ALL SELECT source, l + 1, {_PARENTS} FROM levels WHERE len(hs) > 1),
tops AS (SELECT source, hs[1] AS subroot, l AS top, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM levels WHERE len(hs) = 1),
upper AS (SELECT 0 AS l, list(subroot ORDER BY i) AS hs FROM tops
          UNION ALL SELECT l + 1, {_PARENTS} FROM upper WHERE len(hs) > 1),
walk AS (SELECT doc_id, source, leaf, i, 0 AS l, other AS h, '' AS proof FROM placed
         UNION ALL SELECT doc_id, w.source, leaf, i // 3, w.l + 1, sha256(concat({_LEFT}, h, {_RIGHT})), concat(proof, {_LEFT}, {_RIGHT})
         FROM walk w JOIN levels v ON v.source IS NOT DISTINCT FROM w.source AND v.l = w.l WHERE len(hs) > 1),
climb AS (SELECT doc_id, leaf, subroot, tops.i, 0 AS l, h, proof FROM walk
          JOIN tops ON tops.source IS NOT DISTINCT FROM walk.source AND tops.top = walk.l
          UNION ALL SELECT doc_id, leaf, subroot, i // 3, c.l + 1, sha256(concat({_LEFT}, h, {_RIGHT})), concat(proof, {_LEFT}, {_RIGHT})
          FROM climb c JOIN upper u ON u.l = c.l WHERE len(hs) > 1)
SELECT doc_id, leaf, subroot, hs[1] AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = hs[1] AS verified
FROM climb c JOIN upper u ON u.l = c.l WHERE len(hs) = 1
"""
