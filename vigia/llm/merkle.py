"""Merkle manifest of a table: a digest per row, a tree per group, and a proof for every row.

A row's place among the rows of its group, in the order of its integer key, is found without ordering the rows.  Per group
and 32,768 consecutive keys the keys become a bitmap; bitmaps of the tasks merge by OR (Spark's ``bitmap_construct_agg``;
they are compressed where they lie, in shuffle blocks and Parquet).  A directory of popcounts, one row per 512 keys
that occur, holds how many rows of the group come before; a row's slot is that number plus the bits below its own.

Levels are reduced with slot arrays: rows of the same group whose slots share the first ``WIDE`` = 3**``DEEP`` places form
one array, whose hashes are put at their slots and folded ``DEEP`` levels at once.  Each round is one shuffle of a table
``WIDE`` times smaller than the last.  The way up (siblings to the left and right, level by level) is handed down
again from the few upper blocks, so a row's proof is computed where its block lies and no path is stored per row.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigia.llm.common import bound_batches
from vigia.llm.scratch import save
from vigia.operators.ordering import row_index, running_totals

#: Children of a node, levels that one block reduces, and slots of a block.
FAN, DEEP = 3, 5
WIDE = FAN ** DEEP
#: Keys of a bitmap (fixed by Spark: 4096 bytes) and of a row of the directory, as powers of two.
BITMAP, WORD = 15, 9
#: The bitmap of rows without a key, which come first: below that of the least 64-bit key.
NO_KEY = -(1 << (63 - BITMAP)) - 1


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


# --- slots by bitmap rank --------------------------------------------------

def _before(parts: DataFrame, wide: int = 1 << BITMAP) -> DataFrame:
    """parts (k, bucket, n) with the rows of the group in lower buckets (``before``) and in all (``total``).

    Sums run over at most ``wide`` (a power of two) buckets at a time; where a group has more, they run inside runs of
    ``wide`` bucket numbers and over the runs, which are summed the same way."""
    most = parts.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    if most <= wide:
        w = Window.partitionBy("k")
        lower = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        return parts.withColumn("before", F.coalesce(F.sum("n").over(lower), F.lit(0))).withColumn(
            "total", F.sum("n").over(w))
    own = parts.withColumn("up", F.shiftright("bucket", wide.bit_length() - 1))
    upper = save(own.groupBy("k", F.col("up").alias("bucket")).agg(F.sum("n").alias("n")), "bucket-runs")
    upper = _before(upper, wide).select("k", F.col("bucket").alias("up"), F.col("before").alias("base"), "total")
    lower = Window.partitionBy("k", "up").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("before", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    return own.join(upper, ["k", "up"]).withColumn("before", F.col("before") + F.col("base")).drop("up", "base")


def _ties(at: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Keys that occur more than once in a group, found in bitmaps with fewer bits than rows: (extra rows by bitmap,
    rows of those keys numbered among themselves in ``tie``), or None without any.

    Rows of one key are numbered by their leaves.  Rows with equal leaves are equal and are numbered as one with a
    count, so a key of very many copies is not ordered row by row."""
    full = bitmaps.filter(F.col("n") > F.bitmap_count("bits")).select("k", "bucket")
    if full.isEmpty():
        return None
    mine = at.join(full, ["k", "bucket"], "left_semi")
    copies = mine.groupBy(*at.columns).agg(F.count(F.lit(1)).alias("copies"))
    ids = save(mine.groupBy("k", "bucket", "pos").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "repeated-keys")
    extra = ids.groupBy("k", "bucket").agg(F.collect_list(F.struct("pos", (F.col("c") - 1).alias("more"))).alias("extra"))
    rows = running_totals(copies.join(ids, ["k", "bucket", "pos"], "left_semi"), ["leaf"], {"upto": F.col("copies")},
                          ["k", "bucket", "pos"], index_col=None)
    one = F.explode(F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1)).alias("tie")
    return extra, save(rows.select(*at.columns, one), "repeated-rows")


def slots(leaves: DataFrame) -> DataFrame:
    """leaves (k: group, key: long, leaf, ...) with ``slot``, the place in the group by key (without a key first; equal
    keys by leaf), and ``total``, the rows of the group."""
    at = leaves.withColumn("bucket", F.coalesce(F.shiftright("key", BITMAP), F.lit(NO_KEY))).withColumn(
        "pos", F.coalesce(F.col("key").bitwiseAND((1 << BITMAP) - 1), F.lit(0)).cast("long"))
    bitmaps = save(at.groupBy("k", "bucket").agg(F.bitmap_construct_agg("pos").alias("bits"),
                                                 F.count(F.lit(1)).alias("n")), "bitmaps")
    directory = bitmaps.join(_before(bitmaps.select("k", "bucket", "n")).drop("n"), ["k", "bucket"])
    ties = _ties(at, bitmaps)
    if ties is None:
        directory = directory.withColumn("extra", F.array().cast("array<struct<pos:bigint,more:bigint>>"))
        rows = at.withColumn("tie", F.lit(0).cast("long"))
    else:
        directory = directory.join(ties[0], ["k", "bucket"], "left").withColumn("extra", F.coalesce(
            F.col("extra"), F.array().cast("array<struct<pos:bigint,more:bigint>>")))
        rows = at.join(ties[1].select("k", "bucket", "pos").distinct(), ["k", "bucket", "pos"], "left_anti")
        rows = rows.withColumn("tie", F.lit(0).cast("long")).unionByName(ties[1])

    size = 1 << (WORD - 3)

    def more(keep):
        return F.aggregate(F.filter("extra", keep), F.lit(0).cast("long"), lambda a, x: a + x["more"])
    counts = F.transform(F.sequence(F.lit(0), F.lit((1 << (BITMAP - WORD)) - 1)),
                         lambda j: F.bitmap_count(F.substring(F.col("bits"), j * size + 1, F.lit(size))))
    words = directory.withColumn("counts", counts).select("*", F.posexplode("counts").alias("j", "here"))
    words = words.filter("here > 0").select(
        F.col("k").alias("wk"), (F.col("bucket") * (1 << (BITMAP - WORD)) + F.col("j")).alias("word"), "total",
        F.substring("bits", F.col("j") * size + 1, F.lit(size)).alias("bits"),
        (F.col("before") + F.aggregate(F.slice("counts", F.lit(1), F.col("j")), F.lit(0).cast("long"), lambda a, x: a + x)
         + more(lambda x: F.shiftright(x["pos"], WORD) < F.col("j"))).alias("before"),
        F.filter("extra", lambda x: F.shiftright(x["pos"], WORD) == F.col("j")).alias("extra"))

    rows = rows.withColumn("word", F.col("bucket") * (1 << (BITMAP - WORD)) + F.shiftright("pos", WORD))
    got = rows.join(words.hint("shuffle_hash"), (F.col("k") == F.col("wk")) & (rows["word"] == words["word"]))
    byte = F.shiftright(F.col("pos").bitwiseAND((1 << WORD) - 1), 3).cast("int")
    last = F.conv(F.hex(F.substring("bits", byte + 1, F.lit(1))), 16, 10).cast("long")
    below = F.expr("shiftleft(1L, cast(pos & 7 as int)) - 1")
    slot = (F.col("before") + F.bitmap_count(F.substring("bits", F.lit(1), byte)) + F.bit_count(last.bitwiseAND(below))
            + more(lambda x: x["pos"] < F.col("pos")) + F.col("tie"))
    return got.select(*leaves.columns, slot.alias("slot"), "total")


# --- slot arrays -----------------------------------------------------------

def reduce_levels(nodes: list[str], alone: bool) -> list[list[str]]:
    """The levels above (and with) the nodes of one block: up to a single node if the block is ``alone`` in its tree,
    else ``DEEP`` of them."""
    levels = [nodes]
    while len(levels[-1]) > 1 if alone else len(levels) <= DEEP:
        last = levels[-1]
        levels.append([digest("".join(last[i:i + FAN])) for i in range(0, len(last), FAN)])
    return levels


def way_up(levels: list[list[str]], i: int) -> str:
    """Siblings of node i level by level: left ones, ``|``, right ones; levels are parted by commas."""
    out = []
    for nodes in levels[:-1]:
        a = i - i % FAN
        out.append("".join(nodes[a:i]) + "|" + "".join(nodes[i + 1:a + FAN]))
        i //= FAN
    return ",".join(out)


def fold(node: str, way: str) -> str:
    """The node at the end of a way up."""
    for level in way.split(",") if way else ():
        left, right = level.split("|")
        node = digest(left + node + right)
    return node


def proof(way: str) -> str:
    """Digest of all siblings of a way up, from the bottom and from the left."""
    return digest(way.replace("|", "").replace(",", ""))


def join_ways(*ways: str) -> str:
    return ",".join(w for w in ways if w)


def placed(slots_of_block, values) -> list:
    """A slot array: each value at its slot."""
    out = [None] * len(values)
    for i, v in zip(slots_of_block, values):
        out[i] = v
    return out


def _blocks(nodes: DataFrame, columns: list[str], name: str) -> DataFrame:
    """nodes (k, slot, total, columns...) as one row per block of ``WIDE`` slots: k, block, total, the slots within the
    block, and one array per column in the same order."""
    row = F.collect_list(F.struct((F.col("slot") % WIDE).cast("int").alias("at"), *columns)).alias("rows")
    # null values stay in place: a struct is never null
    got = nodes.groupBy("k", F.floor(F.col("slot") / WIDE).alias("block")).agg(F.max("total").alias("total"), row)
    return save(got.select("k", "block", "total", *[F.col(f"rows.{c}").alias(c) for c in ("at", *columns)]), name)


def _tops(blocks: DataFrame, column: str) -> DataFrame:
    """(k, slot, total, node) of the top nodes of the blocks, as the nodes of the next round."""
    def run(frames):
        for pdf in frames:
            top = [reduce_levels(placed(at, h), total <= WIDE)[-1][0]
                   for at, h, total in zip(pdf["at"], pdf[column], pdf["total"])]
            yield pd.DataFrame({"k": pdf["k"], "slot": pdf["block"], "total": -(-pdf["total"] // WIDE), "node": top})
    return blocks.select("k", "block", "total", "at", column).mapInPandas(run, "k string, slot long, total long, node string")


def ways(nodes: DataFrame) -> DataFrame:
    """The way from each node (k, slot, total, node) to the top of its tree, and that top: (k, slot, way, top)."""
    blocks = _blocks(nodes, ["node"], "node-blocks")
    if blocks.filter(F.col("total") > WIDE).isEmpty():
        upper = blocks.select("k", "block", "total", "at", "node", F.lit("").alias("way"), F.lit(None).cast("string").alias("top"))
    else:
        over = ways(_tops(blocks, "node")).withColumnRenamed("slot", "block")
        upper = blocks.join(over, ["k", "block"])

    def run(frames):
        for pdf in frames:
            out = []
            for k, block, total, at, node, way, top in zip(*[pdf[c] for c in pdf.columns]):
                levels = reduce_levels(placed(at, node), total <= WIDE)
                out += [(k, block * WIDE + i, join_ways(way_up(levels, i), way), top or levels[-1][0]) for i in range(len(node))]
            yield pd.DataFrame(out, columns=["k", "slot", "way", "top"])
    upper = upper.select("k", "block", "total", "at", "node", "way", "top")
    return upper.mapInPandas(run, "k string, slot long, way string, top string")


# --- manifest --------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, received: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS,
             key: str = "doc_id", group: str = "source") -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot (top of the tree of its group), root (top of the tree over the
    groups), proof_sha256 (digest of all siblings on the way up), folded_root (the way up from the row as ``received``,
    else as it is) and verified (whether that is the root).

    ``received`` gives, for some fields, the value to verify.  Rows of a group are ordered by the integer key: rows
    without a key first, equal keys by leaf; equal rows are leaves each.  Groups are ordered by UTF-8 bytes, null
    first.  Null fields and empty texts have leaves of their own; an empty table gives no rows; columns that are not
    in ``fields`` are not read."""
    kind = docs.schema[key].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def leaf(values):
        return F.sha2(F.concat(*[field(values.get(f, F.col(f))) for f in fields]), 256)
    changed = F.lit(False)
    for f, v in (received or {}).items():
        changed = changed | ~v.eqNullSafe(F.col(f))
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    leaves = save(docs.select(name.alias("k"), F.col(key).cast("long").alias("key"), leaf({}).alias("leaf"),
                              F.when(changed, leaf(received or {})).alias("other")), "leaves")
    blocks = _blocks(slots(leaves), ["key", "leaf", "other"], "leaf-blocks")
    up = save(ways(_tops(blocks, "leaf")), "ways")

    # groups are few or many: they are numbered in order like rows and form a tree of their own
    subroots = up.filter("slot = 0").select("k", F.col("top").alias("subroot"))
    numbered = save(row_index(subroots, ["k"]), "subroots")
    count = numbered.agg(F.count(F.lit(1)).alias("total"))
    nodes = numbered.select(F.lit("").alias("k"), F.col("_idx").cast("long").alias("slot"), F.col("subroot").alias("node"),
                            count.scalar().alias("total"))
    over = ways(nodes).select("slot", F.col("way").alias("group_way"), F.col("top").alias("root"))
    groups = save(numbered.join(over, F.col("_idx") == F.col("slot")).select("k", "subroot", "group_way", "root"), "groups")

    whole = blocks.join(up.select("k", F.col("slot").alias("block"), "way"), ["k", "block"]).join(groups, "k")

    def run(frames):
        for pdf in frames:
            out = []
            for at, keys, leaf_of, other, total, way, group_way, subroot, root in zip(*[pdf[c] for c in pdf.columns]):
                levels = reduce_levels(placed(at, leaf_of), total <= WIDE)
                for i, k, mine, got in zip(at, keys, leaf_of, other):
                    path = join_ways(way_up(levels, i), way, group_way)
                    folded = fold(got or mine, path)
                    out.append((k, mine, subroot, root, proof(path), folded, folded == root))
            yield pd.DataFrame(out, columns=["k", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    # keys travel as text: pandas would turn a column of integers with nulls into floats
    whole = whole.select("at", F.transform("key", lambda x: x.cast("string")).alias("key"), "leaf", "other", "total",
                         "way", "group_way", "subroot", "root")
    rows = whole.mapInPandas(run, "k string, leaf string, subroot string, root string, proof_sha256 string, "
                                  "folded_root string, verified boolean")
    return rows.select(F.col("k").cast(kind).alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
