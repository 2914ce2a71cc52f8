"""Model features: category dictionaries and encoding, stratified train/test
split, balanced class weights and stratified folds.

Scale notes.  Dictionaries are built from ``distinct`` values (a partial
aggregate per task), numbered by ranges of (column, value) with offsets; one
lookup codes all columns of a case, in a value of checked size or, beyond it,
by one join.  Split and folds need a row
number within each class; a plain ``row_number() OVER (PARTITION BY label)``
would sort each class in a single task; both select their cut keys from a
histogram instead (:func:`vigia.operators.ordering.keys_at_ranks`) and then
mark rows in one map-only pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigia.operators.ordering import hash_bins, keys_at_ranks
from vigia.session import attach_row, materialize

#: Bytes of text of a dictionary (with 16 for each entry) up to which it travels with the tasks as one value.
DICT_VALUE_BYTES = 4 << 20
#: Entries that share a cell of the lookup on average.
CELL_ENTRIES = 2


def label_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(columna, valor, codigo)``: per column the sorted distinct values
    numbered 0..k-1 (code-point order, like sorting Python strings; a null
    value comes first).

    The distinct values of all columns are cut into ranges of (column, value);
    each range is sorted by its own task and written once with the rows'
    positions in it.  A small table (a row per column and range) gives each
    range the number of values before it."""
    vals = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("valor")) for c in cols])).alias("s")) \
        .select("s.columna", "s.valor").distinct()
    order = [F.col("columna"), F.col("valor")]
    at = F.monotonically_increasing_id()                      # range in the upper 31 bits, position in the lower 33
    placed = materialize(vals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy("columna", "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("columna").orderBy("_range")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("columna", "_range", (before - F.col("_first")).alias("_shift"))
    # as many rows as ranges and columns together
    return placed.join(F.broadcast(ranges), ["columna", "_range"]) \
                 .select("columna", "valor", (F.col("_at") + F.col("_shift")).cast("int").alias("codigo"))


def _cell_of(columna: Column, valor: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(columna, valor), F.lit(cells))


def _codes_by_value(df: DataFrame, dictionary: DataFrame, cols: list[str], entries: int) -> DataFrame:
    """The codes from one value that holds the whole dictionary: an array of
    cells by hash, each a map of a few entries, so a lookup compares a few
    entries and no row of ``df`` moves."""
    cells = max(1, entries // CELL_ENTRIES)
    c, v = F.col("columna"), F.col("valor")
    entry = F.struct(F.struct(c.alias("c"), v.alias("v")).alias("key"), F.col("codigo").alias("value"))
    filled = dictionary.filter(v.isNotNull()).select(_cell_of(c, v, cells).alias("cell"), entry.alias("e"))
    # every cell has a row, so that its place in the sorted array is its number
    every = df.sparkSession.range(cells).select(F.col("id").alias("cell"), F.lit(None).cast(filled.schema["e"].dataType).alias("e"))
    held = filled.unionByName(every).groupBy("cell").agg(F.collect_list("e").alias("es"))
    maps = F.transform(F.array_sort(F.collect_list(F.struct("cell", "es"))), lambda x: F.map_from_entries(x["es"]))
    looked = held.agg(maps.alias("maps")).scalar()

    def code(c: str) -> Column:
        v = F.col(c).cast("string")
        own = F.get(looked, _cell_of(F.lit(c), v, cells).cast("int"))
        return F.try_element_at(own, F.struct(F.lit(c).alias("c"), v.alias("v")))
    return df.withColumns({f"_c{i}": code(c) for i, c in enumerate(cols)})


def _codes_by_join(df: DataFrame, dictionary: DataFrame, cols: list[str]) -> DataFrame:
    """The codes of all columns by one join of (row, column, value) with the
    dictionary, for dictionaries of any size."""
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))    # written once: the numbers stay
    each = rows.select("_row", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("columna"),
                                                            F.col(c).cast("string").alias("valor"))
                                                   for i, c in enumerate(cols)])).alias("s")).select("_row", "s.*")
    got = each.join(dictionary, ["columna", "valor"]).groupBy("_row").agg(
        *[F.max(F.when(F.col("i") == i, F.col("codigo"))).alias(f"_c{i}") for i in range(len(cols))])
    return rows.join(got, "_row", "left").drop("_row")


def encode(df: DataFrame, dictionary: DataFrame, cols: list[str], unseen_flag: str | None = "is_unseen",
           value_bytes: int = DICT_VALUE_BYTES) -> DataFrame:
    """Replace each category by its code; a value not in the dictionary gets
    code 0 and raises ``unseen_flag``, and so does a null.  Codes are plain
    doubles without ML attribute metadata, so tree learners treat them as
    ordered numbers.

    One lookup serves all columns: up to ``value_bytes`` the dictionary is one
    value that travels with the tasks, beyond that there is one join."""
    d = dictionary.filter(F.col("columna").isin(cols)) if cols else dictionary.limit(0)
    size = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("valor") + 16).alias("b")).first()
    if (size["b"] or 0) <= value_bytes:
        out = _codes_by_value(df, d, cols, size["n"])
    else:
        out = _codes_by_join(df, d, cols)
    if unseen_flag:
        flag = F.lit(False)
        for i in range(len(cols)):
            flag = flag | F.col(f"_c{i}").isNull()
        out = out.withColumn(unseen_flag, flag)
    out = out.withColumns({c: F.coalesce(F.col(f"_c{i}"), F.lit(0)).cast("double") for i, c in enumerate(cols)})
    return out.drop(*[f"_c{i}" for i in range(len(cols))])


def fit_encode(df: DataFrame, cols: list[str], fit_rows: Column | None = None,
               unseen_flag: str | None = "is_unseen") -> DataFrame:
    """Fit the dictionaries on the rows where ``fit_rows`` holds and encode
    every row.  ``None`` fits on all rows, as the reference does (codes then
    leak the test rows' categories); passing ``~is_test`` fits on the training
    rows only, and a category seen only in test rows gets code 0 and the flag."""
    src = df if fit_rows is None else df.filter(fit_rows)
    return encode(df, label_dictionary(src, cols), cols, unseen_flag)


def _class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class; rows without a label belong to no class."""
    return df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).cast("long").alias("c"))


def split_allocation(df: DataFrame, label: str, test_size: float = 0.25) -> DataFrame:
    """Per class the train/test sizes of a stratified shuffle split:
    ``n_test = ceil(test_size * n)``; train sizes are the floors of the
    proportional shares of ``n_train`` with the missing units given to the
    largest remainders (ties: lower label first); test takes the rest.

    Works on the (classes)-row count table only."""
    cc = _class_counts(df, label)
    tot = cc.agg(F.sum("c").alias("n"))
    t = attach_row(cc, tot).withColumn(
        "n_test", F.ceil(F.col("n").cast("double") * F.lit(float(test_size))).cast("long"))
    t = t.withColumn("n_train", F.col("n") - F.col("n_test"))
    prod = F.col("c").cast("decimal(38,0)") * F.col("n_train").cast("decimal(38,0)")
    nd = F.col("n").cast("decimal(38,0)")
    t = t.withColumn("base", F.floor(prod / nd).cast("long")).withColumn("rem", (prod % nd).cast("decimal(38,0)"))
    # classes are few (2 here): a window over this tiny table is free
    w_all = Window.partitionBy(F.lit(0))
    t = t.withColumn("need", F.col("n_train") - F.sum("base").over(w_all))
    t = t.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rem"), F.asc("label"))) - 1)
    t = t.withColumn("train", F.col("base") + F.when(F.col("r") < F.col("need"), 1).otherwise(0))
    return t.select("label", "c", F.col("train").cast("long").alias("train"),
                    (F.col("c") - F.col("train")).cast("long").alias("test"))


def before_key(key: Column, cols: list[str]) -> Column:
    """Whether a row's key (``cols``) comes before ``key``, a struct of the same
    columns.  The first column settles nearly every row; only ties on it (and
    nulls) build the row's own struct."""
    lead, cut = F.col(cols[0]), key.getField(cols[0])
    return F.when(lead < cut, F.lit(True)).when(lead > cut, F.lit(False)).otherwise(F.struct(*[F.col(c) for c in cols]) < key)


# Bits of the split order.
SPLIT_BITS = 60


def split_hash(key_cols: list[str], seed: int) -> Column:
    """Deterministic pseudo-random order of the rows for the split: the first
    15 hex digits of the md5 of the key and the seed, joined by ``|``, as a
    number (any engine with md5 gives the same order)."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, SPLIT_BITS // 4), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str, key_cols: list[str], test_size: float = 0.25,
                     seed: int = 42, flag: str = "is_test", order: str | None = None) -> DataFrame:
    """Mark the test rows of a stratified split: within each class, the rows
    with the smallest seeded hash of the unique key, as many as the
    allocation gives the class.  Exact class sizes, deterministic membership.
    Rows with a null label belong to neither part: their flag is null.

    No sort of the data: the class's cut key (hash, key) is selected from a
    histogram over the hash's top bits (:func:`keys_at_ranks`), then every row
    compares its own (hash, key) with its class's cut — a map-only pass
    against a two-row broadcast table.  ``order`` names a column that already
    holds :func:`split_hash` of the key and the seed; without it every step
    computes the hash again.
    """
    alloc = split_allocation(df, label, test_size)
    h = df.withColumn("_h", F.col(order) if order else split_hash(key_cols, seed))
    ranks = alloc.select(F.col("label").alias(label), F.col("test").alias("r"))
    cuts = keys_at_ranks(h, label, ["_h", *key_cols], ranks, bins=hash_bins(F.col("_h"), SPLIT_BITS))
    # one row per class: computed once and checkpointed, so the marking pass
    # (and any consumer that reads the result several times) does not re-run
    # the histogram and the boundary-bin sort
    info = materialize(alloc.select(F.col("label").alias("_lab"), F.col("test").alias("_nt"), F.col("c").alias("_nc"))
                       .join(cuts.withColumnRenamed(label, "_lab"), "_lab", "left"))
    is_test = (F.when(F.col("_nt").isNull(), F.lit(None).cast("boolean"))
               .when(F.col("_nt") >= F.col("_nc"), F.lit(True))
               .when(F.col("_nt") <= 0, F.lit(False))
               .otherwise(before_key(F.col("key"), ["_h", *key_cols])))
    out = h.join(F.broadcast(info), F.col(label) == F.col("_lab"), "left")        # one row per class
    return out.withColumn(flag, is_test).drop("_h", "_lab", "_nt", "_nc", "r", "key")


def fold_allocation(df: DataFrame, label: str, n_folds: int = 5) -> DataFrame:
    """Per class and fold the number of rows of an unshuffled stratified
    k-fold: labels sorted, position j goes to fold ``j mod k``, so class k
    (positions [c_before, c_before + c)) gives fold f ``cnt(c_before + c) - cnt(c_before)`` rows with
    ``cnt(x) = floor((x + k - 1 - f) / k)``.  Also the cumulative bounds."""
    cc = _class_counts(df, label)
    w = Window.partitionBy(F.lit(0)).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    cc = cc.withColumn("c_before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    folds = cc.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))   # k rows per class
    k = F.lit(n_folds)

    def cnt(x):
        return F.floor((x + k - 1 - F.col("fold")) / k)

    folds = folds.withColumn("n", (cnt(F.col("c_before") + F.col("c")) - cnt(F.col("c_before"))).cast("long"))
    wf = Window.partitionBy("label").orderBy("fold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return folds.withColumn("upto", F.sum("n").over(wf)).select("label", "fold", "n", "upto")


def stratified_folds(df: DataFrame, label: str, order_cols: list[str], n_folds: int = 5,
                     fold_col: str = "fold") -> DataFrame:
    """Fold id of each row for an unshuffled stratified k-fold: within a
    class, rows in register order (``order_cols``, a unique key) fill fold 0
    first, then fold 1, ... with the sizes of :func:`fold_allocation`.

    The first key of every fold after the first is selected per class with
    :func:`keys_at_ranks`; a row's fold is the number of those keys that are
    not greater than its own key (map-only, against a small broadcast)."""
    alloc = fold_allocation(df, label, n_folds)
    starts = alloc.filter(F.col("fold") < n_folds - 1)          # rank of the first row of folds 1..k-1
    ranks = starts.select(F.col("label").alias(label), F.col("upto").alias("r"))
    cuts = keys_at_ranks(df, label, order_cols, ranks)
    # one row per class with at most k - 1 keys: computed once (checkpoint)
    per_class = materialize(cuts.groupBy(F.col(label).alias("_lab")).agg(F.collect_list("key").alias("_cuts")))
    out = df.join(F.broadcast(per_class), F.col(label) == F.col("_lab"), "left")
    # one comparison a cut: a function over the array would be interpreted row by row
    fold = F.lit(0)
    for i in range(n_folds - 1):
        cut = F.get("_cuts", F.lit(i))
        fold = fold + F.when(cut.isNotNull() & ~before_key(cut, order_cols), 1).otherwise(0)
    return out.withColumn(fold_col, fold).drop("_lab", "_cuts")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)``: weight = rows / (classes * rows of the class)."""
    cc = _class_counts(df, label)
    tot = cc.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    return (attach_row(cc, tot)
              .select("label", F.col("c").alias("n"),
                      (F.col("n").cast("double") / (F.col("k").cast("double") * F.col("c").cast("double")))
                      .alias("weight")))
