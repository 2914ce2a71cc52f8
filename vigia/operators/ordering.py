"""Global orderings without a single-partition window.

``row_number()``/running sums over a window with no (or a very coarse)
``PARTITION BY`` move every row into one task.  Two distributed replacements:

* :func:`keys_at_ranks` — exact selection.  The rows at given ranks (within
  each group, in a given order) are found with a histogram: rows are counted
  per (group, bin) where bins are contiguous ranges of the order, cumulative
  counts over the small histogram locate the bin of each wanted rank, and only
  the rows of those few bins are sorted.  No shuffle of the full data; the
  split, the folds and the quartiles use it (a row's rank is then known by
  comparing its key with the selected keys).
* :func:`running_totals` — prefix sums/row index for every row: rows are cut
  into contiguous ranges (quantile bins of a number, ranges of the whole key
  if it begins with text), numbered/summed inside each (group,
  range) with an ordinary window, and shifted by the totals of the earlier
  ranges.  One shuffle, every window partition a small slice.  Used on
  already aggregated data (distinct scores of a ROC curve, sheet rows).

Ties of the order key always fall into the same bin, so both give exactly the
single-window result.  Bin counts scale with ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from vigia.session import materialize

_OFFSET_BROADCAST_ROWS = 2_000_000


def default_bins(spark) -> int:
    """Bins per ordering: a few per shuffle partition, at least 16."""
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _as_double(df: DataFrame, col: str) -> Column:
    dt = df.schema[col].dataType
    if isinstance(dt, (TimestampType, TimestampNTZType, DateType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if isinstance(dt, NumericType):
        return F.col(col).cast("double")
    if isinstance(dt, StringType):
        # first 6 UTF-8 bytes as a big-endian number: non-decreasing in the
        # string (byte) order, exact in a double; longer common prefixes tie
        six = F.rpad(F.hex(F.substring(F.encode(F.col(col), "UTF-8"), 1, 6)), 12, "0")
        return F.conv(six, 16, 10).cast("double")
    raise TypeError(f"order column {col} must be numeric, string, date or timestamp")


def quantile_bins(df: DataFrame, lead: str, n_bins: int, out: str = "_bin") -> DataFrame:
    """Contiguous, roughly equal-count bins of ``lead`` (ascending): splits
    from one approximate-quantile pass, lookup by binary search (JVM).  A null
    has the bin -1, below all others, as nulls come first in ascending order;
    NaN has the highest bin."""
    tmp = "_lead_d"
    d = df.withColumn(tmp, _as_double(df, lead))
    qd = QuantileDiscretizer(numBuckets=n_bins, inputCol=tmp, outputCol=out,
                             relativeError=1.0 / (4.0 * n_bins), handleInvalid="keep")
    if d.select(tmp).filter(F.col(tmp).isNotNull()).isEmpty():
        return d.withColumn(out, F.lit(-1)).drop(tmp)      # nothing to take quantiles of
    binned = qd.fit(d).transform(d)
    return binned.withColumn(out, F.when(F.col(tmp).isNull(), F.lit(-1)).otherwise(F.col(out).cast("int"))).drop(tmp)


# Bins of a hash order: few enough that the histogram is small for every task
# (one row per bin and class), while a bin holds 1/4096 of the rows.
HASH_BIN_BITS = 12


def hash_bins(h: Column, bits: int) -> Column:
    """Bins of a non-negative hash of ``bits`` bits by its top bits (monotone
    in the hash; uniform without any pass over the data).  A bin too large to
    sort is refined by :func:`keys_at_ranks`."""
    return F.shiftright(h, bits - HASH_BIN_BITS)


# Rows one task may sort to find a key inside a boundary bin; larger bins are
# refined first (see keys_at_ranks).
MAX_SORT_ROWS = 1_000_000
_MAX_REFINE_DEPTH = 6


def _pick_sorted(b: DataFrame, targets: DataFrame, group_col: str, order_cols: list[str],
                 key_cols: list[str]) -> DataFrame:
    """Sort only the target bins and take the rows at the wanted offsets."""
    tb = F.broadcast(targets.select(group_col, "r", "_bin", "_off"))
    cand = b.join(tb.select(group_col, "_bin").distinct(), [group_col, "_bin"], "left_semi")
    wo = Window.partitionBy(group_col, "_bin").orderBy(*(order_cols or key_cols))
    ranked = cand.withColumn("_off", F.row_number().over(wo) - 1)
    key = F.struct(*[F.col(c) for c in key_cols]).alias("key")
    return ranked.join(tb, [group_col, "_bin", "_off"]).select(group_col, "r", key)


def keys_at_ranks(df: DataFrame, group_col: str, order_cols: list[str], ranks: DataFrame,
                  bins: Column | None = None, n_bins: int | None = None,
                  max_sort_rows: int | None = None, key_cols: list[str] | None = None,
                  _depth: int = 0) -> DataFrame:
    """For each ``(group, r)`` row of ``ranks`` (r 0-based), the order key of
    the row at rank r within the group: ``(group, r, key)`` with ``key`` a
    struct of ``order_cols``.  ``bins`` must be monotone in the order (equal
    keys share a bin); by default quantile bins of the leading order column.
    Ranks outside the group are dropped.  ``df`` is read three times; pass a
    materialized or cheap-to-read frame.

    Skew: equal leading values share a bin, so one hot value can make a
    boundary bin hold a large share of the rows.  A boundary bin above
    ``max_sort_rows`` is not sorted; it is refined instead: every leading
    value that alone exceeds the limit becomes its own sub-bin, ordered further
    by the next order column (the leading value is constant there), and the
    ranges between those values are re-binned by fresh quantiles.  When no
    order column is left, all rows of a bin share the key and none is sorted.
    """
    key_cols = list(key_cols or order_cols)
    limit = max_sort_rows or MAX_SORT_ROWS
    want = ranks.select(F.col(group_col), F.col("r").cast("long").alias("r"))
    if not order_cols:
        # the whole key is constant inside each group: every rank maps to it
        per = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"),
                                        F.min(F.struct(*[F.col(c) for c in key_cols])).alias("key"))
        return want.join(per, group_col).filter(F.col("r") < F.col("_n")).select(group_col, "r", "key")
    if bins is None:
        b = quantile_bins(df, order_cols[0], n_bins or default_bins(df.sparkSession))
    else:
        b = df.withColumn("_bin", bins)
    hist = b.groupBy(group_col, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group_col).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    cum = hist.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # one row per wanted rank: at most (#groups x #ranks) rows, tiny
    targets = (want.join(cum, group_col)
               .filter((F.col("r") >= F.col("_before")) & (F.col("r") < F.col("_before") + F.col("_n")))
               .select(group_col, "r", "_bin", (F.col("r") - F.col("_before")).alias("_off"), "_n"))
    if _depth >= _MAX_REFINE_DEPTH:
        return _pick_sorted(b, targets, group_col, order_cols, key_cols)
    targets = materialize(targets)
    small = _pick_sorted(b, targets.filter(F.col("_n") <= limit), group_col, order_cols, key_cols)
    large = targets.filter(F.col("_n") > limit)
    if large.isEmpty():
        return small

    # rows of the large bins, regrouped by (group, bin); ranks become offsets in the bin
    gb = F.struct(F.col(group_col).alias("g"), F.col("_bin").alias("b"))
    sub = (b.join(F.broadcast(large.select(group_col, "_bin").distinct()), [group_col, "_bin"], "left_semi")
           .withColumn("_gb", gb).drop("_bin"))
    lead = order_cols[0]
    hot = materialize(sub.groupBy("_gb", lead).agg(F.count(F.lit(1)).alias("_c"))
                      .filter(F.col("_c") > limit)
                      .groupBy("_gb").agg(F.array_sort(F.collect_list(lead)).alias("_hot")))
    sub = (sub.join(F.broadcast(hot), "_gb", "left")
           .withColumn("_hot", F.coalesce(F.col("_hot"), F.array().cast(hot.schema["_hot"].dataType))))
    is_hot = F.array_contains(F.col("_hot"), F.col(lead))
    below = F.size(F.filter(F.col("_hot"), lambda h: h < F.col(lead)))
    sub = sub.withColumn("_is_hot", is_hot).withColumn("_sb", below * 2 + is_hot.cast("int")).drop("_hot")
    sub_ranks = large.select(gb.alias("_gb"), F.col("_off").alias("r"), F.col(group_col).alias("_g0"),
                             F.col("r").alias("_r0"))
    # second-level targets: which sub-bin of (group, bin) holds each wanted offset
    h2 = sub.groupBy("_gb", "_sb", "_is_hot").agg(F.count(F.lit(1)).alias("_n"))
    w2 = Window.partitionBy("_gb").orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    c2 = h2.withColumn("_before", F.coalesce(F.sum("_n").over(w2), F.lit(0)))
    t2 = materialize(sub_ranks.join(c2, "_gb")
                     .filter((F.col("r") >= F.col("_before")) & (F.col("r") < F.col("_before") + F.col("_n")))
                     .select(F.struct("_gb", "_sb").alias("_g2"), (F.col("r") - F.col("_before")).alias("r"),
                             "_is_hot", "_g0", "_r0"))
    sub = sub.withColumn("_g2", F.struct("_gb", "_sb"))
    parts = []
    for hot_part in (True, False):
        t = t2.filter(F.col("_is_hot") == F.lit(hot_part))
        if t.isEmpty():
            continue
        rows = sub.filter(F.col("_is_hot") == F.lit(hot_part)).join(
            F.broadcast(t.select("_g2").distinct()), "_g2", "left_semi")
        cols = order_cols[1:] if hot_part else order_cols     # the leading value is constant in a hot sub-bin
        got = keys_at_ranks(rows, "_g2", cols, t.select("_g2", "r"), n_bins=n_bins, max_sort_rows=limit,
                            key_cols=key_cols, _depth=_depth + 1)
        parts.append(got.join(F.broadcast(t.select("_g2", "r", "_g0", "_r0")), ["_g2", "r"])
                     .select(F.col("_g0").alias(group_col), F.col("_r0").alias("r"), "key"))
    out = small
    for p_ in parts:
        out = out.unionByName(p_)
    return out


def running_totals(df: DataFrame, order_cols: list[str], values: dict[str, Column] | None = None,
                   group_cols: list[str] | tuple = (), descending: bool = False,
                   n_buckets: int | None = None, index_col: str | None = "_idx",
                   max_groups: int | None = None, following: dict[str, Column] | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` (name -> expression) and a 0-based
    row index ``index_col`` within ``group_cols`` in ``order_cols`` order.

    ``following`` (name -> expression) adds the expression's value at the next
    row, null at the last row of a group.  The offsets table carries the first
    row of each range over to the range before, so no second pass and no join
    on an index is needed.

    ``descending`` orders every order column descending.  Rows with equal
    order keys get consecutive indexes in arbitrary order, like
    ``row_number``; callers pass unique keys.

    The offsets table has one row per (group, range).  Without groups, or when
    the caller knows the number of groups (``max_groups``, e.g. 2 for a
    binary label), its size is bounded by construction and it is broadcast;
    otherwise it is joined normally and AQE decides from runtime sizes.
    """
    group_cols = list(group_cols)
    values, following = dict(values or {}), dict(following or {})
    n = n_buckets or default_bins(df.sparkSession)
    ocols = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    if isinstance(df.schema[order_cols[0]].dataType, StringType):
        # text has no quantiles: ranges of the whole order key, written once so that the numbers of the ranges stay
        b = materialize(df.repartitionByRange(n, *ocols).withColumn("_bucket", F.spark_partition_id()))
    else:
        b = quantile_bins(df, order_cols[0], n, "_bucket")
        if descending:
            b = b.withColumn("_bucket", F.lit(n + 1) - F.col("_bucket"))
    b = b.withColumns({f"_v_{k}": v for k, v in values.items()})
    w = (Window.partitionBy(*group_cols, "_bucket").orderBy(*ocols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = {k: F.sum(f"_v_{k}").over(w) for k in values}
    if index_col:
        local[index_col] = F.count(F.lit(1)).over(w) - 1
    if following:
        b = b.withColumn("_f", F.struct(*[v.alias(k) for k, v in following.items()]))
        local["_next"] = F.lead("_f").over(Window.partitionBy(*group_cols, "_bucket").orderBy(*ocols))
    b = b.withColumns(local)

    tot_cols = [F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values]
    if index_col:
        tot_cols.append(F.count(F.lit(1)).alias("_t__n"))
    if following:
        first = F.max_by if descending else F.min_by
        tot_cols.append(first("_f", F.struct(*order_cols)).alias("_first"))
    totals = b.groupBy(*group_cols, "_bucket").agg(*tot_cols)
    wo = (Window.partitionBy(*group_cols).orderBy("_bucket")
          .rowsBetween(Window.unboundedPreceding, -1))
    offs = totals.select(*group_cols, "_bucket",
                         *[F.coalesce(F.sum(f"_t_{k}").over(wo), F.lit(0)).alias(f"_o_{k}") for k in values],
                         *([F.coalesce(F.sum("_t__n").over(wo), F.lit(0)).alias("_o__n")] if index_col else []),
                         *([F.lead("_first").over(Window.partitionBy(*group_cols).orderBy("_bucket")).alias("_o__first")]
                           if following else []))
    groups = 1 if not group_cols else max_groups
    if groups is not None and groups * (n + 3) <= _OFFSET_BROADCAST_ROWS:
        offs = F.broadcast(offs)
    # null group values are groups like others, so the join is null-safe
    offs = offs.select(*[F.col(c).alias(f"_g_{c}") for c in [*group_cols, "_bucket"]],
                       *[c for c in offs.columns if c.startswith("_o_")])
    same = F.lit(True)
    for c in [*group_cols, "_bucket"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = b.join(offs, same).drop(*[f"_g_{c}" for c in [*group_cols, "_bucket"]])
    fixes = {k: F.col(k) + F.col(f"_o_{k}") for k in values}
    if index_col:
        fixes[index_col] = F.col(index_col) + F.col("_o__n")
    fixes.update({k: F.coalesce("_next", "_o__first").getField(k) for k in following})
    out = out.withColumns(fixes)
    drop = ["_bucket", "_f", "_next", "_o__first"] + [f"_v_{k}" for k in values] + [f"_o_{k}" for k in values] + (["_o__n"] if index_col else [])
    return out.drop(*drop)


def row_index(df: DataFrame, order_cols: list[str], group_cols=(), index_col: str = "_idx",
              n_buckets: int | None = None, max_groups: int | None = None) -> DataFrame:
    """0-based ``row_number() - 1`` within ``group_cols`` ordered by ``order_cols``."""
    return running_totals(df, order_cols, None, group_cols, n_buckets=n_buckets, index_col=index_col,
                          max_groups=max_groups)


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """``k`` best rows per group; planned as a per-partition group limit
    (WindowGroupLimit) before the shuffle, so only k rows per group and
    partition move."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
