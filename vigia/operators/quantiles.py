"""Exact quantiles of many numeric columns from a few wide scans.

A mergeable sketch gives, per column and fraction, two cut values that enclose
the wanted ranks; one counting scan makes the number of values below and
between the cuts exact; the few values in between are then counted by value and
read at their rank.  Every scan is one aggregate row with partial aggregation
(no row is shuffled), and only the values between the cuts, a few in
``ACCURACY``, are grouped.  A stretch of more than ``MAX_SORT_ROWS`` values is
cut again by a sketch of itself, so the last step stays small at any input
size; cuts that meet in one value (a hot value) need no last step at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: its ranks are off by at most one in so many.
ACCURACY = 10_000
#: Values between two cuts that one task may order.
MAX_SORT_ROWS = 1_000_000


def number(df: DataFrame, col: str) -> Column:
    """The column as a double; NaN counts as no value."""
    v = F.col(f"`{col}`").cast("double")
    return F.when(~F.isnan(v), v)


class _Cut:
    """A stretch ``lo``..``hi`` that is to hold the ranks ``r0`` <= ``r1`` of column ``v{i}``."""

    def __init__(self, i: int, fraction: float, n: int, low: float, high: float):
        at = (n - 1) * fraction
        self.i, self.r0, self.r1, self.part = i, math.floor(at), math.ceil(at), at - math.floor(at)
        self.lo, self.hi, self.least, self.most = low, high, low, high
        self.below, self.inside, self.found, self.tight = 0, n, None, False    # tight: not to be cut again

    @property
    def col(self) -> Column:
        return F.col(f"v{self.i}")

    @property
    def within(self) -> Column:
        return self.col.between(self.lo, self.hi)

    def fractions(self, accuracy: int) -> list[float]:
        """Where the sketch of the stretch is asked: the wanted ranks, twice its error to both sides."""
        n = max(self.inside - 1, 1)
        slack = 2.0 / accuracy
        return [max(0.0, (self.r0 - self.below) / n - slack), min(1.0, (self.r1 - self.below) / n + slack)]

    def value(self) -> float:
        a, b = self.found
        return a + (b - a) * self.part


def _sketch(cut: _Cut, accuracy: int) -> Column:
    ask = F.array(*[F.lit(f) for f in cut.fractions(accuracy)])
    return F.percentile_approx(F.when(cut.within, cut.col), ask, F.lit(accuracy))


def _narrow(cut: _Cut, ends: list[float]) -> None:
    lo, hi = max(cut.lo, ends[0]), min(cut.hi, ends[1])
    cut.tight = (lo, hi) == (cut.lo, cut.hi)                 # hot values fill it, which grouping by value makes few
    cut.lo, cut.hi = lo, hi


def _count(vals: DataFrame, cuts: list[_Cut]) -> None:
    """Exact numbers of values below and within each stretch."""
    row = vals.agg(*[F.count_if(c.col < c.lo).alias(f"b{k}") for k, c in enumerate(cuts)],
                   *[F.count_if(c.within).alias(f"n{k}") for k, c in enumerate(cuts)]).first()
    for k, c in enumerate(cuts):
        c.below, c.inside = row[f"b{k}"], row[f"n{k}"]


def _read(vals: DataFrame, cuts: list[_Cut]) -> None:
    """The values at the wanted ranks from the values within the stretches, counted by value (one scan)."""
    each = F.array(*[F.when(c.within, F.struct(F.lit(k).alias("k"), c.col.alias("v"))) for k, c in enumerate(cuts)])
    some = vals.select(F.explode(F.array_compact(each)).alias("s")).select("s.k", "s.v")
    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = some.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(w))
    holds = F.lit(False)
    for k, c in enumerate(cuts):
        for r in {c.r0 - c.below, c.r1 - c.below}:
            holds = holds | ((F.col("k") == k) & (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r))
    got: dict[int, list[float]] = {}
    for r in upto.filter(holds).select("k", "v").collect():        # at most two values a stretch
        got.setdefault(r["k"], []).append(r["v"])
    for k, c in enumerate(cuts):
        c.found = (min(got[k]), max(got[k]))


def exact_quantiles(df: DataFrame, cols: list[str], fractions: tuple[float, ...],
                    stats: dict[str, Callable[[Column], Column]] | None = None, accuracy: int = ACCURACY,
                    max_sort_rows: int = MAX_SORT_ROWS) -> tuple[Row, dict[tuple[str, float], float | None]]:
    """Quantiles by linear interpolation between the two closest ranks, exact,
    per (column, fraction); null for a column without values.  Nulls and NaN
    are no values.  ``stats`` (name -> aggregate of a column) are computed in
    the first scan; the returned row has them as ``name`` + column number.

    Three scans of ``df`` as a rule: sketch, count, read.  What reaches the
    driver is one aggregate row a scan and two values per quantile."""
    vals = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    ask = F.array(*[F.lit(min(1.0, max(0.0, f + s * 2.0 / accuracy))) for f in fractions for s in (-1, 1)])
    first = vals.agg(*[fn(F.col(f"v{i}")).alias(f"{name}{i}") for i in range(len(cols)) for name, fn in (stats or {}).items()],
                     *[a for i in range(len(cols)) for a in (
                         F.count(f"v{i}").alias(f"_n{i}"), F.min(f"v{i}").alias(f"_lo{i}"),
                         F.max(f"v{i}").alias(f"_hi{i}"),
                         F.percentile_approx(f"v{i}", ask, F.lit(accuracy)).alias(f"_q{i}"))]).first()
    cuts = {}
    for i, c in enumerate(cols):
        for k, f in enumerate(fractions):
            if first[f"_n{i}"]:
                cut = cuts[c, f] = _Cut(i, f, first[f"_n{i}"], first[f"_lo{i}"], first[f"_hi{i}"])
                _narrow(cut, first[f"_q{i}"][2 * k:2 * k + 2])
    todo = list(cuts.values())
    while todo:
        _count(vals, todo)
        wide, ready = [], []
        for c in todo:
            if c.r0 < c.below:
                c.lo, c.tight = c.least, True                # the sketch was off: back to the end it had before
                wide.append(c)
            elif c.r1 >= c.below + c.inside:
                c.hi, c.tight = c.most, True
                wide.append(c)
            elif c.lo == c.hi:
                c.found = (c.lo, c.lo)
            elif c.inside <= max_sort_rows or c.tight:
                ready.append(c)
            else:
                c.least, c.most = c.lo, c.hi
                wide.append(c)
        if ready:
            _read(vals, ready)
        again = [c for c in wide if not c.tight]
        if again:
            row = vals.agg(*[_sketch(c, accuracy).alias(f"q{k}") for k, c in enumerate(again)]).first()
            for k, c in enumerate(again):
                _narrow(c, row[f"q{k}"])
        todo = wide
    return first, {(c, f): cuts[c, f].value() if (c, f) in cuts else None for c in cols for f in fractions}
