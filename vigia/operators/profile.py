"""Column profile (count, mean, sample std, min, quartiles, max), preview and
the monthly-series mean/alert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.functions import rates
from vigia.operators.quantiles import ACCURACY, exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)

# exact mean (DECIMAL sum): a mean that sits on a rounding tie does not depend on the order in which partitions are added
_MOMENTS = {"count": F.count, "mean": lambda v: F.avg(v.cast("decimal(38,12)")), "std": F.stddev_samp, "min": F.min,
            "max": F.max}


def profile_numeric(df: DataFrame, cols: list[str], n_bins: int | None = None) -> DataFrame:
    """One row per column with the statistics of a describe(): count, mean,
    sample standard deviation, min, 25/50/75 % (linear interpolation between
    the two closest ranks, exact), max.  A column without values has no row.

    Moments and quartile sketches of all columns are one aggregate row; exact
    quartiles take two more scans (:func:`vigia.operators.quantiles.exact_quantiles`).
    ``n_bins`` sets the accuracy of the sketch, not that of the result.
    """
    row, quart = exact_quantiles(df, cols, QUARTILES, _MOMENTS, accuracy=n_bins or ACCURACY)
    rows = [(c, row[f"count{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"],
             *[quart[c, q] for q in QUARTILES], row[f"max{i}"]) for i, c in enumerate(cols) if row[f"count{i}"]]
    out = df.sparkSession.createDataFrame(
        rows, "column string, count bigint, mean decimal(38,16), std double, min double, p25 double, p50 double, "
              "p75 double, max double")
    return out.select("column", "count", F.round("mean", 6).cast("double").alias("mean"),
                      F.round("std", 6).alias("std"), "min", F.round("p25", 6).alias("p25"),
                      F.round("p50", 6).alias("p50"), F.round("p75", 6).alias("p75"), "max")


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """First ``n`` rows in a deterministic order (planned as a top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n)


def monthly_alert(series: DataFrame) -> DataFrame:
    """Mean monthly accidents rounded to 2 and the alert text."""
    m = series.agg(F.avg("Accidentes").alias("m"))
    return m.select(F.round("m", 2).alias("Accidentes_promedio"), rates.accident_alert(F.col("m")).alias("alerta"))
