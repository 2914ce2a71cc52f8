"""Monthly indicator tables (station x JAN..DEC [+ ACUM]): build, clean,
melt to long form, year-to-date ranking, total-vs-indicator join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.functions import rates
from vigia.functions.text import double_or_zero, number_or
from pyspark.sql.types import StringType

# Month column names of the indicator sheet, in calendar order,
# and the name of the year-to-date column.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
YTD = "ACUM"


def wide_from_exposure(exposure: DataFrame, accidents: str = "N_AT", with_ytd: bool = True) -> DataFrame:
    """Station x month IF table in one aggregation: per month the IF of that
    month's sums (0 when the month has no hours), ``ACUM`` the IF of all months.

    Conditional sums instead of ``pivot`` keep it to a single pass with known
    output columns."""
    mes = F.col("Mes").cast("int")
    aggs = []
    for i, m in enumerate(MONTHS, start=1):
        aggs.append(F.sum(F.when(mes == i, F.col(accidents))).alias(f"_n{i}"))
        aggs.append(F.sum(F.when(mes == i, F.col("HHT"))).alias(f"_h{i}"))
    if with_ytd:
        aggs += [F.sum(accidents).alias("_n0"), F.sum("HHT").alias("_h0")]
    g = exposure.groupBy("Estacion").agg(*aggs)
    cols = [F.col("Estacion")] + [rates.calc_if(f"_n{i}", f"_h{i}").alias(m) for i, m in enumerate(MONTHS, start=1)]
    if with_ytd:
        cols.append(rates.calc_if("_n0", "_h0").alias(YTD))
    return g.select(*cols)


def clean_indicator(df: DataFrame) -> DataFrame:
    """Keep rows whose station text is longer than one character, coerce
    month / ACUM cells to numbers (unparsable -> 0)."""
    value_cols = [c for c in df.columns if c in MONTHS or c == YTD]
    out = df.filter(F.length(F.col("Estacion").cast("string")) > 1)
    conv = {}
    for c in value_cols:
        conv[c] = number_or(c, 0.0) if isinstance(df.schema[c].dataType, StringType) else double_or_zero(c)
    return out.withColumns(conv)


def melt_months(total: DataFrame, months: list[str] = MONTHS) -> DataFrame:
    """Stations with a positive year-to-date IF, one row per (station, month)
    with a positive IF."""
    src = total.filter(F.col(YTD) > 0).select("Estacion", *months)
    long = src.unpivot(["Estacion"], months, "Mes", "IF")
    return long.filter(F.col("IF") > 0)


def ytd_ranking(total: DataFrame) -> DataFrame:
    """Year-to-date IF per active station, highest first, with its level."""
    return (total.filter(F.col(YTD) > 0)
            .select("Estacion", F.col(YTD).alias("IF_YTD"), rates.if_level(F.col(YTD)).alias("Nivel"))
            .orderBy(F.desc("IF_YTD"), "Estacion"))


def total_vs_indicator(total: DataFrame, indicator: DataFrame, months: list[str] = MONTHS) -> DataFrame:
    """Left join of the total IF table with the indicator IF table on the
    station; a station repeated on the right multiplies rows like any left
    join.  All values rounded to 3 decimals."""
    left = total.select("Estacion", *[F.col(m).alias(f"IF_{m}") for m in months], F.col(YTD).alias("IF_ACUM"))
    right = indicator.select("Estacion", *[F.col(m).alias(f"IF_IND_{m}") for m in months])
    # the right side is one row per station; no hint — AQE broadcasts it from
    # runtime sizes when small and keeps a shuffle join otherwise
    j = left.join(right, "Estacion", "left")
    vals = [c for c in j.columns if c != "Estacion"]
    return j.select("Estacion", *[F.round(c, 3).alias(c) for c in vals])
