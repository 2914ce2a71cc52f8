"""Rate board over an exposure table: cleaning, global KPIs and IF/IS per
station, population and month.

Every aggregate sums first and derives ratios after (never a mean of
ratios).  Each grouping is one ``HashAggregate`` with map-side partial
aggregation, so a station that holds a third of all rows still shuffles
only one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vigia.functions import rates
from vigia.functions.text import double_or_zero, number_or

MEASURES = ["N_AT", "N_AT_IND", "N_Dias_Total", "N_Dias_Ind", "HHT", "IF", "IF_IND", "IS"]
BOARD_COLUMNS = ["Mes", "Meses", "Unidad_Negocio", "Estacion", "Poblacion"] + MEASURES


def _numeric(df: DataFrame, c: str):
    # text cells are parsed strictly; typed columns only lose null/NaN
    if isinstance(df.schema[c].dataType, StringType):
        return number_or(c, 0.0)
    return double_or_zero(c)


def clean_exposure(df: DataFrame, fuente: str | None = None, keep_zero_incident_rows: bool = False) -> DataFrame:
    """Board cleaning: drop rows without month and repeated header rows,
    coerce measures to numbers (unparsable -> 0), and — like the board —
    drop rows without accidents *before* any sum (``keep_zero_incident_rows``
    keeps their hours).  ``fuente`` tags the block when the input has none."""
    mes_txt = F.col("Mes").cast("string")
    out = df.filter(F.col("Mes").isNotNull() & (mes_txt != F.lit("Mes")))
    out = out.withColumns({c: _numeric(df, c) for c in MEASURES})
    if not keep_zero_incident_rows:
        out = out.filter(F.col("N_AT") > 0)
    if fuente is not None:
        out = out.withColumn("fuente", F.lit(fuente))
    return out


def _sums(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("N_AT").alias("N_AT"),
                                 F.sum("N_Dias_Total").alias("N_Dias"),
                                 F.sum("HHT").alias("HHT"))


def _with_rates(df: DataFrame, severity: bool = True, level: bool = True) -> DataFrame:
    cols = {"IF": rates.calc_if("N_AT", "HHT"), "IS": rates.calc_is("N_Dias", "HHT")}
    out = df.withColumns(cols)
    if severity:
        out = out.withColumn("Severidad", rates.calc_severity("N_AT", "N_Dias"))
    if level:
        out = out.withColumn("Nivel_IF", rates.if_level("IF"))
    return out


def board_kpis(exposure: DataFrame) -> DataFrame:
    """One-row global KPIs: accidents and days truncated to integers, hours,
    IF, IS, mean severity, ILI and IF level."""
    s = exposure.agg(F.sum("N_AT").alias("n"), F.sum("N_Dias_Total").alias("d"), F.sum("HHT").alias("h"))
    s = s.select(F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("N_AT"),
                 F.coalesce(F.col("d"), F.lit(0.0)).cast("long").alias("N_Dias"),
                 F.coalesce(F.col("h"), F.lit(0.0)).alias("HHT"))
    s = s.withColumns({"IF": rates.calc_if("N_AT", "HHT"), "IS": rates.calc_is("N_Dias", "HHT"),
                       "Severidad": rates.calc_severity("N_AT", "N_Dias")})
    return s.withColumns({"ILI": rates.calc_ili("IF", "IS"), "Nivel_IF": rates.if_level("IF")}) \
            .withColumn("HHT", F.round("HHT", 3))


def rates_by_station(exposure: DataFrame) -> DataFrame:
    """Per-station sums and rates, stations with accidents only, highest IF first."""
    out = _with_rates(_sums(exposure, ["Estacion"])).filter(F.col("N_AT") > 0)
    return out.select("Estacion", "N_AT", "N_Dias", F.round("HHT", 3).alias("HHT"), "IF", "IS",
                      "Severidad", "Nivel_IF").orderBy(F.desc("IF"), "Estacion")


def station_rates(exposure: DataFrame, station: str) -> DataFrame:
    """KPIs of one selected station (the single-station view of the board)."""
    return board_kpis(exposure.filter(F.col("Estacion") == F.lit(station))) \
        .withColumn("Estacion", F.lit(station))


def rates_by_population_topk(exposure: DataFrame, k: int = 12, by: str = "IF") -> DataFrame:
    """Per station, the ``k`` populations with the highest IF (accidents > 0),
    ranked by ``by`` (IF or IS): the order of the view never changes which
    populations it shows.

    All stations in one job: the window runs on the aggregated rows and
    Spark plans it with a per-partition group limit before the shuffle."""
    g = _with_rates(_sums(exposure, ["Estacion", "Poblacion"]), severity=False, level=False) \
        .filter(F.col("N_AT") > 0)
    w = Window.partitionBy("Estacion").orderBy(F.desc("IF"), F.asc("Poblacion"))
    top = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if by != "IF":      # at most k rows a station
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy("Estacion").orderBy(F.desc(by), F.asc("Poblacion"))))
    return (top.select("Estacion", "Poblacion", "rank", "N_AT", "N_Dias", F.round("HHT", 3).alias("HHT"), "IF", "IS"))


def rates_by_month(exposure: DataFrame) -> DataFrame:
    """Per station and month sums and rates, rounded to 3 decimals."""
    g = _with_rates(_sums(exposure, ["Estacion", "Mes"]), severity=False, level=False)
    return g.select("Estacion", F.col("Mes").cast("int").alias("Mes"),
                    *[F.round(c, 3).alias(c) for c in ("N_AT", "N_Dias", "HHT", "IF", "IS")])


def rates_grouping_sets(exposure: DataFrame) -> DataFrame:
    """Global, station, station x population and station x month rates in ONE
    aggregation pass (``GROUPING SETS``): a single scan and a single shuffle
    serve the whole board."""
    e = exposure.withColumn("Mes", F.col("Mes").cast("int"))
    g = e.groupingSets([[], ["Estacion"], ["Estacion", "Poblacion"], ["Estacion", "Mes"]],
                       "Estacion", "Poblacion", "Mes") \
         .agg(F.sum("N_AT").alias("N_AT"), F.sum("N_Dias_Total").alias("N_Dias"), F.sum("HHT").alias("HHT"),
              F.grouping_id().alias("gid"))
    grain = (F.when(F.col("gid") == 7, F.lit("global"))
             .when(F.col("gid") == 3, F.lit("estacion"))
             .when(F.col("gid") == 1, F.lit("estacion_poblacion"))
             .otherwise(F.lit("estacion_mes")))
    out = _with_rates(g.withColumn("grain", grain))
    return out.select("grain", "Estacion", "Poblacion", "Mes", "N_AT", "N_Dias",
                      F.round("HHT", 3).alias("HHT"), "IF", "IS", "Severidad", "Nivel_IF")


def what_if(exposure: DataFrame, days: float = 3.0, keys=("Estacion", "Mes")) -> DataFrame:
    """What-if per scenario row: IF of one accident and IS of ``days`` lost days
    for the scenario's hours, and the gap to the IF target (hours > 0 only)."""
    s = _hours(exposure, keys)
    return s.select(*keys, F.round("HHT", 3).alias("HHT"),
                    *[v.alias(k) for k, v in rates.what_if(F.col("HHT"), F.lit(float(days))).items()])


def _hours(exposure: DataFrame, keys) -> DataFrame:
    return exposure.groupBy(*keys).agg(F.sum("HHT").alias("HHT")).filter(F.col("HHT") > 0)


def what_if_scenarios(exposure: DataFrame, scenarios: DataFrame, keys=("Estacion", "Mes")) -> DataFrame:
    """What-if of a whole scenario table: rows (escenario, the columns of ``keys`` or null for all, horas or null for the
    group's own, factor_horas, dias) against every group of the exposure that they name.

    A scenario that names the keys meets its group in an equi-join; one that leaves a key null is listed for each value of
    that key, from the groups themselves, so no row pairs are made but the wanted ones.  Hours are the scenario's, or
    the group's, times the factor; rows without hours are left out, like the single form."""
    keys = list(keys)
    groups = _hours(exposure, keys)
    out = None
    for n in range(1 << len(keys)):
        named = [k for i, k in enumerate(keys) if n >> i & 1]
        some = scenarios.filter(" and ".join(f"`{k}` is {'not ' if k in named else ''}null" for k in keys))
        some = some.select("escenario", "horas", "factor_horas", "dias", *named)
        if named:
            part = groups.join(some, named)
        else:   # scenarios for all groups: the list goes along as one value
            every = some.agg(F.collect_list(F.struct("escenario", "horas", "factor_horas", "dias")).alias("s")).scalar()
            part = groups.withColumn("s", F.explode(every)).select(*keys, "HHT", "s.*")
        part = part.select("escenario", *keys, "HHT", "horas", "factor_horas", "dias")
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("HHT", F.coalesce("horas", "HHT") * F.coalesce("factor_horas", F.lit(1.0))).filter(F.col("HHT") > 0)
    return out.select("escenario", *keys, F.round("HHT", 3).alias("HHT"), F.col("dias").cast("double").alias("dias"),
                      *[v.alias(k) for k, v in rates.what_if(F.col("HHT"), F.col("dias").cast("double")).items()])


def stations(exposure: DataFrame) -> DataFrame:
    """The distinct stations, sorted (the station picker's list)."""
    return exposure.select("Estacion").filter(F.col("Estacion").isNotNull()).distinct().orderBy("Estacion")
