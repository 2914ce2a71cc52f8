"""Bindings: the shared star-schema test tables re-expressed as the domain tables.

The domain workbooks (exposure board, indicator sheet, case register, monthly
series) are not shipped, so every query runs on proxies derived from
``lineitem -> orders -> customer -> nation -> region`` and ``part``:

* exposure: station = n_name, business unit = r_name, population = c_mktsegment,
  month = month(o_orderdate); accident = ``l_returnflag = 'R'``; the
  "indicator" subset adds ``l_linestatus = 'F'``; lost days =
  ``max(int(l_quantity) - 21, 0)`` over the accident rows; man-hours =
  ``0.6 * sum(l_extendedprice)`` over all rows.  Block GENERAL covers every
  order, block AGIL the orders of priority ``1-URGENT``.
* cases: one row per lineitem row, see :func:`cases_raw`.

Scale notes.  Every read selects only the needed columns (parquet column
pruning).  The exposure proxy aggregates lineitem per order *before* joining,
so the biggest shuffle carries one partial row per order instead of per line,
and the aggregate's hash partitioning on the order key is reused by the
sort-merge join with orders (no second shuffle of that side).  Dimension
tables are broadcast by Spark from their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.functions import rates
from vigia.session import attach_row, materialize, spread

# Fixed values of the proxy definition.
ACCIDENT_FLAG = "R"          # l_returnflag of an accident
INDICATOR_STATUS = "F"       # l_linestatus of the indicator subset
DAYS_OFFSET = 21             # lost days = max(int(quantity) - 21, 0)
HOURS_PER_PRICE = 0.6        # man-hours = 0.6 * extended price
AGIL_PRIORITY = "1-URGENT"   # orders of block AGIL
STATUS_CLASS = {"F": "Leves", "O": "Severos", "P": "Graves"}
SENIORITY_UNKNOWN_MOD = 7    # p_size % 7 == 0 -> "Sin información"
MONTH_NAMES = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

# Unique key of a case row (the order key and line number alone are not unique).
CASE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None,
          spread_on: list[str] | None = None) -> DataFrame:
    """Read a shared table with only ``cols``.  ``spread_on`` names the key a
    fact-table scan is hash-partitioned on when it yields fewer partitions than
    cores (see ``session.spread``); at scale the scan is returned as is."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*cols) if cols else df
    return spread(df, spread_on) if spread_on else df


def lost_days(quantity_col: str = "l_quantity"):
    return F.greatest(F.col(quantity_col).cast("int") - F.lit(DAYS_OFFSET), F.lit(0))


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region (25 rows in the spec).  No hint and no probe: Spark
    broadcasts it from the files' sizes, or from runtime sizes."""
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def exposure_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure at grain (Estacion, Unidad_Negocio, Poblacion, Mes, fuente) with
    integer-exact measures: counts, days and price cents are summed as BIGINT so
    results do not depend on summation order."""
    is_acc = F.col("l_returnflag") == F.lit(ACCIDENT_FLAG)
    is_ind = is_acc & (F.col("l_linestatus") == F.lit(INDICATOR_STATUS))
    days = lost_days()
    li = (table(spark, sf_dir, "lineitem",
                ["l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"],
                spread_on=["l_orderkey"])
          .groupBy("l_orderkey")
          .agg(F.sum(is_acc.cast("long")).alias("n_at"),
               F.sum(is_ind.cast("long")).alias("n_at_ind"),
               F.sum(F.when(is_acc, days).otherwise(0).cast("long")).alias("d_tot"),
               F.sum(F.when(is_ind, days).otherwise(0).cast("long")).alias("d_ind"),
               F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")))
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    per_cust = (li.join(orders, li.l_orderkey == orders.o_orderkey)
                .withColumn("Mes", F.month("o_orderdate"))
                .withColumn("agil", (F.col("o_orderpriority") == F.lit(AGIL_PRIORITY)).cast("long"))
                .groupBy("o_custkey", "Mes", "agil")
                .agg(*[F.sum(c).alias(c) for c in ("n_at", "n_at_ind", "d_tot", "d_ind", "cents")]))
    customer = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    joined = (per_cust.join(customer, per_cust.o_custkey == customer.c_custkey)
              .join(_geo(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")))
    grain = [F.col("n_name").alias("Estacion"), F.col("r_name").alias("Unidad_Negocio"),
             F.col("c_mktsegment").alias("Poblacion"), F.col("Mes")]
    sums = []
    for block, pred in (("GENERAL", F.lit(True)), ("AGIL", F.col("agil") == 1)):
        for c in ("n_at", "n_at_ind", "d_tot", "d_ind", "cents"):
            sums.append(F.sum(F.when(pred, F.col(c)).otherwise(F.lit(0))).cast("long").alias(f"{block}_{c}"))
    wide = joined.groupBy(*grain).agg(*sums)
    blocks = F.explode(F.array(*[
        F.struct(F.lit(b).alias("fuente"),
                 *[F.col(f"{b}_{c}").alias(c) for c in ("n_at", "n_at_ind", "d_tot", "d_ind", "cents")])
        for b in ("GENERAL", "AGIL")]))
    return wide.select("Estacion", "Unidad_Negocio", "Poblacion", "Mes", blocks.alias("b")).select(
        "Estacion", "Unidad_Negocio", "Poblacion", "Mes", "b.*")


def exposure_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board sheet as typed rows, before the board's own cleaning
    (accident-free rows included).  13 board columns plus ``fuente``."""
    m = exposure_measures(spark, sf_dir)
    hht = (F.col("cents") * F.lit(6)).cast("double") / F.lit(1000.0)   # 0.6 * cents / 100, exact
    month_names = F.array(*[F.lit(x) for x in MONTH_NAMES])
    out = m.select(
        F.col("Mes").cast("string").alias("Mes"),
        F.element_at(month_names, F.col("Mes")).alias("Meses"),
        "Unidad_Negocio", "Estacion", "Poblacion",
        F.col("n_at").cast("double").alias("N_AT"),
        F.col("n_at_ind").cast("double").alias("N_AT_IND"),
        F.col("d_tot").cast("double").alias("N_Dias_Total"),
        F.col("d_ind").cast("double").alias("N_Dias_Ind"),
        hht.alias("HHT"),
        "fuente")
    return (out.withColumn("IF", rates.calc_if("N_AT", "HHT"))
               .withColumn("IF_IND", rates.calc_if("N_AT_IND", "HHT"))
               .withColumn("IS", rates.calc_is("N_Dias_Total", "HHT"))
               .select("Mes", "Meses", "Unidad_Negocio", "Estacion", "Poblacion", "N_AT", "N_AT_IND",
                       "N_Dias_Total", "N_Dias_Ind", "HHT", "IF", "IF_IND", "IS", "fuente"))


def cases_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case register (one row per lineitem row) with the register's own
    column names, before cleaning.  Also carries the unique case key."""
    status_map = F.create_map(*[F.lit(x) for kv in STATUS_CLASS.items() for x in kv])
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
                   spread_on=["o_orderkey"])
    customer = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    # orders-sized side first: orders x customer x geo, then the lineitem join.
    ocg = (orders.join(customer, orders.o_custkey == customer.c_custkey)
           .join(_geo(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
           .select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name", "r_name"))
    # both sides spread on the order key (when their scans are narrow): the
    # lineitem join then runs on every core
    li = table(spark, sf_dir, "lineitem",
               ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_linestatus", "l_quantity"],
               spread_on=["l_orderkey"])
    part = table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size"])
    j = (li.join(ocg, li.l_orderkey == ocg.o_orderkey)
           .join(part, F.col("l_partkey") == F.col("p_partkey")))
    seniority_txt = F.when(F.col("p_size") % SENIORITY_UNKNOWN_MOD == 0, F.lit("Sin información")) \
                     .otherwise(F.col("p_size").cast("string"))
    return j.select(
        *CASE_KEY,
        F.element_at(status_map, F.col("o_orderstatus")).alias("Clasificación del accidente"),
        F.col("p_type").alias("Tipo de accidente"),
        F.col("n_name").alias("Estación donde ocurrió"),
        F.col("l_linestatus").alias("Género"),
        F.col("c_mktsegment").alias("Puesto/Cargo"),
        seniority_txt.alias("Antigüedad en años"),
        F.concat(F.lit("1."), F.col("p_type")).alias("Naturaleza"),
        F.concat(F.lit("1."), F.col("p_brand")).alias("Parte del cuerpo afectada"),
        F.concat(F.lit("1."), F.col("o_orderpriority")).alias("Agente de la lesión"),
        F.concat(F.lit("1."), F.col("r_name")).alias("Mecanismo de accidente/ Tipo de contacto"),
        lost_days().cast("string").alias("Total días de incapacidad"),
    )


def scored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic score proxy for exact metric oracles, independent of any
    model: label = lost days > 0, score from a key hash, pred = score >= 0.5."""
    li = table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey", "l_quantity"])
    score = ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 1000).cast("double") / F.lit(1000.0)
    return li.select((lost_days() > 0).cast("int").alias("label"), score.alias("score")) \
             .withColumn("pred", (F.col("score") >= F.lit(0.5)).cast("int"))


def monthly_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series (Mes, Accidentes): accidents per calendar month of the
    order date, ``Mes`` a running month index starting at 1."""
    per_month = _accidents(spark, sf_dir).groupBy("ym").agg(F.sum("n").alias("n"))
    return _month_index(per_month).select("Mes", F.col("n").cast("double").alias("Accidentes"))


def monthly_accidents_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly series of every station (Estacion, Mes, Accidentes), with one month index for all; months without
    an accident have no row."""
    customer = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    per_cust = _accidents(spark, sf_dir).groupBy("o_custkey", "ym").agg(F.sum("n").alias("n"))
    rows = (per_cust.join(customer, per_cust.o_custkey == customer.c_custkey)
            .join(_geo(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("Estacion"), "ym").agg(F.sum("n").alias("n")))
    return _month_index(rows).select("Estacion", "Mes", F.col("n").cast("double").alias("Accidentes"))


def _accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accidents per order (n) with the order's customer and its months since year 0 (ym)."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag"], spread_on=["l_orderkey"]) \
        .filter(F.col("l_returnflag") == F.lit(ACCIDENT_FLAG))
    per_order = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    ym = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    return per_order.join(orders, per_order.l_orderkey == orders.o_orderkey).select("o_custkey", ym.alias("ym"), "n")


def _month_index(rows: DataFrame) -> DataFrame:
    first = rows.agg(F.min("ym").alias("ym0"))
    return attach_row(rows, first).withColumn("Mes", (F.col("ym") - F.col("ym0") + 1).cast("int"))


def board_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board workbook sheet ``Data`` as a cell grid, laid out like the
    original: row 0 a title, row 1 block titles, row 2 the column names, data
    from row 3 with block GENERAL in columns 1-13 and block AGIL in columns
    16-28 side by side, and the header repeated once below the data."""
    from vigia.operators.ordering import row_index
    from vigia.sources.grid import to_cells

    # the aggregated board (stations x populations x months x 2 blocks) feeds the
    # quantile-bin fit, the row-index windows and the header's row count: one copy
    raw = materialize(exposure_raw(spark, sf_dir)).withColumn("mes_i", F.col("Mes").cast("int"))
    txt = raw.select(
        "fuente", "Estacion", "Poblacion", "mes_i",
        "Mes", "Meses", "Unidad_Negocio", F.col("Estacion").alias("Est"), F.col("Poblacion").alias("Pob"),
        *[F.col(c).cast("long").cast("string").alias(c) for c in ("N_AT", "N_AT_IND", "N_Dias_Total", "N_Dias_Ind")],
        F.col("HHT").cast("decimal(20,3)").cast("string").alias("HHT"),
        *[F.col(c).cast("decimal(20,4)").cast("string").alias(c) for c in ("IF", "IF_IND", "IS")])
    idx = row_index(txt, ["Estacion", "Poblacion", "mes_i"], group_cols=["fuente"], max_groups=2)
    board_cols = ["Mes", "Meses", "Unidad_Negocio", "Est", "Pob", "N_AT", "N_AT_IND", "N_Dias_Total",
                  "N_Dias_Ind", "HHT", "IF", "IF_IND", "IS"]
    names = ["Mes", "Meses", "Unidad_Negocio", "Estacion", "Poblacion", "N_AT", "N_AT_IND", "N_Dias_Total",
             "N_Dias_Ind", "HHT", "IF", "IF_IND", "IS"]
    cells = None
    for block, col_from in (("GENERAL", 1), ("AGIL", 16)):
        b = idx.filter(F.col("fuente") == F.lit(block)).select(*board_cols, "_idx")
        # the trailing _idx column becomes one extra cell; keep only the board columns
        c = to_cells(b, F.col("_idx") + 3, col_from, "board", "Data") \
            .filter(F.col("col_no") < col_from + len(board_cols))
        cells = c if cells is None else cells.unionByName(c)
    n_rows = idx.filter(F.col("fuente") == F.lit("GENERAL")).agg(F.count(F.lit(1)).alias("n"))
    header = spark.createDataFrame(
        [(0, 0, "Tablero Accidentalidad"), (1, 1, "GENERAL"), (1, 16, "AGIL")]
        + [(2, 1 + i, n) for i, n in enumerate(names)] + [(2, 16 + i, n) for i, n in enumerate(names)]
        + [(-1, 1 + i, n) for i, n in enumerate(names)] + [(-1, 16 + i, n) for i, n in enumerate(names)],
        "row_no int, col_no int, value string")
    # row -1 is the repeated header: placed right after the last data row
    header = attach_row(header, n_rows).select(
        F.lit("board").alias("source"), F.lit("Data").alias("sheet"),
        F.when(F.col("row_no") == -1, F.col("n") + 3).otherwise(F.col("row_no")).cast("int").alias("row_no"),
        "col_no", "value")
    # the landed sheet: written once, promotion and slicing read the copy
    return materialize(cells.unionByName(header))


def indicator_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet ``Data Indicadores`` of the workbook as a cell grid: row 0 a title, row 1 the column names, data from row
    2 in the order of the stations, the total table (station, months, ACUM) in columns 1-14 and the indicator table
    (station, months) in columns 16-28."""
    from vigia.operators import indicators as ind
    from vigia.operators.ordering import row_index
    from vigia.sources.grid import to_cells

    raw = exposure_raw(spark, sf_dir).filter(F.col("fuente") == F.lit("GENERAL"))
    raw = materialize(raw.select("Estacion", "Mes", "N_AT", "N_AT_IND", "HHT"))
    cells = None
    for accidents, ytd, col_from in (("N_AT", True, 1), ("N_AT_IND", False, 16)):
        names = ["Estacion", *MONTH_NAMES, *(["ACUM"] if ytd else [])]
        wide = row_index(ind.wide_from_exposure(raw, accidents, with_ytd=ytd), ["Estacion"])
        text = wide.select("Estacion", *[F.col(c).cast("decimal(20,4)").cast("string").alias(c) for c in names[1:]], "_idx")
        part = to_cells(text, F.col("_idx") + 2, col_from, "board", "Data Indicadores").filter(F.col("col_no") < col_from + len(names))
        head = spark.createDataFrame([(1, col_from + i, n) for i, n in enumerate(names)], "row_no int, col_no int, value string")
        head = head.select(F.lit("board").alias("source"), F.lit("Data Indicadores").alias("sheet"), "row_no", "col_no", "value")
        part = part.unionByName(head)
        cells = part if cells is None else cells.unionByName(part)
    return materialize(cells)


def workbook_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sheets of the board workbook."""
    return board_grid(spark, sf_dir).unionByName(indicator_grid(spark, sf_dir))
