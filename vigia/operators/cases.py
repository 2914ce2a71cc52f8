"""Case-register operators: schema handling, cleaning into the model table,
overview aggregates and filtered extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.functions import text as T
from vigia.operators.quantiles import exact_quantiles
from vigia.session import materialize

# Register column names as exported (accented), their plain
# spelling, and the model column names, in register order.
SOURCE_TO_PLAIN = {
    "Clasificación del accidente": "Clasificacion del accidente",
    "Tipo de accidente": "Tipo de accidente",
    "Estación donde ocurrió": "Estacion donde ocurrio",
    "Género": "Genero",
    "Puesto/Cargo": "Puesto/Cargo",
    "Antigüedad en años": "Antiguedad en anos",
    "Naturaleza": "Naturaleza",
    "Parte del cuerpo afectada": "Parte del cuerpo afectada",
    "Agente de la lesión": "Agente de la lesion",
    "Mecanismo de accidente/ Tipo de contacto": "Mecanismo de accidente/ Tipo de contacto",
    "Total días de incapacidad": "Total dias de incapacidad",
}
PLAIN_TO_MODEL = {
    "Clasificacion del accidente": "clasificacion",
    "Tipo de accidente": "tipo",
    "Estacion donde ocurrio": "estacion",
    "Genero": "genero",
    "Puesto/Cargo": "cargo",
    "Antiguedad en anos": "antiguedad",
    "Naturaleza": "naturaleza",
    "Parte del cuerpo afectada": "parte_cuerpo",
    "Agente de la lesion": "agente",
    "Mecanismo de accidente/ Tipo de contacto": "mecanismo",
    "Total dias de incapacidad": "dias_incapacidad",
}
KEY_COLS = list(PLAIN_TO_MODEL)
CATEGORICAL = ["clasificacion", "tipo", "estacion", "genero", "cargo", "naturaleza", "parte_cuerpo",
               "agente", "mecanismo"]
TARGETS = ["con_incapacidad", "incapacidad_alta"]
DAYS = "dias_incapacidad"
HIGH_LEAVE_DAYS = 5
# Display columns of the data view, in display order (absent ones are skipped).
SHOW_COLS = ["ID Reporte", "Fecha de ocurrencia", "Mes", "Clasificacion del accidente", "Tipo de accidente",
             "Genero", "Puesto/Cargo", "Antiguedad en anos", "Naturaleza", "Parte del cuerpo afectada",
             "Agente de la lesion", "Mecanismo de accidente/ Tipo de contacto", "Total dias de incapacidad"]
SEVERE_CLASS = "Graves"


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by map; names not present are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def rename_positional(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def require_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def select_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted columns that exist, in wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose every value is null: one aggregate pass returns one
    count per column (a single small row), then a projection."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if counts[f"c{i}"] > 0]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def normalize_names(raw: DataFrame) -> DataFrame:
    """Accented register names -> plain names (the overview works on these)."""
    return rename(raw, SOURCE_TO_PLAIN)


def prepare(raw: DataFrame, keep: list[str] | tuple = (), trim: bool = True,
            strict: bool = True, seniority_median: bool = False) -> DataFrame:
    """Register -> model table.

    * names: accented -> plain -> model names; ``strict`` raises on missing
      columns, otherwise absent columns are skipped (days default to 0);
    * days: text -> number, unparsable -> 0;
    * seniority: trimmed text, sentinels/unparsable -> 5 (or first the median
      of the parsable values with ``seniority_median``, which computes the
      table once and reads the median by :func:`exact_quantiles`);
    * targets: ``con_incapacidad = days > 0``, ``incapacidad_alta = days >= 5``;
    * categories: null -> "Sin informacion", trimmed (``trim``).
    ``keep`` passes extra columns (e.g. the case key) through unchanged.
    """
    df = normalize_names(raw)
    if strict:
        require_columns(df, KEY_COLS)
    avail = [c for c in KEY_COLS if c in df.columns]
    m = df.select(*[F.col(k) for k in keep], *[F.col(f"`{c}`").alias(PLAIN_TO_MODEL[c]) for c in avail])
    cols = {}
    cols[DAYS] = T.number_or(DAYS, 0.0) if DAYS in m.columns else F.lit(0.0)
    if "antiguedad" in m.columns:
        if seniority_median:
            cols["antiguedad"] = T.parse_number(T.sentinel_to_null(T.strip(F.col("antiguedad").cast("string")),
                                                                   T.SENIORITY_SENTINELS), stripped=True)
        else:
            cols["antiguedad"] = T.seniority("antiguedad")
    for c in CATEGORICAL:
        if c in m.columns:
            cols[c] = T.category(c, trim)
    m = m.withColumns(cols)
    if seniority_median and "antiguedad" in m.columns:
        m = materialize(m)                                      # the median's scans and the caller read one copy
        med = exact_quantiles(m, ["antiguedad"], (0.5,))[1]["antiguedad", 0.5]
        m = m.withColumn("antiguedad", F.coalesce("antiguedad", F.lit(T.SENIORITY_DEFAULT if med is None else med)))
    m = m.withColumns({"con_incapacidad": (F.col(DAYS) > 0).cast("int"),
                       "incapacidad_alta": (F.col(DAYS) >= HIGH_LEAVE_DAYS).cast("int")})
    order = [*keep] + [c for c in ["clasificacion", "tipo", "estacion", "genero", "cargo", "antiguedad",
                                   "naturaleza", "parte_cuerpo", "agente", "mecanismo", DAYS] if c in m.columns]
    return m.select(*order, *TARGETS)


# --- overview -----------------------------------------------------------------

def _days_or_zero(df: DataFrame):
    c = "Total dias de incapacidad"
    return T.number_or(F.col(f"`{c}`"), 0.0) if c in df.columns else F.lit(0.0)


def case_kpis(plain: DataFrame, no_leave_mean: float = 0.0) -> DataFrame:
    """Row count, % of cases with leave, mean leave days among them and the
    number of cases classed "Graves".  With no case on leave the mean is
    ``no_leave_mean``: 0.0 by default, NaN in the earliest variant."""
    days = _days_or_zero(plain)
    cls = "Clasificacion del accidente"
    graves = (T.strip(T.as_text(F.col(f"`{cls}`"))) == F.lit(SEVERE_CLASS)) if cls in plain.columns else F.lit(False)
    k = plain.agg(F.count(F.lit(1)).alias("total"),
                  F.avg((days > 0).cast("double")).alias("p"),
                  F.avg(F.when(days > 0, days)).alias("m"),
                  F.sum(graves.cast("long")).alias("g"))
    return k.select("total",
                    F.round(F.coalesce(F.col("p") * 100.0, F.lit(0.0)), 4).alias("pct_incapacidad"),
                    F.round(F.coalesce(F.col("m"), F.lit(float(no_leave_mean))), 4).alias("promedio_dias"),
                    F.coalesce(F.col("g"), F.lit(0)).cast("long").alias("n_graves"))


def value_counts(df: DataFrame, col: str, out_name: str, top: int | None = None,
                 drop_prefix: bool = False) -> DataFrame:
    """Counts per displayed value (text form, stripped; optionally without
    the catalogue prefix), most frequent first, value as tie-breaker."""
    v = T.as_text(F.col(f"`{col}`"))
    v = T.drop_catalogue_prefix(v) if drop_prefix else T.strip(v)
    out = df.groupBy(v.alias(out_name)).agg(F.count(F.lit(1)).alias("Cantidad"))
    out = out.orderBy(F.desc("Cantidad"), F.asc(out_name))
    return out.limit(top) if top else out


def value_counts_raw(df: DataFrame, col: str, out_name: str, top: int | None = None,
                     relabel_prefix: bool = False) -> DataFrame:
    """Counts in the earliest overview form: the values as stored (nulls
    dropped, no stripping), most frequent first (value as tie-breaker), top N.
    Only then do the kept labels lose a ``<digits>. `` code — the pattern needs
    the space, so ``1.Golpe`` stays as is — and get stripped; labels are not
    re-counted, so two kept rows may show the same label."""
    v = F.col(f"`{col}`").cast("string")
    out = (df.filter(v.isNotNull()).groupBy(v.alias(out_name)).agg(F.count(F.lit(1)).alias("Cantidad"))
             .orderBy(F.desc("Cantidad"), F.asc(out_name)))
    out = out.limit(top) if top else out
    if relabel_prefix:
        out = out.withColumn(out_name, T.strip(F.regexp_replace(F.col(out_name), T.CATALOGUE_PREFIX_SPACED, "")))
    return out


def mean_days_by_job(plain: DataFrame, top: int = 10, digits: int | None = 2) -> DataFrame:
    """Mean leave days per job title: unparsable days are ignored (not 0),
    missing job titles dropped, highest mean first, rounded to ``digits``
    (``None``: unrounded, the earliest variant)."""
    job, days = "Puesto/Cargo", "Total dias de incapacidad"
    g = (plain.filter(F.col(f"`{job}`").isNotNull())
         .groupBy(F.col(f"`{job}`").alias("Cargo"))
         .agg(F.avg(T.parse_number(F.col(f"`{days}`"))).alias("m")))
    return (g.orderBy(F.desc_nulls_last("m"), F.asc("Cargo")).limit(top)
             .select("Cargo", (F.round("m", digits) if digits is not None else F.col("m")).alias("Dias_promedio")))


def filter_cases(plain: DataFrame, clasificacion: list[str] | None = None,
                 tipo: list[str] | None = None) -> DataFrame:
    """Data view: display columns (the whole table if it has none of them),
    optional multi-select filters (an empty selection filters nothing), both
    ANDed."""
    view = select_available(plain, SHOW_COLS)
    view = view if view.columns else plain
    if clasificacion and "Clasificacion del accidente" in view.columns:
        view = view.filter(F.col("`Clasificacion del accidente`").isin(list(clasificacion)))
    if tipo and "Tipo de accidente" in view.columns:
        view = view.filter(F.col("`Tipo de accidente`").isin(list(tipo)))
    return view


def filter_counts(plain: DataFrame, clasificacion=None, tipo=None) -> DataFrame:
    """One row: cases before and after the filter, from one pass."""
    view = select_available(plain, SHOW_COLS)
    kept = F.lit(True)
    for name, values in (("Clasificacion del accidente", clasificacion), ("Tipo de accidente", tipo)):
        if values and name in view.columns:
            kept = kept & F.coalesce(F.col(f"`{name}`").isin(list(values)), F.lit(False))
    return view.agg(F.count(F.lit(1)).alias("n_total"), F.count(F.when(kept, 1)).alias("n_filtrados"))


def filter_options(plain: DataFrame, cols=("Clasificacion del accidente", "Tipo de accidente")) -> DataFrame:
    """Distinct non-null values of the filter columns, long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("columna"), F.col(f"`{c}`").cast("string").alias("valor"))
                      for c in cols if c in plain.columns])
    out = plain.select(F.explode(pairs).alias("s")).select("s.columna", "s.valor")    # one pass for all columns
    return out.filter(F.col("valor").isNotNull()).distinct()
