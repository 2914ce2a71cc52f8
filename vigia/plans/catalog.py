"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
computed from the shared test tables through the bindings in
:mod:`vigia.sources.tpch`.  Column names equal those of the SQL oracles in
:mod:`vigia.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigia.operators import cases as cs
from vigia.operators import exposure as ex
from vigia.operators import features as ft
from vigia.operators import metrics as mt
from vigia import memo
from vigia.operators import model_tables as mtab
from vigia.operators import models as md
from vigia.operators import profile as pf
from vigia.operators import indicators as ind
from vigia.functions import rules
from vigia.session import attach_row, materialize, written
from vigia.sources import files as io
from vigia.sources import grid, tpch
from vigia.streaming import board as board_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def board(spark: SparkSession, sf_dir: str, fuente: str = "GENERAL") -> DataFrame:
    """Cleaned exposure rows of one block (the board's working table)."""
    return ex.clean_exposure(tpch.exposure_raw(spark, sf_dir)).filter(F.col("fuente") == F.lit(fuente))


# --- rate board ------------------------------------------------------------

@register
def rate_by_station(spark, sf_dir):
    return ex.rates_by_station(board(spark, sf_dir))


@register
def exposure_clean(spark, sf_dir):
    """Both blocks of the board after cleaning (month present, not a repeated
    header, numeric measures, accident rows only), tagged by ``fuente``."""
    return ex.clean_exposure(tpch.exposure_raw(spark, sf_dir))


@register
def rate_global(spark, sf_dir):
    return ex.board_kpis(board(spark, sf_dir))


@register
def rate_by_population_top12(spark, sf_dir):
    return ex.rates_by_population_topk(board(spark, sf_dir), 12)


@register
def rate_by_population_is(spark, sf_dir):
    """The population table ordered by IS; ``rank`` carries the order."""
    return ex.rates_by_population_topk(board(spark, sf_dir), 12, by="IS")


@register
def rate_by_month(spark, sf_dir):
    return ex.rates_by_month(board(spark, sf_dir))


@register
def rate_grouping_sets(spark, sf_dir):
    return ex.rates_grouping_sets(board(spark, sf_dir))


@register
def rate_what_if(spark, sf_dir):
    return ex.what_if(board(spark, sf_dir), days=3.0)


@register
def rate_what_if_scenarios(spark, sf_dir):
    """A scenario table against the board: for every group, for every month of the station with the most hours of its
    unit, and with fixed hours."""
    b = board(spark, sf_dir)
    every = "escenario string, Estacion string, Mes string, horas double, factor_horas double, dias double"
    rows = spark.createDataFrame([("leve", None, None, None, 1.0, 1.0), ("grave", None, None, None, 1.0, 30.0),
                                  ("doble turno", None, None, None, 2.0, 3.0), ("sin horas", None, None, 0.0, 1.0, 3.0),
                                  ("enero", None, "1", None, 1.0, 15.0), ("mes de 20000 h", None, "6", 20000.0, 1.0, 6.0)], every)
    first = b.groupBy("Unidad_Negocio").agg(F.min("Estacion").alias("Estacion"))
    named = first.select(F.lit("estacion").alias("escenario"), "Estacion", F.lit(None).cast("string").alias("Mes"),
                         F.lit(None).cast("double").alias("horas"), F.lit(0.5).alias("factor_horas"), F.lit(10.0).alias("dias"))
    return ex.what_if_scenarios(b, rows.unionByName(named))


@register
def rate_agil_by_station(spark, sf_dir):
    """The station table of the second block (AGIL)."""
    return ex.rates_by_station(board(spark, sf_dir, "AGIL"))


# --- indicator sheet -------------------------------------------------------

def indicator_tables(spark, sf_dir, shared: bool = False):
    """(total, indicator) station x month IF tables of block GENERAL, built
    from all exposure rows (accident-free months give IF 0) and cleaned like
    the indicator sheet.  With ``shared`` both read one copy of the aggregated
    exposure, for callers that use both."""
    raw = tpch.exposure_raw(spark, sf_dir).filter(F.col("fuente") == F.lit("GENERAL"))
    if shared:
        raw = materialize(raw.select("Estacion", "Mes", "N_AT", "N_AT_IND", "HHT"))
    total = ind.clean_indicator(ind.wide_from_exposure(raw, "N_AT", with_ytd=True))
    indicator = ind.clean_indicator(ind.wide_from_exposure(raw, "N_AT_IND", with_ytd=False))
    return total, indicator


@register
def indicator_melt(spark, sf_dir):
    total, _ = indicator_tables(spark, sf_dir)
    return ind.melt_months(total)


@register
def indicator_ytd(spark, sf_dir):
    total, _ = indicator_tables(spark, sf_dir)
    return ind.ytd_ranking(total)


@register
def indicator_total_vs_ind(spark, sf_dir):
    total, indicator = indicator_tables(spark, sf_dir, shared=True)
    return ind.total_vs_indicator(total, indicator)


# --- sheet grid ------------------------------------------------------------

@register
def grid_promote_header(spark, sf_dir):
    return grid.promote_header(tpch.board_grid(spark, sf_dir), "Data", skip_rows=1)


#: The blocks of the board workbook by position.
BOARD_SLICES = [
    grid.Slice("Data", "GENERAL", 1, 1, tuple(ex.BOARD_COLUMNS)),
    grid.Slice("Data", "AGIL", 1, 16, tuple(ex.BOARD_COLUMNS)),
]
INDICATOR_SLICES = [
    grid.Slice("Data Indicadores", "TOTAL", 0, 1, ("Estacion", *ind.MONTHS, ind.YTD), n_rows=12),
    grid.Slice("Data Indicadores", "INDICADOR", 0, 16, ("Estacion", *ind.MONTHS), n_rows=12),
]


@register
def grid_block_slice(spark, sf_dir):
    """Both blocks cut out of the grid by position, typed and cleaned: the
    same table as ``exposure_clean``, reached through the sheet layout."""
    rows = grid.slice_blocks(tpch.board_grid(spark, sf_dir), grid.slice_catalogue(spark, BOARD_SLICES))
    wide = grid.wide_blocks(rows, len(ex.BOARD_COLUMNS)).toDF(*grid.GRID_KEYS, "fuente", *ex.BOARD_COLUMNS)
    return ex.clean_exposure(wide.drop(*grid.GRID_KEYS))


@register
def grid_slices(spark, sf_dir):
    """All four blocks of both sheets in one pass over the workbook's cells, long form."""
    rows = grid.slice_blocks(tpch.workbook_grid(spark, sf_dir), grid.slice_catalogue(spark, BOARD_SLICES + INDICATOR_SLICES))
    return rows.drop("position")


@register
def indicator_sheet(spark, sf_dir):
    """The indicator tables as the sheet gives them: the first 12 body rows of each block, by position, typed and
    cleaned; ``ACUM`` only in the total table."""
    rows = grid.slice_blocks(tpch.indicator_grid(spark, sf_dir), grid.slice_catalogue(spark, INDICATOR_SLICES))
    wide = materialize(grid.wide_blocks(rows, len(INDICATOR_SLICES[0].names)))
    total, indicator = (ind.clean_indicator(grid.block_table(wide, s.block, s.names).drop(*grid.GRID_KEYS))
                        .withColumn("bloque", F.lit(s.block)) for s in INDICATOR_SLICES)
    return total.unionByName(indicator, allowMissingColumns=True)


# --- case register ---------------------------------------------------------

def cases_plain(spark, sf_dir):
    return cs.normalize_names(tpch.cases_raw(spark, sf_dir))


def cases_model(spark, sf_dir, keep=()):
    return cs.prepare(tpch.cases_raw(spark, sf_dir), keep=list(keep))


@register
def case_clean(spark, sf_dir):
    return cases_model(spark, sf_dir)


@register
def case_kpis(spark, sf_dir):
    return cs.case_kpis(cases_plain(spark, sf_dir))


@register
def class_counts(spark, sf_dir):
    return cs.value_counts(cases_plain(spark, sf_dir), "Clasificacion del accidente", "Clasificacion")


@register
def type_top7(spark, sf_dir):
    return cs.value_counts(cases_plain(spark, sf_dir), "Tipo de accidente", "Tipo", top=7)


@register
def nature_top8(spark, sf_dir):
    return cs.value_counts(cases_plain(spark, sf_dir), "Naturaleza", "Naturaleza", top=8, drop_prefix=True)


@register
def bodypart_top8(spark, sf_dir):
    return cs.value_counts(cases_plain(spark, sf_dir), "Parte del cuerpo afectada", "Parte", top=8, drop_prefix=True)


@register
def job_mean_days_top10(spark, sf_dir):
    return cs.mean_days_by_job(cases_plain(spark, sf_dir), 10)


# The earliest variant's overview: raw value counts with nulls
# dropped, type top 6, the spaced prefix pattern applied after the top-N,
# unrounded job means.

@register
def type_top6_v2(spark, sf_dir):
    return cs.value_counts_raw(cases_plain(spark, sf_dir), "Tipo de accidente", "Tipo", top=6)


@register
def nature_top8_v2(spark, sf_dir):
    return cs.value_counts_raw(cases_plain(spark, sf_dir), "Naturaleza", "Naturaleza", top=8, relabel_prefix=True)


@register
def bodypart_top8_v2(spark, sf_dir):
    return cs.value_counts_raw(cases_plain(spark, sf_dir), "Parte del cuerpo afectada", "Parte", top=8,
                               relabel_prefix=True)


@register
def job_mean_days_top10_v2(spark, sf_dir):
    return cs.mean_days_by_job(cases_plain(spark, sf_dir), 10, digits=None)


CASE_FILTER_CLASSES = ["Graves", "Severos"]
CASE_FILTER_TYPES = ["PROMO", "STANDARD"]


@register
def case_filter(spark, sf_dir):
    return cs.filter_cases(cases_plain(spark, sf_dir), CASE_FILTER_CLASSES, CASE_FILTER_TYPES)


@register
def case_filter_counts(spark, sf_dir):
    return cs.filter_counts(cases_plain(spark, sf_dir), CASE_FILTER_CLASSES, CASE_FILTER_TYPES)


@register
def filter_options(spark, sf_dir):
    return cs.filter_options(cases_plain(spark, sf_dir))


@register
def seniority_median_impute(spark, sf_dir):
    m = cs.prepare(tpch.cases_raw(spark, sf_dir), seniority_median=True)
    return m.groupBy("antiguedad").agg(F.count(F.lit(1)).alias("n"))


# --- profile, series, preview ------------------------------------------------

PROFILE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register
def profile_numeric(spark, sf_dir):
    return pf.profile_numeric(tpch.table(spark, sf_dir, "lineitem", PROFILE_COLS), PROFILE_COLS)


@register
def drop_all_null_columns(spark, sf_dir):
    """The promoted board sheet pivoted to one column per sheet column; the
    empty separator columns (and the title column) are all null and dropped."""
    cells = grid.promote_header(tpch.board_grid(spark, sf_dir), "Data", skip_rows=1)
    cols = list(range(29))
    wide = cells.groupBy("row_no").pivot("col_no", cols).agg(F.first("value"))
    wide = wide.select("row_no", *[F.col(str(c)).alias(f"c{c}") for c in cols])
    return cs.drop_all_null_columns(wide)


@register
def monthly_alert(spark, sf_dir):
    return pf.monthly_alert(tpch.monthly_accidents(spark, sf_dir))


@register
def preview_rows(spark, sf_dir):
    m = cases_model(spark, sf_dir, keep=tpch.CASE_KEY)
    return pf.preview(m, 300, tpch.CASE_KEY).drop("l_shipdate")


# --- features ----------------------------------------------------------------

TARGET = "con_incapacidad"


@register
def label_dictionary(spark, sf_dir):
    return ft.label_dictionary(cases_model(spark, sf_dir), cs.CATEGORICAL)


def encoded_with_dictionary(spark, sf_dir, keep=(), fit_on: str = "all"):
    """(encoded case table, dictionary).  ``fit_on="all"`` fits the
    dictionaries on every row (the reference's behaviour); ``"train"`` only on
    the training rows of the stratified split, which adds ``is_test`` (the
    split is deterministic, so training later recomputes the same membership)."""
    if fit_on == "train":
        keep = list(dict.fromkeys([*keep, *tpch.CASE_KEY]))
        m = materialize(ft.stratified_split(cases_model(spark, sf_dir, keep=keep), TARGET, tpch.CASE_KEY,
                                            test_size=0.25, seed=42))
        src = m.filter(~F.col("is_test"))
    elif fit_on == "all":
        # the dictionary and the encoding both read the case table: compute it once
        src = m = materialize(cases_model(spark, sf_dir, keep=keep))
    else:
        raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
    dictionary = ft.label_dictionary(src, cs.CATEGORICAL)
    return ft.encode(m, dictionary, cs.CATEGORICAL), dictionary


def encoded_cases(spark, sf_dir, keep=(), fit_on: str = "all"):
    return encoded_with_dictionary(spark, sf_dir, keep, fit_on)[0]


@register
def encode_cases(spark, sf_dir):
    return encoded_cases(spark, sf_dir)


def split_cases(spark, sf_dir, cols=()):
    """Split flag over the case key, the label and ``cols``.  Class counts,
    the hash histogram and the marking pass all read the table, so it is
    checkpointed — with only the columns the caller needs (the joins are not
    repeated, and no unused text column is written)."""
    m = materialize(cases_model(spark, sf_dir, keep=tpch.CASE_KEY).select(*tpch.CASE_KEY, TARGET, *cols))
    return ft.stratified_split(m, TARGET, tpch.CASE_KEY, test_size=0.25, seed=42)


@register
def stratified_split_sizes(spark, sf_dir):
    s = split_cases(spark, sf_dir)
    return s.groupBy(F.when(F.col("is_test"), F.lit("test")).otherwise(F.lit("train")).alias("split"),
                     F.col(TARGET).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register
def split_membership(spark, sf_dir):
    """Which part of the split every case is in."""
    return split_cases(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_test")


@register
def class_weights(spark, sf_dir):
    return ft.balanced_weights(split_cases(spark, sf_dir).filter(~F.col("is_test")), TARGET)


@register
def cv_fold_sizes(spark, sf_dir):
    m = materialize(cases_model(spark, sf_dir, keep=tpch.CASE_KEY).select(*tpch.CASE_KEY, TARGET))
    f = ft.stratified_folds(m, TARGET, tpch.CASE_KEY, n_folds=5)
    return f.groupBy("fold", F.col(TARGET).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- evaluation on the deterministic score proxy ----------------------------------

@register
def roc_auc(spark, sf_dir):
    return mt.roc_auc(tpch.scored_cases(spark, sf_dir))


@register
def roc_curve(spark, sf_dir):
    return mt.roc_curve(tpch.scored_cases(spark, sf_dir))


@register
def confusion_matrix(spark, sf_dir):
    return mt.confusion_matrix(tpch.scored_cases(spark, sf_dir))


@register
def classification_report(spark, sf_dir):
    return mt.classification_report(tpch.scored_cases(spark, sf_dir))


@register
def probability_band(spark, sf_dir):
    s = tpch.scored_cases(spark, sf_dir)
    return s.groupBy(rules.probability_band("score").alias("banda")).agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


# Test binding for the rules: proxy category values renamed to register
# values the rules look for (the proxy itself has none of them).
REC_RELABEL = {
    "naturaleza": {"1.STANDARD": "1.Lesion Lumbar"},
    "mecanismo": {"1.EUROPE": "1.Sobre-esfuerzo"},
    "parte_cuerpo": {"1.Brand#1": "1.Espalda", "1.Brand#2": "1.Miembros superiores"},
    "agente": {"1.1-URGENT": "1.Aeronave y sus componentes", "1.2-HIGH": "1.Cambios de presion brusca"},
    "tipo": {"PROMO": "Transito", "SMALL": "Violencia"},
}


def relabel(df, mapping):
    cols = {}
    for c, m in mapping.items():
        lookup = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
        cols[c] = F.coalesce(F.try_element_at(lookup, F.col(c)), F.col(c))
    return df.withColumns(cols)


def _rules_table(m, variant):
    score = ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 1000).cast("double") / F.lit(1000.0)
    m = m.withColumn("banda", rules.probability_band(score))
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "banda",
                    F.array_join(rules.fired_rule_ids(variant=variant, band="banda"), ",").alias("reglas"),
                    F.size(rules.recommendations(variant=variant, band="banda")).alias("n_recomendaciones"))


@register
def recommendation_rules(spark, sf_dir):
    return _rules_table(relabel(cases_model(spark, sf_dir, keep=tpch.CASE_KEY), REC_RELABEL), "last")


# Test binding for the earliest variant's rules (its accented spellings).
REC_RELABEL_V2 = {
    "naturaleza": {"1.STANDARD": "1.Lesión Lumbar"},
    "mecanismo": {"1.EUROPE": "1.Sobre-esfuerzo"},
    "parte_cuerpo": {"1.Brand#1": "1.Espalda", "1.Brand#3": "1.Manos"},
    "agente": {"1.1-URGENT": "1.Aeronave", "1.3-MEDIUM": "1.Turbulencia"},
    "tipo": {"PROMO": "Tránsito"},
}


@register
def recommendation_rules_v2(spark, sf_dir):
    """The earliest variant end to end: tolerant schema, untrimmed categories,
    seniority imputed with the median first, then its own rule list."""
    m = cs.prepare(tpch.cases_raw(spark, sf_dir), keep=tpch.CASE_KEY, trim=False, strict=False,
                   seniority_median=True)
    return _rules_table(relabel(m, REC_RELABEL_V2), "v2")


# --- MLlib models (rows-only checks) --------------------------------------------

CASE_TABLES = ["lineitem", "orders", "customer", "nation", "region", "part"]


def trained(spark, sf_dir, algo: str, target: str = TARGET, fit_on: str = "all"):
    """The model of (input files, algorithm, target, encoder fit): fitted once and kept by the content of the case
    tables (see :mod:`vigia.memo`), so a rewritten folder gets a new fit and another session finds the old one."""
    def fit(rows, path):
        t = md.train(None, target, algo, tpch.CASE_KEY, path=path, rows=rows)
        return md.save_trained(t, path)
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in CASE_TABLES]
    return memo.remembered(spark, paths, {"algo": algo, "target": target, "fit_on": fit_on, "settings": md.settings(algo)},
                           lambda: case_rows(spark, sf_dir, target, fit_on), fit, md.load_trained)


def case_rows(spark, sf_dir, target: str, fit_on: str):
    """The assembled cases, made once for the content of the case tables and read by the fit of every learner."""
    def save(cases, path):
        enc, dictionary = cases
        return md.save_rows(enc.drop("is_unseen", "is_test"), target, tpch.CASE_KEY, dictionary, path)
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in CASE_TABLES]
    return memo.remembered(spark, paths, {"rows": target, "fit_on": fit_on},
                           lambda: encoded_with_dictionary(spark, sf_dir, keep=tpch.CASE_KEY, fit_on=fit_on), save, md.load_rows)


@register
def train_rf_metrics(spark, sf_dir):
    return md.holdout_metrics(trained(spark, sf_dir, "rf"))


@register
def train_gbt_metrics(spark, sf_dir):
    return md.holdout_metrics(trained(spark, sf_dir, "gbt"))


@register
def train_lr_metrics(spark, sf_dir):
    return md.holdout_metrics(trained(spark, sf_dir, "lr"))


def fold_predictions(spark, sf_dir, algo: str = "rf"):
    """The fold predictions of a learner, made once for the content of the case tables."""
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in CASE_TABLES]
    return memo.remembered(spark, paths, {"fold_predictions": algo, "target": TARGET, "settings": md.settings(algo)},
                           lambda: md.cv_predictions(trained(spark, sf_dir, algo)),
                           lambda rows, path: rows.write.parquet(path), spark.read.parquet)


@register
def cv_auc(spark, sf_dir):
    return md.cv_auc(fold_predictions(spark, sf_dir))


@register
def cv_checks(spark, sf_dir):
    """Per fold the cases and positives scored by the model of the other folds, and whether all have a probability, no
    case is scored twice, ``cv_auc`` tells the fold's area and its mean, and the area of the reversed scores is the rest."""
    pred = fold_predictions(spark, sf_dir)
    told = md.cv_auc(pred)
    per = pred.groupBy("fold").agg(F.min(F.col("p1").between(0, 1)).alias("probabilities_ok"))
    rows = pred.select("fold", F.col("label").cast("int").alias("label"), F.col("p1").alias("score"), (-F.col("p1")).alias("back"))
    area = mt.roc_auc_by(rows, "fold", max_groups=5)
    back = mt.roc_auc_by(rows, "fold", score="back", max_groups=5).select("fold", F.col("auc").alias("back"))
    twice = pred.groupBy(*tpch.CASE_KEY).agg(F.count(F.lit(1)).alias("c")).agg((F.max("c") == 1).alias("once"))
    mean = area.agg(F.avg("auc").alias("mean"))
    both = area.join(told.withColumnRenamed("auc", "told"), "fold").join(back, "fold").join(per, "fold")
    return attach_row(attach_row(both, twice), mean).select(
        "fold", F.col("n").alias("n_scored"), "n_positive", "probabilities_ok", F.col("once").alias("once_ok"),
        ((F.abs(F.col("auc") - F.col("told")) < 1e-6) & (F.abs(F.col("auc") + F.col("back") - 1) < 1e-9)).alias("auc_ok"),
        (F.abs(F.col("mean") - F.col("cv_mean")) < 1e-6).alias("mean_ok"))


@register
def feature_importance_top10(spark, sf_dir):
    return md.feature_importance(trained(spark, sf_dir, "rf"), 10)


@register
def score_cases(spark, sf_dir):
    """Every case of the register scored as a batch of new cases with the
    model's own dictionary."""
    return md.score_cases(trained(spark, sf_dir, "rf"), cases_model(spark, sf_dir, keep=tpch.CASE_KEY), tpch.CASE_KEY)


@register
def score_inputs(spark, sf_dir):
    """What the scoring of every case reads: its codes by the dictionary of a
    model encoded on the training cases only, and the unseen flag."""
    m = materialize(ft.stratified_split(cases_model(spark, sf_dir, keep=tpch.CASE_KEY), TARGET, tpch.CASE_KEY,
                                        test_size=0.25, seed=42))
    dictionary = ft.label_dictionary(m.filter(~F.col("is_test")), cs.CATEGORICAL)
    art = md.Artefact(None, [*cs.CATEGORICAL, "antiguedad"], "rf", TARGET, dictionary)
    coded = md.code_cases(art, m, tpch.CASE_KEY)
    return coded.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *art.feats, "is_unseen")


def _check_model(t):
    """What SQL can state about a fit: its split sizes, that every test case
    was scored once with a probability, that the labels scored are those of the
    test part, and that the reported AUC is that of the predictions."""
    pred = t.test_pred.select("p1", "label")
    auc = mt.roc_auc(pred.select(F.col("label").cast("int").alias("label"), F.col("p1").alias("score")))
    told = md.holdout_metrics(t).select("n_train", "n_test", F.col("auc").alias("told"))
    ok = pred.agg(F.count(F.lit(1)).alias("n_scored"), F.sum("label").cast("long").alias("n_positive"),
                  F.min((F.col("p1") >= 0) & (F.col("p1") <= 1)).alias("probabilities_ok"))
    one = attach_row(attach_row(told, ok), auc)
    return one.select(F.lit(t.algo).alias("algo"), "n_train", "n_test", "n_scored", "n_positive", "probabilities_ok",
                      (F.abs(F.col("auc") - F.col("told")) < 1e-6).alias("auc_ok"))


@register
def model_checks(spark, sf_dir):
    """:func:`_check_model` of the logistic regression and of the forest, whose
    importances sum to one."""
    rf = trained(spark, sf_dir, "rf")
    total = float(sum(rf.model.featureImportances.toArray()))
    return _check_model(trained(spark, sf_dir, "lr")).withColumn("importances_ok", F.lit(True)).unionByName(
        _check_model(rf).withColumn("importances_ok", F.lit(abs(total - 1.0) < 1e-9)))


@register
def score_checks(spark, sf_dir):
    """What SQL can state about the scored register: one row per case, a
    probability, the level that repeats the band, and no unseen category."""
    s = score_cases(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("probabilidad").between(0, 1)).alias("probabilities_ok"),
                 F.sum((F.upper(F.col("banda")) == F.col("nivel")).cast("long")).alias("n_nivel"),
                 F.sum(F.col("is_unseen").cast("long")).alias("n_unseen"))


@register
def forecast_months(spark, sf_dir):
    return md.forecast(tpch.monthly_accidents(spark, sf_dir))


@register
def forecast_by_station(spark, sf_dir):
    """Six months ahead for every station, from one forest over all stations' series.  ``from_table``: the same number
    comes out of the forest's node table."""
    series = materialize(tpch.monthly_accidents_by_station(spark, sf_dir))
    model, dictionary = md.fit_series(series)
    future = md.future_months(series, "Estacion", dictionary)
    pred = model.transform(md.VectorAssembler(inputCols=md.SERIES_FEATURES, outputCol="features").transform(future))
    nodes = materialize(mtab.node_table(model, md.SERIES_FEATURES))
    both = mtab.predict(pred, nodes, "mean", md.SERIES_FEATURES, md.SERIES_DEPTH, "again")
    low, high = (series.agg(f("Accidentes")).scalar() for f in (F.min, F.max))
    return both.select("Estacion", "Mes", (F.abs(F.col("again") - F.col("prediction")) < 1e-9).alias("from_table"),
                       F.col("prediction").between(low, high).alias("in_range"))


# --- models as tables -----------------------------------------------------------

@register
def model_node_checks(spark, sf_dir):
    """What holds for any node table: one root a tree, every other node the child of one node, and the rows of a node
    those of its children (up to rounding of weights)."""
    out = None
    for algo in ("rf", "gbt"):
        t = trained(spark, sf_dir, algo)
        nodes = materialize(mtab.node_table(t.model, t.feats))
        inner = nodes.filter("feature >= 0")
        child = inner.select("tree", F.col("node").alias("parent"), F.explode(F.array("left", "right")).alias("node"))
        below = child.join(nodes.select("tree", "node", F.col("rows").alias("r")), ["tree", "node"]).groupBy("tree", "parent").agg(
            F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"))
        both = inner.join(below, (inner["tree"] == below["tree"]) & (inner["node"] == below["parent"]), "left")
        fits = both.agg(F.min((F.col("n") == 2) & (F.abs(F.col("r") - F.col("rows")) < 1e-6 * (1 + F.col("rows")))).alias("rows_ok"))
        once = child.agg((F.count(F.lit(1)) == F.count_distinct("tree", "node")).alias("once"))
        row = nodes.agg(F.lit(algo).alias("algo"), F.count_distinct("tree").alias("n_trees"),
                        F.sum((F.col("node") == 0).cast("long")).alias("n_roots"),
                        (F.sum((F.col("feature") < 0).cast("long")) == F.sum((F.col("feature") >= 0).cast("long"))
                         + F.count_distinct("tree")).alias("leaves_ok"))
        row = attach_row(attach_row(row, fits), once).withColumnRenamed("once", "children_ok")
        out = row if out is None else out.unionByName(row)
    return out


def _scored_from_table(spark, t, cases):
    """``cases`` (codes and features) with ``p1`` by the learner and ``again`` from its table."""
    table = materialize(mtab.model_table(t.model, t.feats))
    depth = {"rf": md.RF_PARAMS["maxDepth"], "gbt": md.GBT_PARAMS["maxDepth"], "lr": 0}[t.algo]
    return mtab.predict(cases, table, mtab.kind_of(t.model), t.feats, depth, "again")


@register
def score_cases_from_table(spark, sf_dir):
    """Every case scored from the node table of the forest, without the learner: ``agrees`` with the learner's
    probability, and ``same_band`` as the scored register."""
    t = trained(spark, sf_dir, "rf")
    coded = md.code_cases(t, cases_model(spark, sf_dir, keep=tpch.CASE_KEY), tpch.CASE_KEY)
    by_model = md.p_class1(t.model.transform(md.VectorAssembler(inputCols=t.feats, outputCol="features").transform(coded)))
    both = _scored_from_table(spark, t, by_model)
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       (F.abs(F.col("again") - F.col("p1")) < 1e-9).alias("agrees"),
                       (rules.probability_band("again") == rules.probability_band("p1")).alias("same_band"))


def _by_learner(t):
    """``t`` with the test cases scored by the learner itself."""
    if t.algo == "lr":
        return t
    pred = md.p_class1(t.model.transform(t.data.filter("is_test"))).select(*tpch.CASE_KEY, "label", "p1", "prediction")
    return replace(t, test_pred=written(pred))


@register
def metrics_from_table(spark, sf_dir):
    """The holdout metrics of all three learners computed again from their tables and the coded test cases, beside
    what the learners report: sizes, and whether AUC, accuracy, precision, recall and F1 agree."""
    out = None
    for algo in md.ALGOS:
        t = trained(spark, sf_dir, algo)
        rows = t.data.filter("is_test").select("label", *[vector_to_array("features")[i].alias(f) for i, f in enumerate(t.feats)])
        again = materialize(_scored_from_table(spark, t, rows).select(
            F.col("label").cast("int").alias("label"), F.col("again").alias("score"), (F.col("again") > 0.5).cast("int").alias("pred")))
        rep = mt.classification_report(again)
        one = rep.filter("clase = '1'").select(F.col("precision").alias("p"), F.col("recall").alias("r"), F.col("f1_score").alias("f"))
        acc = rep.filter("clase = 'accuracy'").select(F.col("precision").alias("a"))
        whole = attach_row(attach_row(attach_row(md.holdout_metrics(_by_learner(t)), mt.roc_auc(again).select(F.col("auc").alias("u"))), one), acc)
        near = lambda x, y: F.abs(F.col(x) - F.col(y)) < 1e-6
        row = whole.select("algo", "n_train", "n_test", near("auc", "u").alias("auc_ok"), near("accuracy", "a").alias("accuracy_ok"),
                           near("precision_1", "p").alias("precision_ok"), near("recall_1", "r").alias("recall_ok"),
                           near("f1_1", "f").alias("f1_ok"))
        out = row if out is None else out.unionByName(row)
    return out


@register
def importances_from_table(spark, sf_dir):
    """The importances of forest and booster from their node tables: per learner the number of features with a split,
    whether they agree with the learner's, and whether they add up to one."""
    out = None
    for algo in ("rf", "gbt"):
        t = trained(spark, sf_dir, algo)
        got = mtab.importances(mtab.node_table(t.model, t.feats), mtab.kind_of(t.model))
        told = spark.createDataFrame([(i, float(v)) for i, v in enumerate(t.model.featureImportances.toArray())], "feature int, told double")
        both = told.join(got, "feature", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
        row = both.agg(F.lit(algo).alias("algo"), F.count(F.lit(1)).alias("n_features"),
                       F.min(F.abs(F.col("importance") - F.col("told")) < 1e-9).alias("agrees"),
                       (F.abs(F.sum("importance") - 1) < 1e-9).alias("adds_up"))
        out = row if out is None else out.unionByName(row)
    return out


# --- sources / sinks ------------------------------------------------------------

@register
def csv_round_trip(spark, sf_dir):
    """The cleaned board written as CSV with a header and read back with an
    explicit schema (no inference pass)."""
    df = ex.clean_exposure(tpch.exposure_raw(spark, sf_dir))
    path = io.export(df, io.scratch_path(spark, "board-csv"), fmt="csv")
    return io.load_table(spark, path, fmt="csv", schema=df.schema)


CHECKED_SCHEMA = "o_orderkey bigint, o_totalprice decimal(15,2), o_orderdate date, o_orderpriority string"


def checked_copies(spark, sf_dir):
    """Orders as a CSV, a JSON and a Parquet folder; the records of status P do not parse: in the CSV copy their price
    has a currency before it, in the JSON copy their closing brace is missing.  Returns format -> path."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("o_totalprice"),
        F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority",
        (F.col("o_orderstatus") == "P").alias("broken"))
    k, p, d, q = (F.col(c).cast("string") for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"))
    csv = F.concat_ws(",", k, F.when(F.col("broken"), F.concat(F.lit("USD "), p)).otherwise(p), d, q)
    js = F.concat(F.lit('{"o_orderkey":'), k, F.lit(',"o_totalprice":'), p, F.lit(',"o_orderdate":"'), d,
                  F.lit('","o_orderpriority":"'), q, F.when(F.col("broken"), F.lit('"')).otherwise(F.lit('"}')))
    paths = {f: f"{io.scratch_path(spark, 'orders')}.{f}" for f in ("csv", "json", "parquet")}
    o.select(csv.alias("value")).write.text(paths["csv"])
    o.select(js.alias("value")).write.text(paths["json"])
    io.export(o.drop("broken"), paths["parquet"])
    return paths


@register
def load_checked(spark, sf_dir):
    """Three copies of one table read by suffix alone, unparsable records parted from the good ones: per format the
    number and sums of the good rows, and the number, characters and located files of the bad ones."""
    out = None
    for fmt, path in checked_copies(spark, sf_dir).items():
        good, bad = io.load_checked(spark, path, CHECKED_SCHEMA, header=False)
        g = good.agg(F.count(F.lit(1)).alias("n_good"), F.sum("o_orderkey").alias("key_sum"),
                     F.sum((F.col("o_totalprice") * 100).cast("long")).alias("cents"),
                     F.min("o_orderdate").alias("first_day"), F.count_distinct("o_orderpriority").alias("n_priorities"))
        b = bad.agg(F.count(F.lit(1)).alias("n_bad"),
                    F.coalesce(F.sum(F.char_length("line")), F.lit(0)).cast("long").alias("bad_chars"),
                    F.count_if(F.contains("file", F.lit(f".{fmt}/"))).alias("n_located"))
        one = attach_row(g, b).withColumn("format", F.lit(fmt))
        out = one if out is None else out.unionByName(one)
    return out


@register
def export_filtered(spark, sf_dir):
    """The filtered case view exported as parquet partitioned by class, read back."""
    view = cs.filter_cases(cases_plain(spark, sf_dir), CASE_FILTER_CLASSES, CASE_FILTER_TYPES)
    path = io.export(view, io.scratch_path(spark, "cases-export"), partition_by=["Clasificacion del accidente"])
    return io.load_table(spark, path, fmt="parquet")


@register
def exposure_stream_clean(spark, sf_dir):
    """Board uploads (one file set per block) ingested by a file stream that
    applies the board cleaning; the resulting table."""
    raw = tpch.exposure_raw(spark, sf_dir)
    src = io.scratch_path(spark, "board-uploads")
    for block in ("GENERAL", "AGIL"):
        io.export(raw.filter(F.col("fuente") == F.lit(block)), src, mode="append")
    return board_stream.ingest_exposure(spark, src, raw.schema, io.scratch_path(spark, "board-table"),
                                        io.scratch_path(spark, "board-stream-ckpt"), files_per_trigger=1)


@register
def rate_by_station_stream(spark, sf_dir):
    """The station table computed on the stream-ingested board table."""
    t = exposure_stream_clean(spark, sf_dir)
    return ex.rates_by_station(t.filter(F.col("fuente") == F.lit("GENERAL")))


# --- single-station view ------------------------------------------------------

DETAIL_STATION = "NATION_1"


@register
def station_list(spark, sf_dir):
    return ex.stations(board(spark, sf_dir))


@register
def station_detail(spark, sf_dir):
    """KPIs of one selected station (equality filter, then the board KPIs)."""
    return ex.station_rates(board(spark, sf_dir), DETAIL_STATION)
