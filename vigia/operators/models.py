"""Absence-risk classifiers and the monthly forecast on Spark MLlib.

Flow (one DataFrame job per step, no per-row Python):
clean cases -> dictionary codes -> stratified split / folds -> balanced class
weights (broadcast 2-row table) -> ``VectorAssembler`` -> MLlib fit ->
``transform`` -> probability of class 1 -> metrics from
:mod:`vigia.operators.metrics`.

The assembled table is written once, as Parquet, where the fit is to be kept
(else into the shared checkpoint folder): its lineage (three joins over the
case sources plus encoding) is cut, every fit reads it directly, counts read
one column of it, and a lost executor only re-reads files.  The MLlib
learners cache their own binned/instance copies while fitting.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.functions import rules
from vigia.operators import features as ft
from vigia.operators import metrics as mt
from vigia.operators import model_tables as mtab
from vigia.operators.booster import fit_booster
from vigia.operators.forest import fit_forest
from vigia.session import attach_row, materialize, written

SEED = 42
# Learner settings of the three algorithms.
RF_PARAMS = dict(numTrees=200, maxDepth=8)
GBT_PARAMS = dict(maxIter=150, maxDepth=5, stepSize=0.05)
LR_MAX_ITER = 1000
FOREST_TREES = 100          # monthly forecast forest
CV_PARALLELISM = 2          # fold fits in flight at once
MIN_BINS = 32               # MLlib's default number of split candidates
SERIES_DEPTH = 15           # depth of the many-series forest
HORIZON = 6                 # months forecast after the last observed one
ALGOS = ("rf", "gbt", "lr")

# Display labels of the model features.
FEAT_LABEL = {
    "cargo": "Cargo",
    "mecanismo": "Mecanismo del accidente",
    "parte_cuerpo": "Parte del cuerpo",
    "naturaleza": "Naturaleza de lesion",
    "agente": "Agente de lesion",
    "antiguedad": "Antiguedad (anos)",
    "estacion": "Estacion",
    "genero": "Genero",
    "clasificacion": "Clasificacion",
    "tipo": "Tipo de accidente",
}


def feature_columns(df: DataFrame, targets=("con_incapacidad", "incapacidad_alta"),
                    days: str = "dias_incapacidad", exclude=()) -> list[str]:
    """Every model column except the targets, the leave days and ``exclude``."""
    drop = set(targets) | {days} | set(exclude)
    return [c for c in df.columns if c not in drop]


def build_estimator(algo: str, n_weighted_rows: int | None = None, label: str = "label",
                    features: str = "features", weight: str = "w", max_bins: int = MIN_BINS):
    """The learner for ``algo``: random forest and logistic regression use the
    balanced class weights, boosting does not.  Logistic regression: L2 with
    ``regParam = 1 / sum(weights)`` and no standardisation, which is the
    C = 1 objective of a weighted L2 logistic regression.  ``max_bins`` is the
    number of values a tree may split between; with fewer than a feature has,
    codes are merged."""
    if algo == "rf":
        return RandomForestClassifier(labelCol=label, featuresCol=features, weightCol=weight, seed=SEED,
                                      featureSubsetStrategy="sqrt", maxMemoryInMB=512, cacheNodeIds=True,
                                      maxBins=max_bins, **RF_PARAMS)
    if algo == "gbt":
        # a row walks its one shallow tree faster than its node number is kept and written from level to level
        return GBTClassifier(labelCol=label, featuresCol=features, seed=SEED, checkpointInterval=10,
                             maxMemoryInMB=1024, cacheNodeIds=False, maxBins=max_bins, **GBT_PARAMS)
    if algo == "lr":
        if not n_weighted_rows:
            raise ValueError("logistic regression needs the weighted row count")
        return LogisticRegression(labelCol=label, featuresCol=features, weightCol=weight, maxIter=LR_MAX_ITER,
                                  regParam=1.0 / float(n_weighted_rows), elasticNetParam=0.0,
                                  standardization=False, tol=1e-6)
    raise ValueError(f"unknown algorithm {algo!r}; expected one of {ALGOS}")


def settings(algo: str) -> dict:
    """The fixed settings that a fit of ``algo`` depends on."""
    return {"seed": SEED, **{"rf": {**RF_PARAMS, "grown_from": "histograms"}, "gbt": {**GBT_PARAMS, "grown_from": "histograms"}, "lr": {"maxIter": LR_MAX_ITER}}.get(algo, {})}


def with_weights(df: DataFrame, label: str, fit_rows) -> DataFrame:
    """Attach the balanced weight of each row's class, computed on ``fit_rows``."""
    w = ft.balanced_weights(df.filter(fit_rows), label).select(F.col("label").alias("_wl"), F.col("weight").alias("w"))
    return df.join(F.broadcast(w), F.col(label) == F.col("_wl"), "left").drop("_wl") \
             .withColumn("w", F.coalesce(F.col("w"), F.lit(1.0)))


def p_class1(pred: DataFrame, prob: str = "probability") -> DataFrame:
    return pred.withColumn("p1", vector_to_array(F.col(prob)).getItem(1))


def score_rows(model: Model, rows: DataFrame, feats: list[str]) -> DataFrame:
    """Assembled rows with ``p1`` and ``prediction``.  Trees are walked as arrays of nodes, which takes a small part of the
    learner's time."""
    if mtab.kind_of(model) == "linear":
        return p_class1(model.transform(rows))
    x, names = vector_to_array("features"), [f"_x{i}" for i in range(len(feats))]
    got = mtab.predict(rows.withColumns({c: x[i] for i, c in enumerate(names)}), mtab.node_table(model, feats),
                       mtab.kind_of(model), names, out="p1")
    return got.drop(*names).withColumn("prediction", (F.col("p1") > 0.5).cast("double"))


@dataclass
class Artefact:
    """What scoring needs: the learner with its feature list and dictionary."""

    model: Model
    feats: list[str]
    algo: str
    target: str
    dictionary: DataFrame | None = None


@dataclass
class Trained(Artefact):
    data: DataFrame | None = None          # assembled rows with is_test and fold
    test_pred: DataFrame | None = None     # test rows with label, p1, prediction
    max_bins: int = MIN_BINS
    path: str | None = None                # where test_pred was written by the fit
    data_path: str | None = None           # where data was written, by the fit or before it


@dataclass
class CaseRows:
    """Assembled cases, kept for all learners."""

    data: DataFrame
    feats: list[str]
    max_bins: int
    dictionary: DataFrame
    path: str


def as_numbers(df: DataFrame, feats: list[str]) -> DataFrame:
    """Every feature as a double, null as 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feats})


def distinct_values(df: DataFrame, feats: list[str]) -> int:
    """Largest number of distinct values of a feature, at least ``MIN_BINS``
    (one aggregate row)."""
    row = df.agg(*[F.countDistinct(c).alias(c) for c in feats]).first()
    return max([MIN_BINS, *row])


def assemble(encoded: DataFrame, target: str, key_cols: list[str], feats: list[str] | None = None,
             test_size: float = 0.25, n_folds: int = 5, path: str | None = None) -> tuple[DataFrame, list[str], int]:
    """Encoded cases -> (label, split flag, fold, feature vector) as a table
    written once (to ``path``, if given), the feature list, and the bins that
    trees need.  Cases without a label are left out."""
    feats = feats or feature_columns(encoded, exclude=[*key_cols, "is_unseen"])
    # the case table (joins + encoding) is computed once, with the hash that orders the split, the dearest value of a
    # row; the steps of split and folds read the few columns they need of the copy
    base = as_numbers(encoded.select(*key_cols, *feats, F.col(target).cast("double").alias("label")), feats)
    base = written(base.withColumn("_order", ft.split_hash(key_cols, SEED)))
    # the split flags exactly the rows with a label; asking for the label keeps the flag out of the steps of the folds
    labelled = base.filter(F.col("label").isNotNull())
    d = ft.stratified_split(labelled, "label", key_cols, test_size=test_size, seed=SEED, order="_order")
    d = ft.stratified_folds(d, "label", key_cols, n_folds=n_folds)
    va = VectorAssembler(inputCols=feats, outputCol="features")
    d = written(va.transform(d).select(*key_cols, "label", "is_test", "fold", "features"), path)
    return over_cores(d), feats, distinct_values(base, feats)


def over_cores(d: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores is spread before the learners cache it; a wider one stays as it is."""
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d


def fit(data: DataFrame, algo: str, train_rows, feats: list[str], max_bins: int = MIN_BINS) -> Model:
    d = data if algo == "gbt" else with_weights(data, "label", train_rows)
    n = None
    if algo == "lr":
        n = d.filter(train_rows).agg(F.sum("w")).first()[0]     # one number
    est = build_estimator(algo, n, max_bins=max_bins)
    if algo == "rf":
        return fit_forest(d.filter(train_rows), est, len(feats))
    if algo == "gbt":
        return fit_booster(d.filter(train_rows), est, len(feats))
    return est.fit(d.filter(train_rows))


def train(encoded: DataFrame, target: str, algo: str, key_cols: list[str],
          dictionary: DataFrame | None = None, path: str | None = None, rows: CaseRows | None = None) -> Trained:
    """Fit ``algo`` on the encoded cases.  ``dictionary`` is the one that
    encoded them; it becomes part of the result, so that later cases get the
    same codes.  With ``path``, the assembled and the scored rows are written
    there at once and :func:`save_trained` to it need not write them again.  ``rows`` are cases assembled and kept before
    (then ``encoded`` is not read)."""
    if rows:
        data, feats, bins, dictionary, at = rows.data, rows.feats, rows.max_bins, rows.dictionary, rows.path
    else:
        at = path and f"{path}/data"
        data, feats, bins = assemble(encoded, target, key_cols, path=at)
    classes = data.agg(F.countDistinct("label")).first()[0]
    if classes < 2:
        raise ValueError("the target has a single class; both classes are needed to train")
    model = fit(data, algo, ~F.col("is_test"), feats, bins)
    # scored once: AUC, the report and the confusion cells all read these rows
    test_pred = written(score_rows(model, data.filter(F.col("is_test")), feats)
                        .select(*key_cols, "label", "p1", "prediction"), path and f"{path}/test_pred")
    return Trained(model, feats, algo, target, dictionary, data, test_pred, bins, path, at)


def holdout_metrics(t: Trained) -> DataFrame:
    """One row: sizes, test AUC, accuracy and class-1 precision/recall/F1."""
    pred = t.test_pred.select(F.col("label").cast("int").alias("label"), F.col("p1").alias("score"),
                              F.col("prediction").cast("int").alias("pred"))
    auc = mt.roc_auc(pred)
    rep = mt.classification_report(pred)
    one = rep.filter(F.col("clase") == "1").select(F.col("precision").alias("precision_1"),
                                                  F.col("recall").alias("recall_1"), F.col("f1_score").alias("f1_1"))
    acc = rep.filter(F.col("clase") == "accuracy").select(F.col("precision").alias("accuracy"))
    sizes = t.data.agg(F.sum((~F.col("is_test")).cast("long")).alias("n_train"),
                       F.sum(F.col("is_test").cast("long")).alias("n_test"))
    return (attach_row(attach_row(attach_row(sizes, auc), acc), one)
            .select(F.lit(t.algo).alias("algo"), F.lit(t.target).alias("target"), "n_train", "n_test",
                    F.round("auc", 6).alias("auc"), "accuracy", "precision_1", "recall_1", "f1_1"))


def cv_predictions(t: Trained, n_folds: int = 5) -> DataFrame:
    """Every case with its fold, label and ``p1`` by a model fitted on the
    other folds (weights recomputed per fit): one assembled matrix, filtered
    per fold, and one table of predictions."""
    keys = [c for c in t.data.columns if c not in ("label", "is_test", "fold", "features")]

    # the fold fits are independent Spark jobs: submit a few concurrently so
    # the scheduler interleaves their tasks (like CrossValidator's parallelism);
    # each fit holds its own split statistics, so the number is bounded
    # (setting ``vigia.cv.parallelism``, default 2) to keep the heap safe
    par = int(t.data.sparkSession.conf.get("vigia.cv.parallelism", str(CV_PARALLELISM)))
    with ThreadPoolExecutor(max_workers=max(1, min(n_folds, par))) as pool:
        fitted = list(pool.map(lambda f: fit(t.data, t.algo, F.col("fold") != f, t.feats, t.max_bins), range(n_folds)))
    out = None
    for f, m in enumerate(fitted):
        part = score_rows(m, t.data.filter(F.col("fold") == f), t.feats).select(*keys, "fold", "label", "p1")
        out = part if out is None else out.unionByName(part)
    return materialize(out)


def cv_auc(predictions: DataFrame, n_folds: int = 5) -> DataFrame:
    """AUC of each fold of :func:`cv_predictions` (null where a fold lacks a
    class), with the mean and the population std of the AUCs."""
    pred = predictions.select("fold", F.col("label").cast("int").alias("label"), F.col("p1").alias("score"))
    each = mt.roc_auc_by(pred, "fold", max_groups=n_folds).select("fold", "auc")
    folds = predictions.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold"))
    out = materialize(folds.join(F.broadcast(each), "fold", "left"))      # n_folds rows; computed once
    s = out.agg(F.avg("auc").alias("cv_mean"), F.stddev_pop("auc").alias("cv_std"))
    return attach_row(out, s).select("fold", F.round("auc", 6).alias("auc"),
                                                F.round("cv_mean", 6).alias("cv_mean"),
                                                F.round("cv_std", 6).alias("cv_std"))


def feature_importance(t: Trained, top: int = 10) -> DataFrame:
    """Top ``top`` feature importances (x100, 1 decimal) with display labels;
    empty for models without importances (logistic regression)."""
    spark = t.data.sparkSession
    imp = getattr(t.model, "featureImportances", None)
    rows = [] if imp is None else [(f, float(v)) for f, v in zip(t.feats, imp.toArray())]
    df = spark.createDataFrame(rows, "feature string, importancia double")
    lab = F.create_map(*[F.lit(x) for kv in FEAT_LABEL.items() for x in kv])
    return (df.orderBy(F.desc("importancia"), "feature").limit(top)
              .select(F.coalesce(F.try_element_at(lab, F.col("feature")), F.col("feature")).alias("Variable"),
                      "importancia", F.round(F.col("importancia") * 100, 1).alias("Pct")))


def code_cases(t: Artefact, new_cases: DataFrame, key_cols: list[str], dictionary: DataFrame | None = None) -> DataFrame:
    """The inputs of the model for cleaned cases: the keys, the codes of the
    artefact's own dictionary (unseen -> 0), ``antiguedad`` (null -> 0),
    ``is_unseen``, and the values as they were in ``_txt_<column>``."""
    cats = [c for c in t.feats if c != "antiguedad"]
    dictionary = t.dictionary if dictionary is None else dictionary
    if dictionary is None:
        raise ValueError("the model has no dictionary; pass the one that encoded its training cases")
    raw = new_cases.select(*key_cols, *[F.col(c).alias(f"_txt_{c}") for c in t.feats], *t.feats)
    return as_numbers(ft.encode(raw, dictionary, cats), t.feats)


def score_cases(t: Artefact, new_cases: DataFrame, key_cols: list[str], dictionary: DataFrame | None = None) -> DataFrame:
    """Score a batch of cleaned cases: encode (unseen -> 0, flagged), predict
    P(class 1), band it and attach the fired rules and recommendations.  The
    rules read the case's own (text) values."""
    enc = code_cases(t, new_cases, key_cols, dictionary)
    if t.algo == "rf":      # the same walk over arrays of nodes, half of the learner's time
        pred = mtab.predict(enc, mtab.node_table(t.model, t.feats), "mean", t.feats, t.model.getMaxDepth(), "p1")
    else:
        pred = p_class1(t.model.transform(VectorAssembler(inputCols=t.feats, outputCol="features").transform(enc)))
    pred = pred.withColumn("banda", rules.probability_band("p1"))
    rule_cols = dict(naturaleza="_txt_naturaleza", mecanismo="_txt_mecanismo", parte_cuerpo="_txt_parte_cuerpo",
                     antiguedad="_txt_antiguedad", agente="_txt_agente", tipo="_txt_tipo", band="banda")
    return pred.select(*key_cols, F.round("p1", 6).alias("probabilidad"), "banda",
                       F.upper("banda").alias("nivel"), "is_unseen",
                       F.array_join(rules.fired_rule_ids(**rule_cols), ",").alias("reglas"),
                       rules.recommendations(**rule_cols).alias("recomendaciones"))


def forecast(series: DataFrame, horizon: int = HORIZON, trees: int = FOREST_TREES) -> DataFrame:
    """Random-forest regression of the monthly count on the month index,
    scored for the ``horizon`` months after the last one.  Trees may split
    between any two months.  They do not extrapolate: beyond the data every
    month gets the same value."""
    va = VectorAssembler(inputCols=["Mes_d"], outputCol="features")
    train = va.transform(series.withColumn("Mes_d", F.col("Mes").cast("double")))
    bins = distinct_values(train, ["Mes"])
    model = RandomForestRegressor(maxBins=bins, labelCol="Accidentes", featuresCol="features", numTrees=trees, maxDepth=30,
                                  minInstancesPerNode=1, featureSubsetStrategy="all", seed=SEED).fit(train)
    last = series.agg(F.max("Mes").alias("m"))
    future = last.select(F.explode(F.sequence(F.col("m") + 1, F.col("m") + horizon)).alias("Mes"))
    pred = model.transform(va.transform(future.withColumn("Mes_d", F.col("Mes").cast("double"))))
    return pred.select(F.col("Mes").cast("int").alias("Mes"), F.round("prediction", 4).alias("Accidentes"))


def forecast_series(series: DataFrame, group: str = "Estacion", horizon: int = HORIZON, trees: int = FOREST_TREES,
                    max_depth: int = SERIES_DEPTH) -> DataFrame:
    """Forecast of many series by one forest: rows (``group``, Mes, Accidentes) give the ``horizon`` months after the
    last one of each series.  See :func:`fit_series` for the model."""
    model, dictionary = fit_series(series, group, trees, max_depth)
    future = future_months(series, group, dictionary, horizon)
    pred = model.transform(VectorAssembler(inputCols=SERIES_FEATURES, outputCol="features").transform(future))
    return pred.select(group, "Mes", F.round("prediction", 4).alias("Accidentes"))


SERIES_FEATURES = ["serie", "Mes_d"]


def fit_series(series: DataFrame, group: str = "Estacion", trees: int = FOREST_TREES,
               max_depth: int = SERIES_DEPTH) -> tuple[Model, DataFrame]:
    """One regression forest over all series, with the series' code and the month as features, and the dictionary of
    the codes.  Trees may split between any two codes and months."""
    text = series.select(F.col(group).cast("string").alias(group), "Mes", "Accidentes").filter(F.col(group).isNotNull())
    dictionary = materialize(ft.label_dictionary(text, [group]))
    coded = materialize(_series_rows(text, group, dictionary).select(*SERIES_FEATURES, F.col("Accidentes").cast("double").alias("Accidentes")))
    train = VectorAssembler(inputCols=SERIES_FEATURES, outputCol="features").transform(coded)
    model = RandomForestRegressor(maxBins=distinct_values(coded, SERIES_FEATURES), labelCol="Accidentes",
                                  featuresCol="features", numTrees=trees, maxDepth=max_depth, minInstancesPerNode=1,
                                  featureSubsetStrategy="all", seed=SEED).fit(train)
    return model, dictionary


def _series_rows(rows: DataFrame, group: str, dictionary: DataFrame) -> DataFrame:
    coded = ft.encode(rows.withColumn("serie", F.col(group)), dictionary.withColumn("columna", F.lit("serie")), ["serie"], None)
    return coded.withColumn("Mes_d", F.col("Mes").cast("double"))


def future_months(series: DataFrame, group: str, dictionary: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The months after the last one of each series, with the model's features."""
    last = series.filter(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias(group)).agg(F.max("Mes").alias("m"))
    rows = last.select(group, F.explode(F.sequence(F.col("m") + 1, F.col("m") + horizon)).alias("Mes"))
    rows = rows.withColumn("Mes", F.col("Mes").cast("int"))
    return _series_rows(rows, group, dictionary)


def save_trained(t: Trained, path: str) -> str:
    """:func:`save_model` and the rows of the fit: the assembled cases and the scored test cases."""
    save_model(t, path)
    if t.path != path:
        t.data.write.parquet(f"{path}/data")
        t.test_pred.write.parquet(f"{path}/test_pred")
    at = t.data_path if t.path == path and t.data_path else f"{path}/data"
    t.data.sparkSession.createDataFrame([(t.max_bins, at)], "max_bins int, data string").coalesce(1).write.parquet(f"{path}/bins")
    return path


def load_trained(path: str) -> Trained:
    """What :func:`save_trained` wrote under ``path``."""
    a, spark = load_model(path), SparkSession.getActiveSession()
    told = spark.read.schema("max_bins int, data string").parquet(f"{path}/bins").first()
    at = told["data"] or f"{path}/data"                     # entries of before tell no place
    return Trained(a.model, a.feats, a.algo, a.target, a.dictionary, over_cores(spark.read.parquet(at)),
                   spark.read.parquet(f"{path}/test_pred"), told["max_bins"], data_path=at)


def save_rows(encoded: DataFrame, target: str, key_cols: list[str], dictionary: DataFrame, path: str) -> str:
    """The assembled cases that every learner of ``target`` is fitted on, with their dictionary, under ``path``."""
    _, feats, bins = assemble(encoded, target, key_cols, path=f"{path}/data")
    dictionary.write.parquet(f"{path}/dictionary")
    encoded.sparkSession.createDataFrame([(feats, bins)], "feats array<string>, max_bins int").coalesce(1).write.parquet(f"{path}/meta")
    return path


def load_rows(path: str) -> CaseRows:
    """What :func:`save_rows` wrote under ``path``."""
    spark = SparkSession.getActiveSession()
    meta = spark.read.parquet(f"{path}/meta").first()
    return CaseRows(over_cores(spark.read.parquet(f"{path}/data")), list(meta["feats"]), meta["max_bins"],
                    spark.read.parquet(f"{path}/dictionary"), f"{path}/data")


def save_model(t: Artefact, path: str) -> str:
    """Persist the artefact under ``path``: the learner in MLlib's own format,
    the dictionary as Parquet, and one row with algorithm, target and feature
    list.  A scoring job needs nothing else."""
    spark = SparkSession.getActiveSession()
    t.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(t.algo, t.target, t.feats, t.dictionary is not None)],
                          "algo string, target string, feats array<string>, has_dictionary boolean") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    if t.dictionary is not None:
        t.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
    return path


def load_model(path: str) -> Artefact:
    """The artefact that :func:`save_model` wrote under ``path``."""
    from pyspark.ml.classification import (GBTClassificationModel, LogisticRegressionModel,
                                           RandomForestClassificationModel)
    spark = SparkSession.getActiveSession()
    meta = spark.read.parquet(f"{path}/meta").first()
    cls = {"rf": RandomForestClassificationModel, "gbt": GBTClassificationModel,
           "lr": LogisticRegressionModel}[meta["algo"]]
    dictionary = spark.read.parquet(f"{path}/dictionary") if meta["has_dictionary"] else None
    return Artefact(cls.load(f"{path}/model"), list(meta["feats"]), meta["algo"], meta["target"], dictionary)
