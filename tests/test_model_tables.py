"""Models as tables: DuckDB repeats scores, importances, metrics and forecasts from the written tables alone; fits are
remembered by the content of their inputs."""

import duckdb
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vigia import memo
from vigia.operators import metrics as mt
from vigia.operators import model_tables as mtab
from vigia.operators import models as md

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, float(i % 7), float((i * 13) % 29) / 3, float((i * i) % 11), float((i % 7) + (i * 13) % 29 > 17 + i % 3)) for i in range(500)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, label double")


LEARNERS = {"rf": lambda: RandomForestClassifier(numTrees=7, maxDepth=5, seed=3),
            "gbt": lambda: GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.3, seed=3), "lr": lambda: LogisticRegression(regParam=0.01)}

# every case walks down every tree, one level a step
WALK = """
WITH RECURSIVE x AS (SELECT k, unnest([a, b, c]) AS v, unnest([0, 1, 2]) AS f FROM read_parquet('{cases}/*.parquet')),
n AS (SELECT * FROM read_parquet('{nodes}/*.parquet')),
walk AS (SELECT k, tree, 0 AS node FROM (SELECT DISTINCT k FROM x), (SELECT DISTINCT tree FROM n)
         UNION ALL
         SELECT w.k, w.tree, CASE WHEN x.v <= n.threshold THEN n."left" ELSE n."right" END
         FROM walk w JOIN n ON n.tree = w.tree AND n.node = w.node AND n.feature >= 0 JOIN x ON x.k = w.k AND x.f = n.feature),
leaf AS (SELECT w.k, n.weight, n.value FROM walk w JOIN n ON n.tree = w.tree AND n.node = w.node WHERE n.feature < 0)
SELECT k, {result} FROM leaf GROUP BY k ORDER BY k"""
RESULT = {"mean": "SUM(weight * value) / SUM(weight)", "margin": "1 / (1 + exp(-2 * SUM(weight * value)))"}


def fitted(cases, algo):
    d = VectorAssembler(inputCols=FEATS, outputCol="features").transform(cases)
    model = LEARNERS[algo]().fit(d)
    return model, md.p_class1(model.transform(d)).select("k", *FEATS, "label", "p1").cache()


def duck_scores(cases, table, kind, path):
    cases.select("k", *FEATS).write.parquet(f"{path}/cases")
    table.write.parquet(f"{path}/nodes")
    return duckdb.sql(WALK.format(cases=f"{path}/cases", nodes=f"{path}/nodes", result=RESULT[kind])).fetchall()


@pytest.mark.parametrize("algo", ["rf", "gbt"])
def test_duckdb_repeats_a_tree_model_from_its_table(cases, algo, tmp_path):
    model, scored = fitted(cases, algo)
    nodes, kind = mtab.node_table(model, FEATS), mtab.kind_of(model)
    told = {r.k: r.p1 for r in scored.collect()}
    got = duck_scores(cases, nodes, kind, tmp_path)
    assert len(got) == 500 and all(p == pytest.approx(told[k], abs=1e-12) for k, p in got)
    for depth in (5, 30):  # a bound beyond the trees' depth changes nothing
        again = mtab.predict(scored, nodes, kind, FEATS, depth).filter(F.abs(F.col("p") - F.col("p1")) > 1e-12)
        assert again.isEmpty()
    imp = {r.feature: r.importance for r in mtab.importances(nodes, kind).collect()}
    assert [imp.get(i, 0.0) for i in range(3)] == pytest.approx(model.featureImportances.toArray().tolist(), abs=1e-12)
    gain = duckdb.sql(f"""WITH g AS (SELECT tree, feature_name, SUM(gain * "rows") AS g FROM read_parquet('{tmp_path}/nodes/*.parquet')
        WHERE feature >= 0 GROUP BY ALL), s AS (SELECT *, g / {'SUM(g) OVER (PARTITION BY tree)' if kind == 'mean' else '1'} AS p FROM g)
        SELECT feature_name, SUM(p) / (SELECT SUM(p) FROM s) FROM s GROUP BY 1""").fetchall()
    assert dict(gain) == pytest.approx({FEATS[i]: v for i, v in imp.items()}, abs=1e-12)
    # the metrics follow from the repeated scores
    rows = scored.select(F.col("label").cast("int").alias("label"), F.col("p1").alias("score"))
    wins = duckdb.sql(f"""WITH p AS ({WALK.format(cases=f'{tmp_path}/cases', nodes=f'{tmp_path}/nodes', result=RESULT[kind] + ' AS p')}),
        y AS (SELECT k, ((k % 7) + (k * 13) % 29 > 17 + k % 3) AS y, round(p, 12) AS p FROM p)
        SELECT AVG(CASE WHEN u.p > v.p THEN 1.0 WHEN u.p = v.p THEN 0.5 ELSE 0 END) FROM y u, y v WHERE u.y AND NOT v.y""").fetchall()[0][0]
    assert mt.roc_auc(rows).first()[0] == pytest.approx(wins, abs=1e-6)


def test_duckdb_repeats_a_regression_from_its_terms(cases):
    model, scored = fitted(cases, "lr")
    terms = mtab.model_table(model, FEATS)
    t = {r.term: r.value for r in terms.collect()}
    assert list(t) == ["intercept", *FEATS]
    linear = " + ".join([repr(t["intercept"])] + [f"{t[f]!r} * {f}" for f in FEATS])
    pdf = scored.toPandas()  # noqa: F841 (read by DuckDB)
    assert duckdb.sql(f"SELECT max(abs(1 / (1 + exp(-({linear}))) - p1)) FROM pdf").fetchall()[0][0] < 1e-12
    assert mtab.predict(scored, terms, "linear", FEATS).filter(F.abs(F.col("p") - F.col("p1")) > 1e-12).isEmpty()


def test_stumps_and_unknown_models(spark, cases):
    d = VectorAssembler(inputCols=FEATS, outputCol="features").transform(cases)
    model = RandomForestClassifier(numTrees=2, maxDepth=0, seed=1).fit(d)
    nodes = mtab.node_table(model, FEATS)
    assert nodes.count() == 2 and mtab.predict(cases, nodes, "mean", FEATS, 0).select("p").distinct().count() == 1
    with pytest.raises(TypeError):
        mtab.kind_of(object())


def test_forecast_of_many_series(spark, tmp_path):
    """One fit for all series; every series keeps its own level, and DuckDB repeats the forecasts from the nodes."""
    rows = [(s, m, float(10 * n + (m % 12 == 0))) for n, s in enumerate(["x", "y", "z"], 1) for m in range(1, 25 + n)]
    series = spark.createDataFrame(rows + [(None, 1, 5.0)], "Estacion string, Mes int, Accidentes double")
    got = md.forecast_series(series, trees=20).collect()
    assert sorted((r.Estacion, r.Mes) for r in got) == [(s, 24 + n + i) for n, s in enumerate("xyz", 1) for i in range(1, 7)]
    assert all(abs(r.Accidentes - 10 * ("xyz".index(r.Estacion) + 1)) < 1.5 for r in got)
    model, dictionary = md.fit_series(series, trees=20)
    future = md.future_months(series, "Estacion", dictionary)
    nodes = mtab.node_table(model, md.SERIES_FEATURES)
    told = {(r.Estacion, r.Mes): r.Accidentes for r in got}
    again = mtab.predict(future, nodes, "mean", md.SERIES_FEATURES).collect()
    assert len(again) == 18 and all(round(r.p, 4) == pytest.approx(told[r.Estacion, r.Mes], abs=1e-4) for r in again)
    coded = future.select((F.col("serie") * 100 + F.col("Mes")).cast("long").alias("k"), F.col("serie").alias("a"),
                          F.col("Mes_d").alias("b"), F.lit(0.0).alias("c"))
    duck = duck_scores(coded, nodes, "mean", tmp_path)
    assert {k: p for k, p in duck} == pytest.approx({int(r.serie * 100 + r.Mes): r.p for r in again}, abs=1e-12)


# --- memo ------------------------------------------------------------------

def remember(spark, path, params, made, **options):
    def make():
        made.append(1)
        return spark.read.parquet(path).agg(F.sum("v").alias("s"))
    return memo.remembered(spark, [path], params, make, lambda df, p: df.write.parquet(p), spark.read.parquet, **options).first()[0]


def test_a_rewritten_input_is_computed_anew(spark, tmp_path):
    path, made = str(tmp_path / "in"), []
    spark.createDataFrame([(1,), (2,)], "v long").write.parquet(path)
    assert remember(spark, path, {"q": 1}, made) == 3 and len(made) == 1
    assert remember(spark, path, {"q": 1}, made) == 3 and len(made) == 1     # unchanged: not computed
    assert remember(spark, path, {"q": 2}, made) == 3 and len(made) == 2     # other parameters
    spark.createDataFrame([(1,), (5,)], "v long").write.mode("overwrite").parquet(path)
    assert remember(spark, path, {"q": 1}, made) == 6 and len(made) == 3     # rewritten
    spark.createDataFrame([(4,)], "v long").write.mode("append").parquet(path)
    assert remember(spark, path, {"q": 1}, made) == 10 and len(made) == 4    # one file more
    assert remember(spark, path, {"q": 1}, made, max_age=0) == 10 and len(made) == 5  # expired
    assert remember(spark, path, {"q": 1}, made) == 10 and len(made) == 5


def test_a_fit_is_remembered_whole(spark, tmp_path):
    rows = [(i, float(i % 10), float((i * 7) % 13), int(i % 10 >= 5), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double, con_incapacidad int, incapacidad_alta int") \
        .withColumn("dias_incapacidad", F.col("con_incapacidad").cast("double"))
    t = md.train(df, "con_incapacidad", "lr", ["k"])
    back = md.load_trained(md.save_trained(t, str(tmp_path / "fit")))
    assert (back.feats, back.algo, back.target, back.max_bins) == (t.feats, t.algo, t.target, t.max_bins)
    assert md.holdout_metrics(back).collect() == md.holdout_metrics(t).collect()
    assert back.data.count() == t.data.count()


def test_a_rewritten_case_table_is_fitted_anew(spark, tmp_path, monkeypatch):
    """The registered queries see new data behind the same path."""
    import shutil

    from vigia.plans import catalog
    sf, source = tmp_path / "sf", "/root/testdata/sf0.001"
    sf.mkdir()
    for t in catalog.CASE_TABLES[1:]:
        shutil.copyfile(f"{source}/{t}.parquet", sf / f"{t}.parquet")
    lineitem = spark.read.parquet(f"{source}/lineitem.parquet")
    lineitem.write.parquet(f"{sf}/lineitem.parquet")
    fits = []
    monkeypatch.setattr(catalog.md, "train", lambda *a, real=md.train, **k: fits.append(1) or real(*a, **k))
    first = md.holdout_metrics(catalog.trained(spark, str(sf), "lr")).first()
    assert md.holdout_metrics(catalog.trained(spark, str(sf), "lr")).first() == first and len(fits) == 1
    lineitem.filter("l_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{sf}/lineitem.parquet")
    again = md.holdout_metrics(catalog.trained(spark, str(sf), "lr")).first()
    assert len(fits) == 2 and again.n_train < first.n_train


def test_duckdb_repeats_the_areas_of_the_folds(spark, tmp_path):
    """Areas from all pairs of a positive and a negative of the written fold predictions, ties counted half."""
    rows = [(i, float(i % 7), float((i * 13) % 29), int((i % 7) + (i * 13) % 29 > 15 + i % 9)) for i in range(300)]
    t = md.train(spark.createDataFrame(rows, "k long, a double, b double, con_incapacidad int"), "con_incapacidad", "lr", ["k"])
    pred = md.cv_predictions(t)
    pred.write.parquet(f"{tmp_path}/pred")
    got = sorted(md.cv_auc(pred).collect())
    want = duckdb.sql(f"""
        WITH p AS (SELECT * FROM read_parquet('{tmp_path}/pred/*.parquet'))
        SELECT a.fold, AVG(CASE WHEN a.p1 > b.p1 THEN 1.0 WHEN a.p1 = b.p1 THEN 0.5 ELSE 0 END)
        FROM p a JOIN p b ON a.fold = b.fold AND a.label = 1 AND b.label = 0 GROUP BY 1 ORDER BY 1""").fetchall()
    assert [r.fold for r in got] == [f for f, _ in want] == [0, 1, 2, 3, 4]
    assert all(r.auc == pytest.approx(a, abs=1e-6) for r, (_, a) in zip(got, want))
    mean = sum(a for _, a in want) / 5
    assert all(r.cv_mean == pytest.approx(mean, abs=1e-6) for r in got)
    assert pred.count() == pred.select("k").distinct().count() == 300
