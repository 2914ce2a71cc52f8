"""MLlib layer: fixed seeds, probabilities in [0, 1], separable data is
learned, importances sum to 1, the forecast is flat beyond the data, and
the registered model queries run on the smallest shared tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from vigia.operators import models as md

SF = "/root/testdata/sf0.001"


def _separable(spark, n=400):
    rows = [(i, float(i % 10), float((i * 7) % 13), 1 if i % 10 >= 5 else 0) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    return df.withColumn("dias_incapacidad", F.col("y").cast("double")) \
             .withColumn("con_incapacidad", F.col("y")).withColumn("incapacidad_alta", F.lit(0)).drop("y")


@pytest.mark.parametrize("algo", ["rf", "lr"])
def test_separable_fixture_is_learned(spark, algo):
    t = md.train(_separable(spark), "con_incapacidad", algo, ["k"])
    m = md.holdout_metrics(t).first()
    assert m.auc > 0.9 and m.n_test == 100 and m.n_train == 300
    p = t.test_pred.agg(F.min("p1"), F.max("p1")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0
    if algo == "rf":
        imp = md.feature_importance(t, 10).agg(F.sum("importancia")).first()[0]
        assert abs(imp - 1.0) < 1e-9
    else:
        assert md.feature_importance(t, 10).count() == 0


def test_single_class_is_rejected(spark):
    df = _separable(spark).withColumn("con_incapacidad", F.lit(1))
    with pytest.raises(ValueError, match="single class"):
        md.train(df, "con_incapacidad", "lr", ["k"])


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        md.build_estimator("svm")


def test_forecast_is_flat_beyond_data(spark):
    from vigia.sources.files import default_series
    f = md.forecast(default_series(spark)).collect()
    assert [r.Mes for r in f] == [13, 14, 15, 16, 17, 18]
    assert len({r.Accidentes for r in f}) == 1


@pytest.mark.parametrize("name", ["train_lr_metrics", "train_rf_metrics", "feature_importance_top10",
                                  "score_cases", "forecast_months", "cv_auc"])
def test_model_queries_run(spark, name):
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    assert len(rows) > 0
    if name == "score_cases":
        assert all(0.0 <= r.probabilidad <= 1.0 for r in rows)
        assert {r.banda for r in rows} <= {"Alto", "Medio", "Bajo"}
    if name == "cv_auc":
        assert len(rows) == 5 and len({r.cv_mean for r in rows}) == 1


def test_model_save_and_load(spark):
    from vigia.sources.files import scratch_path
    t = md.train(_separable(spark), "con_incapacidad", "lr", ["k"])
    path = md.save_model(t, scratch_path(spark, "model"))
    m = md.load_model(path).model
    a = md.p_class1(m.transform(t.data)).select("p1").collect()
    b = md.p_class1(t.model.transform(t.data)).select("p1").collect()
    assert a == b


def test_artefact_scores_other_data_with_its_own_codes(spark):
    from vigia.operators import features as ft
    from vigia.sources.files import scratch_path
    cats = ["clasificacion", "tipo", "estacion", "genero", "cargo", "naturaleza", "parte_cuerpo", "agente", "mecanismo"]
    cols = ", ".join(f"{c} string" for c in cats)
    rows = [(i, *[f"{c}{(i + j) % 3}" for j, c in enumerate(cats)], float(i % 9) if i % 7 else None,
             float(i % 2), i % 2) for i in range(200)]
    cases = spark.createDataFrame(rows, f"k long, {cols}, antiguedad double, dias_incapacidad double, con_incapacidad int")
    dictionary = ft.label_dictionary(cases, cats)
    enc = ft.encode(cases, dictionary, cats).drop("is_unseen")
    t = md.train(enc, "con_incapacidad", "rf", ["k"], dictionary)
    art = md.load_model(md.save_model(t, scratch_path(spark, "artefact")))
    assert (art.feats, art.algo, art.target) == (t.feats, "rf", "con_incapacidad")
    new = cases.filter("k < 4").withColumn("tipo", F.when(F.col("k") == 1, "never seen").otherwise(F.col("tipo")))
    got = {r.k: r for r in md.code_cases(art, new, ["k"]).collect()}
    want = {r.k: r for r in enc.filter("k < 4").collect()}
    for k, r in got.items():
        assert r.is_unseen == (k == 1) and r.tipo == (0.0 if k == 1 else want[k].tipo)
        assert all(r[c] == want[k][c] for c in cats if c != "tipo") and r.antiguedad == (want[k].antiguedad or 0.0)
    scored = md.score_cases(art, new, ["k"]).collect()
    assert [r.is_unseen for r in sorted(scored, key=lambda r: r.k)] == [False, True, False, False]


@pytest.mark.parametrize("algo", ["rf", "gbt", "lr"])
def test_second_target_trains_with_each_algorithm(spark, algo, monkeypatch):
    monkeypatch.setattr(md, "RF_PARAMS", dict(numTrees=10, maxDepth=4))
    monkeypatch.setattr(md, "GBT_PARAMS", dict(maxIter=5, maxDepth=3, stepSize=0.1))
    rows = [(i, float(i % 50), float((i * 7) % 45), int(i % 50 > 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, incapacidad_alta int")
    t = md.train(df, "incapacidad_alta", algo, ["k"])
    assert t.max_bins == 50 and md.holdout_metrics(t).first().auc > 0.9


def test_forecast_forest_splits_at_every_month(spark):
    series = spark.createDataFrame([(m, float((m * 37) % 101)) for m in range(1, 81)], "Mes int, Accidentes double")
    assert md.distinct_values(series, ["Mes"]) == 80
    got = [r.Accidentes for r in md.forecast(series).collect()]
    assert len(got) == 6 and len(set(got)) == 1
    last = float((80 * 37) % 101)
    # a forest that can set the last month apart follows it more than one that cannot
    assert abs(got[0] - last) < 30


def test_null_features_count_as_zero(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 10), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, a double, con_incapacidad int")
    data, feats, _ = md.assemble(df, "con_incapacidad", ["k"])
    assert feats == ["a"] and all(r.features[0] == 0.0 for r in data.filter("k % 5 = 0").collect())


def _labelled(spark, n=600):
    from pyspark.ml.feature import VectorAssembler
    rows = [(i, float(i % 10), float((i * 7) % 13), float((i * i) % 17), float(i % 10 + (i * 7) % 13 > 9 + i % 4), 1.0 + (i % 10 + (i * 7) % 13 > 9 + i % 4))
            for i in range(n)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, label double, w double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).select("k", "label", "w", "features")


def test_forest_is_that_of_the_rows_however_they_lie(spark, monkeypatch):
    """Bags follow from the rows, so partitions and passes do not matter, and nothing is kept with the rows."""
    from vigia.operators.forest import fit_forest
    from vigia.operators.model_tables import node_table
    monkeypatch.setattr(md, "RF_PARAMS", dict(numTrees=9, maxDepth=5))
    d, est = _labelled(spark), md.build_estimator("rf")
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    tables = [sorted(map(tuple, node_table(m, ["a", "b", "c"]).collect()), key=str) for m in (
        fit_forest(d.repartition(2), est, 3), fit_forest(d.repartition(7, "k"), est, 3), fit_forest(d, est, 3, pass_bytes=3000))]
    assert tables[0] == tables[1] == tables[2] and len({r[0] for r in tables[0]}) == 9
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    hit = fit_forest(d, est, 3).transform(d).filter("prediction = label").count()
    assert hit > 540


def test_forest_nodes_hold_the_rows_that_reach_them(spark, monkeypatch):
    """Every leaf has the bag weights of the rows that walk to it, and every split the best gain of its candidates."""
    import numpy as np
    from vigia.operators import forest as fo
    monkeypatch.setattr(md, "RF_PARAMS", dict(numTrees=3, maxDepth=4))
    d, est = _labelled(spark), md.build_estimator("rf")
    from vigia.operators.model_tables import node_table
    nodes = {(r.tree, r.node): r for r in node_table(fo.fit_forest(d, est, 3), ["a", "b", "c"]).collect()}
    rows = d.select(F.xxhash64("k", "label", "features").alias("h"), "label", "features").collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    for t in range(3):
        w = fo.bag_weights(h, t, md.SEED).astype(float) * np.where(y == 1, 2.0, 1.0)
        assert 0.8 < fo.bag_weights(h, t, md.SEED).mean() < 1.2
        todo = [(0, np.ones(len(x), bool))]
        while todo:
            i, here = todo.pop()
            n = nodes[t, i]
            assert n.rows == pytest.approx(w[here].sum()) and n.value * n.rows == pytest.approx(w[here & (y == 1)].sum())
            if n.feature >= 0:
                def gini(m):
                    s = w[m].sum()
                    return 0.0 if s == 0 else s * (1 - (w[m & (y == 1)].sum() / s) ** 2 - (w[m & (y == 0)].sum() / s) ** 2)
                gains = [(gini(here) - gini(here & (x[:, n.feature] <= v)) - gini(here & (x[:, n.feature] > v))) / n.rows for v in np.unique(x[:, n.feature])]
                assert n.gain == pytest.approx(max(gains))
                side = x[:, n.feature] <= n.threshold
                todo += [(n.left, here & side), (n.right, here & ~side)]


def test_booster_keeps_no_node_numbers():
    assert md.build_estimator("gbt").getCacheNodeIds() is False


def test_rows_of_a_fit_are_hashed_and_written_once(spark, monkeypatch):
    """The split's hash is computed with the copy of the cases and read from there, and the rows that a fit keeps are
    written where they stay: saving the fit writes the learner only."""
    from vigia.operators import features as ft
    from vigia.sources.files import scratch_path
    plans, wrote = [], []
    told, write = ft.keys_at_ranks, md.written
    monkeypatch.setattr(ft, "keys_at_ranks", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or told(df, *a, **k))
    monkeypatch.setattr(md, "written", lambda df, path=None: wrote.append(path) or write(df, path))
    path = scratch_path(spark, "once")
    t = md.train(_separable(spark), "con_incapacidad", "lr", ["k"], path=path)
    assert len(plans) == 2 and not any("md5" in p for p in plans)       # the split's cuts and those of the folds
    assert wrote == [None, f"{path}/data", f"{path}/test_pred"]
    files = lambda: sorted(f for x in ("data", "test_pred") for f in spark.read.parquet(f"{path}/{x}").inputFiles())
    before = files()
    md.save_trained(t, path)
    assert files() == before
    back = md.load_trained(path)
    assert md.holdout_metrics(back).first() == md.holdout_metrics(t).first()
    again = scratch_path(spark, "again")
    md.save_trained(t, again)                                           # elsewhere the rows are copied
    assert spark.read.parquet(f"{again}/data").count() == t.data.count() == 400


def test_split_and_folds_by_a_kept_hash_are_those_of_the_key(spark):
    """Flags by a hash column and by the hash itself agree, with null and repeated keys; a row before a key is told by the
    first column as by the whole key."""
    from vigia.operators import features as ft
    rows = [(None if i % 11 == 0 else i // 2, None if i % 7 == 0 else i % 5, i % 3 % 2) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], "a long, b int, y int").withColumn("at", ft.split_hash(["a", "b"], 42))
    own = ft.stratified_folds(ft.stratified_split(df, "y", ["a", "b"]), "y", ["a", "b"])
    kept = ft.stratified_folds(ft.stratified_split(df, "y", ["a", "b"], order="at"), "y", ["a", "b"])
    assert sorted(map(str, own.collect())) == sorted(map(str, kept.collect()))
    assert {r.fold for r in kept.collect()} == {0, 1, 2, 3, 4} and "lambda" not in kept._jdf.queryExecution().optimizedPlan().toString()
    for cut in ((17, 3), (17, None), (None, 2), (None, None)):
        key = F.struct(F.lit(cut[0]).cast("long").alias("a"), F.lit(cut[1]).cast("int").alias("b"))
        got = df.select(ft.before_key(key, ["a", "b"]).alias("x"), (F.struct("a", "b") < key).alias("y"))
        assert got.filter(~F.col("x").eqNullSafe(F.col("y"))).count() == 0


def test_categories_with_visible_ends_are_trimmed_like_the_others(spark):
    from vigia.functions import text as T
    ends = ["", " ", "\t", "\u00a0", "\u3000", "\x1f", "\x7f", "!", "~", "a", "\u00e9", "\u4fe1", "\U0001f600"]
    vals = [a + m + b for a in ends for m in ("", "x", "x y", "\u00e9") for b in ends]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*vals, None])], "i int, v string")
    got = {r.i: r.c for r in df.select("i", T.category("v").alias("c")).collect()}
    for i, v in enumerate(vals):
        assert got[i] == v.strip(), repr(v)
    assert got[len(vals)] == T.MISSING_CATEGORY
    assert "CASE WHEN" in df.select(T.category("v"))._jdf.queryExecution().optimizedPlan().toString()


def test_booster_grows_the_trees_of_the_learner(spark, monkeypatch):
    """Same splits, rows and steps as MLlib's booster, however the rows lie, across written margins; no row is cached."""
    from pyspark.ml.classification import GBTClassifier
    from vigia.operators import booster as bo
    from vigia.operators import forest as fo
    from vigia.operators.model_tables import node_table
    d, feats = _labelled(spark), ["a", "b", "c"]
    est = GBTClassifier(labelCol="label", featuresCol="features", maxIter=12, maxDepth=4, stepSize=0.1, seed=42)
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    own = bo.fit_booster(d, est, 3)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept and own.getNumTrees == 12 > 2 * bo.KEEP_TREES
    key = lambda r: (r.tree, r.feature, r.threshold or 0.0, r.rows, round(r.value, 6))
    got, want = (sorted(map(key, node_table(m, feats).collect())) for m in (own, est.fit(d)))
    assert [x[:4] for x in got] == [x[:4] for x in want] and [x[4] for x in got] == pytest.approx([x[4] for x in want], abs=1e-6)
    monkeypatch.setattr(fo, "CHUNK_ROWS", 37)
    again = bo.fit_booster(d.repartition(5, "k"), est, 3)
    assert sorted(map(str, node_table(again, feats).collect())) == sorted(map(str, node_table(own, feats).collect()))


def test_forest_of_many_bins_and_small_chunks(spark, monkeypatch):
    """More than 256 values take bins of two bytes; the chunks' size does not matter."""
    from pyspark.ml.feature import VectorAssembler
    from vigia.operators import forest as fo
    from vigia.operators.model_tables import node_table
    monkeypatch.setattr(md, "RF_PARAMS", dict(numTrees=5, maxDepth=4))
    rows = [(i, float(i % 331), float(i % 3), float(i % 331 > 290), 1.0) for i in range(900)]
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "k long, a double, b double, label double, w double")).select("k", "label", "w", "features")
    one = fo.fit_forest(d, md.build_estimator("rf"), 2)
    assert one.transform(d).filter("prediction = label").count() > 890
    monkeypatch.setattr(fo, "CHUNK_ROWS", 50)
    two = fo.fit_forest(d.repartition(3, "k"), md.build_estimator("rf"), 2)
    assert sorted(map(str, node_table(one, ["a", "b"]).collect())) == sorted(map(str, node_table(two, ["a", "b"]).collect()))


def test_trees_are_scored_without_the_learner(spark, monkeypatch):
    """Fold and test scores of a forest are those of the learner, which is not asked."""
    from pyspark.ml.classification import RandomForestClassificationModel
    monkeypatch.setattr(md, "RF_PARAMS", dict(numTrees=9, maxDepth=4))
    asked, transform = [], RandomForestClassificationModel.transform
    monkeypatch.setattr(RandomForestClassificationModel, "transform", lambda m, *a: asked.append(1) or transform(m, *a))
    t = md.train(_separable(spark), "con_incapacidad", "rf", ["k"])
    assert md.cv_predictions(t).count() == 400 and not asked
    told = {r.k: r for r in md.p_class1(t.model.transform(t.data)).select("k", "p1", "prediction").collect()}
    for r in t.test_pred.collect():
        assert r.p1 == pytest.approx(told[r.k].p1, abs=1e-12) and r.prediction == told[r.k].prediction


def test_learners_share_the_assembled_rows(spark, tmp_path, monkeypatch):
    import shutil

    from vigia.plans import catalog
    for t in catalog.CASE_TABLES:
        shutil.copyfile(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    monkeypatch.setattr(md, "GBT_PARAMS", dict(maxIter=2, maxDepth=2, stepSize=0.1))
    made, assemble = [], md.assemble
    monkeypatch.setattr(md, "assemble", lambda *a, **k: made.append(1) or assemble(*a, **k))
    fits = [catalog.trained(spark, str(tmp_path), algo) for algo in ("lr", "gbt", "lr")]
    assert len(made) == 1 and len({t.data_path for t in fits}) == 1
    assert len({(t.data.count(), tuple(t.feats), t.max_bins) for t in fits}) == 1
