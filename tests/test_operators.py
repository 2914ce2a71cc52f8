"""Operators on literal frames: the edge cases the shared tables cannot show."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigia.operators import cases as cs
from vigia.operators import exposure as ex
from vigia.operators import features as ft
from vigia.operators import indicators as ind
from vigia.operators import metrics as mt
from vigia.operators import profile as pf
from vigia.operators.ordering import row_index, running_totals
from vigia.sources import files as io
from vigia.sources import grid

BOARD_SCHEMA = ("Mes string, Meses string, Unidad_Negocio string, Estacion string, Poblacion string, "
                "N_AT string, N_AT_IND string, N_Dias_Total string, N_Dias_Ind string, HHT string, "
                "IF string, IF_IND string, IS string")


def board_rows():
    return [
        ("1", "JAN", "U", "A", "P1", "2", "1", "10", "5", "100000", "x", "0", "0"),
        ("1", "JAN", "U", "A", "P2", "0", "0", "0", "0", "50000", "0", "0", "0"),      # no accidents
        ("Mes", "Meses", "U", "Estacion", "Poblacion", "N_AT", "", "", "", "HHT", "", "", ""),  # repeated header
        (None, None, "U", "B", "P1", "5", "0", "3", "0", "1000", "0", "0", "0"),       # no month
        ("2", "FEB", "U", "B", "P1", "1", "0", "x", "0", "bad", "0", "0", "0"),        # unparsable
        ("2", "FEB", "U", "C", "P1", "3", "0", "30", "0", "120000", "0", "0", "0"),
    ]


def test_clean_exposure_filters(spark):
    df = spark.createDataFrame(board_rows(), BOARD_SCHEMA)
    out = ex.clean_exposure(df, fuente="GENERAL").orderBy("Estacion").collect()
    assert [r.Estacion for r in out] == ["A", "B", "C"]
    b = out[1]
    assert b.N_Dias_Total == 0.0 and b.HHT == 0.0 and b.fuente == "GENERAL"
    keep = ex.clean_exposure(df, keep_zero_incident_rows=True).count()
    assert keep == 4


def test_station_rates_sum_then_ratio(spark):
    df = ex.clean_exposure(spark.createDataFrame(board_rows(), BOARD_SCHEMA), keep_zero_incident_rows=True)
    out = {r.Estacion: r for r in ex.rates_by_station(df).collect()}
    # A: 2 accidents over 150000 hours (the accident-free row's hours count when kept)
    assert out["A"].IF == round(2 * 240000 / 150000, 4)
    assert out["B"].IF == 0.0 and out["B"].Nivel_IF == "BAJO"     # hours 0 -> 0
    assert out["C"].IF == 6.0 and out["C"].Nivel_IF == "ALTO"


def test_faithful_drop_inflates_if(spark):
    df = spark.createDataFrame(board_rows(), BOARD_SCHEMA)
    faithful = {r.Estacion: r.IF for r in ex.rates_by_station(ex.clean_exposure(df)).collect()}
    assert faithful["A"] == round(2 * 240000 / 100000, 4)


def test_global_kpis_truncate(spark):
    df = spark.createDataFrame([("1", "A", 2.7, 3.9, 1000.0)], "Mes string, Estacion string, N_AT double, "
                               "N_Dias_Total double, HHT double")
    r = ex.board_kpis(df).first()
    assert r.N_AT == 2 and r.N_Dias == 3
    assert r.ILI == round(r.IF * r.IS / 1000, 4)


def test_topk_population_ties(spark):
    rows = [("A", f"P{i:02d}", "1", 1.0, 0.0, 1000.0) for i in range(15)]
    df = spark.createDataFrame(rows, "Estacion string, Poblacion string, Mes string, N_AT double, "
                               "N_Dias_Total double, HHT double")
    out = ex.rates_by_population_topk(df, 12).orderBy("rank").collect()
    assert len(out) == 12 and [r.Poblacion for r in out][:3] == ["P00", "P01", "P02"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(1, 5), st.integers(1, 100000)),
                min_size=1, max_size=20))
def test_property_station_totals_equal_global(spark, rows):
    df = spark.createDataFrame([(s, "1", float(n), 0.0, float(h)) for s, n, h in rows],
                               "Estacion string, Mes string, N_AT double, N_Dias_Total double, HHT double")
    per = ex.rates_by_station(df).agg(F.sum("N_AT")).first()[0]
    assert per == sum(n for _, n, _ in rows)
    assert ex.board_kpis(df).first().N_AT == sum(n for _, n, _ in rows)


def test_melt_and_ytd(spark):
    from vigia.operators.indicators import MONTHS
    vals = [("XX", *[1.0 if i < 2 else 0.0 for i in range(12)], 2.0), ("YY", *[0.0] * 12, 0.0),
            ("ZZ", *[5.0] * 12, 5.0), ("WW", *[1.0] * 12, 1.0)]
    schema = "Estacion string, " + ", ".join(f"{m} double" for m in MONTHS) + ", ACUM double"
    total = ind.clean_indicator(spark.createDataFrame(vals + [("Q", *[1.0] * 12, 1.0)], schema))
    melt = ind.melt_months(total)
    assert melt.filter(F.col("Estacion") == "XX").count() == 2
    assert melt.filter(F.col("Estacion") == "YY").count() == 0
    ytd = [r.Estacion for r in ind.ytd_ranking(total).collect()]
    assert ytd[0] == "ZZ" and "YY" not in ytd
    # one-character stations are dropped by the cleaning
    assert "Q" not in [r.Estacion for r in total.collect()]


def test_left_join_duplicates_multiply(spark):
    from vigia.operators.indicators import MONTHS
    schema_t = "Estacion string, " + ", ".join(f"{m} double" for m in MONTHS) + ", ACUM double"
    schema_i = "Estacion string, " + ", ".join(f"{m} double" for m in MONTHS)
    t = spark.createDataFrame([("AA", *[1.0] * 12, 1.0), ("BB", *[1.0] * 12, 1.0)], schema_t)
    i = spark.createDataFrame([("AA", *[2.0] * 12), ("AA", *[3.0] * 12)], schema_i)
    out = ind.total_vs_indicator(t, i)
    assert out.count() == 3
    assert out.filter(F.col("Estacion") == "BB").first().IF_IND_JAN is None


def test_grid_promote_and_slice(spark):
    cells = [("s", "Data", 0, 0, "title"), ("s", "Data", 1, 1, "x"), ("s", "Data", 2, 1, "a"), ("s", "Data", 2, 2, "b"),
             ("s", "Data", 3, 1, "1"), ("s", "Data", 3, 2, "2"), ("s", "Data", 4, 2, "4")]
    g = spark.createDataFrame(cells, "source string, sheet string, row_no int, col_no int, value string")
    body = grid.promote_header(g, "Data", skip_rows=1)
    assert body.count() == 3 and set(r.name for r in body.collect()) == {"a", "b"}
    wide = grid.block_slice(body, 1, ["first", "second"]).orderBy("row_no").collect()
    assert [(r.first, r.second) for r in wide] == [("1", "2"), (None, "4")]


def test_slice_catalogue_cuts_all_blocks_in_one_pass(spark):
    """Two sources, two sheets, overlapping blocks, a row range and a missing cell."""
    cells = []
    for src in ("s", "t"):
        for row in range(6):
            cells += [(src, "Data", row, c, f"{src}{row}{c}") for c in range(1, 5) if (row, c) != (4, 2)]
            cells += [(src, "Two", row, c, f"{src}-{row}{c}") for c in (1, 2)]
    g = spark.createDataFrame(cells, "source string, sheet string, row_no int, col_no int, value string")
    cat = grid.slice_catalogue(spark, [grid.Slice("Data", "L", 1, 1, ("a", "b")), grid.Slice("Data", "R", 1, 2, ("x", "y", "z")),
                                       grid.Slice("Two", "L", 0, 1, ("k",), first_row=1, n_rows=2)])
    rows = grid.slice_blocks(g, cat)
    assert rows.count() == 2 * (3 * 2 - 1 + 3 * 3 - 1 + 2)
    wide = grid.wide_blocks(rows, 3)
    left = grid.block_table(wide, "L", ["a", "b"]).filter("sheet = 'Data' and source = 't'").orderBy("row_no").collect()
    assert [(r.row_no, r.a, r.b) for r in left] == [(3, "t31", "t32"), (4, "t41", None), (5, "t51", "t52")]
    two = wide.filter("sheet = 'Two'").orderBy("source", "row_no").collect()
    assert [(r.source, r.row_no, r.c0, r.c1) for r in two] == [("s", 3, "s-31", None), ("s", 4, "s-41", None),
                                                              ("t", 3, "t-31", None), ("t", 4, "t-41", None)]
    with pytest.raises(ValueError, match="twice"):
        grid.slice_catalogue(spark, [grid.Slice("Data", "L", 1, 1, ("a",))] * 2)


def test_population_order_does_not_change_the_set(spark):
    """14 populations: ordered by IS the table still holds the twelve of the highest IF."""
    rows = [("s", f"p{i:02d}", float(i + 1), float(100 - 7 * i), 1000.0) for i in range(14)]
    df = spark.createDataFrame(rows, "Estacion string, Poblacion string, N_AT double, N_Dias_Total double, HHT double")
    by_if = ex.rates_by_population_topk(df, 12).orderBy("rank").collect()
    by_is = ex.rates_by_population_topk(df, 12, by="IS").orderBy("rank").collect()
    assert [r.Poblacion for r in by_if] == [f"p{i:02d}" for i in range(13, 1, -1)]
    assert {r.Poblacion for r in by_is} == {r.Poblacion for r in by_if}
    assert [r.IS for r in by_is] == sorted((r.IS for r in by_if), reverse=True)


def test_view_without_display_columns_is_the_whole_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    view = cs.filter_cases(df, ["Graves"], ["PROMO"])
    assert view.columns == ["x", "y"] and view.count() == 2


def test_what_if_scenario_table(spark):
    b = spark.createDataFrame([("A", "1", 1000.0), ("A", "2", 0.0), ("B", "1", 500.0), ("B", "1", 500.0)],
                              "Estacion string, Mes string, HHT double")
    cols = "escenario string, Estacion string, Mes string, horas double, factor_horas double, dias double"
    sc = spark.createDataFrame([("all", None, None, None, None, 1.0), ("twice", None, None, None, 2.0, 3.0), ("A", "A", None, None, 1.0, 9.0),
                                ("fixed", "B", "1", 240000.0, None, 4.0), ("none", None, None, 0.0, 1.0, 4.0), ("no such", "Z", None, None, 1.0, 1.0),
                                ("january", None, "1", None, 1.0, 2.0)], cols)
    got = {(r.escenario, r.Estacion, r.Mes): (r.HHT, r.IF_caso, r.IS_caso) for r in ex.what_if_scenarios(b, sc).collect()}
    assert got == {("all", "A", "1"): (1000, 240, 240), ("all", "B", "1"): (1000, 240, 240), ("twice", "A", "1"): (2000, 120, 360),
                   ("twice", "B", "1"): (2000, 120, 360), ("A", "A", "1"): (1000, 240, 2160), ("fixed", "B", "1"): (240000, 1, 4),
                   ("january", "A", "1"): (1000, 240, 480), ("january", "B", "1"): (1000, 240, 480)}
    assert ex.what_if_scenarios(b, sc.limit(0)).count() == 0


def test_drop_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "a int, b string, c string")
    assert cs.drop_all_null_columns(df).columns == ["a", "c"]


def test_require_and_select_available(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="c"):
        cs.require_columns(df, ["a", "c"])
    assert cs.select_available(df, ["c", "b", "a"]).columns == ["b", "a"]
    assert cs.rename_positional(df, ["x", "y"]).columns == ["x", "y"]


def _register(spark, rows):
    schema = ", ".join(f"`{c}` string" for c in cs.SOURCE_TO_PLAIN)
    return spark.createDataFrame(rows, schema)


def test_prepare_cases(spark):
    rows = [("Leves ", "Otro", "Cali", None, "Piloto", "Sin información", "1.Golpe", "1.Espalda", "1.Equipaje",
             "1.Otros", "7"),
            ("Graves", "Transito", "Cali", "F", "Piloto", " 2 ", "1.Golpe", "1.Pie", "1.Equipaje", "1.Otros", "x")]
    m = cs.prepare(_register(spark, rows)).collect()
    assert m[0].clasificacion == "Leves" and m[0].genero == "Sin informacion" and m[0].antiguedad == 5.0
    assert m[0].con_incapacidad == 1 and m[0].incapacidad_alta == 1
    assert m[1].antiguedad == 2.0 and m[1].dias_incapacidad == 0.0 and m[1].con_incapacidad == 0


def test_prepare_strict_and_tolerant(spark):
    df = spark.createDataFrame([("Leves", "3")], "`Clasificación del accidente` string, `Total días de incapacidad` string")
    with pytest.raises(ValueError):
        cs.prepare(df)
    out = cs.prepare(df, strict=False).first()
    assert out.clasificacion == "Leves" and out.dias_incapacidad == 3.0


def test_median_seniority(spark):
    rows = [("Leves", "T", "E", "F", "C", v, "n", "p", "a", "m", "0") for v in ("2", "4", "Sin información", "10")]
    m = cs.prepare(_register(spark, rows), seniority_median=True)
    assert sorted(r.antiguedad for r in m.collect()) == [2.0, 4.0, 4.0, 10.0]


def test_case_kpis_and_job_mean(spark):
    rows = [("Graves", "T", "E", "F", "C1", "1", "n", "p", "a", "m", "4"),
            ("Leves", "T", "E", "F", "C1", "1", "n", "p", "a", "m", "x"),
            ("Leves", "T", "E", "F", None, "1", "n", "p", "a", "m", "8")]
    plain = cs.normalize_names(_register(spark, rows))
    k = cs.case_kpis(plain).first()
    assert k.total == 3 and k.n_graves == 1 and k.pct_incapacidad == round(200 / 3, 4) and k.promedio_dias == 6.0
    j = cs.mean_days_by_job(plain).collect()
    assert [(r.Cargo, r.Dias_promedio) for r in j] == [("C1", 4.0)]     # "x" ignored, null job dropped


def test_case_kpis_no_leave(spark):
    rows = [("Leves", "T", "E", "F", "C1", "1", "n", "p", "a", "m", "0")]
    k = cs.case_kpis(cs.normalize_names(_register(spark, rows))).first()
    assert k.promedio_dias == 0.0 and k.pct_incapacidad == 0.0


def test_filter_empty_selection(spark):
    rows = [("Leves", "T", "E", "F", "C1", "1", "n", "p", "a", "m", "0"),
            ("Graves", "U", "E", "F", "C1", "1", "n", "p", "a", "m", "0")]
    plain = cs.normalize_names(_register(spark, rows))
    assert cs.filter_cases(plain, [], None).count() == 2
    assert cs.filter_cases(plain, ["Graves"], []).count() == 1
    assert cs.filter_cases(plain, ["Graves"], ["T"]).count() == 0


def test_dictionary_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "x string")
    d = ft.label_dictionary(df, ["x"])
    assert sorted((r.valor, r.codigo) for r in d.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    new = spark.createDataFrame([("c",), ("zz",)], "x string")
    e = ft.encode(new, d, ["x"]).collect()
    assert (e[0].x, e[0].is_unseen) == (2.0, False) and (e[1].x, e[1].is_unseen) == (0.0, True)


def test_dictionary_is_dense_over_many_ranges(spark):
    """Values in the order of their code points, whatever range they fall in; a null comes first."""
    names = [None, "", "a", "Z", "é", "\U0001F600", "\uffff", *[f"v{i}" for i in range(3000)]]
    df = spark.createDataFrame([(n, names[i // 2]) for i, n in enumerate(names)] * 2, "x string, y string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ft.label_dictionary(df, ["x", "y"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for c in ("x", "y"):
        mine = {r.valor: r.codigo for r in got if r.columna == c}
        have = {r[c] for r in df.select(c).collect()}
        want = sorted(have, key=lambda v: (v is not None, (v or "").encode()))
        assert mine == {v: i for i, v in enumerate(want)}
    assert ft.label_dictionary(df.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize("value_bytes", [1 << 20, 0])
def test_encode_in_one_lookup(spark, value_bytes):
    """One value or one join: the same codes, every row once, repeated and null values included."""
    rows = [(i, f"a{i % 50}" if i % 11 else None, f"a{i % 7}" if i % 3 else "hot", "" if i % 2 else "é") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x string, y string, z string")
    df = df.unionByName(df.filter("k < 5"))
    d = ft.label_dictionary(df.filter("k >= 100"), ["x", "y", "z"]).filter("valor is not null and valor != 'a6'")
    codes = {(r.columna, r.valor): r.codigo for r in d.collect()}
    got = ft.encode(df, d, ["x", "y", "z"], value_bytes=value_bytes)
    assert got.columns == ["k", "x", "y", "z", "is_unseen"] and got.count() == 405
    raw = {r[0]: r[1:] for r in rows}
    for r in got.collect():
        want = [codes.get((c, v)) for c, v in zip("xyz", raw[r.k])]
        assert [r.x, r.y, r.z] == [float(w or 0) for w in want] and r.is_unseen == (None in want)
    empty = ft.encode(df, d.limit(0), ["x"], value_bytes=value_bytes)
    assert {(r.x, r.is_unseen) for r in empty.collect()} == {(0.0, True)}
    assert ft.encode(df.limit(0), d, ["x"], value_bytes=value_bytes).count() == 0


def test_median_of_seniority_is_exact(spark):
    years = ["1", "2", "4", "40", "x", None, "NO REGISTRA"]
    for some, want in ((years, 3.0), (years[:3], 2.0), (["x", None], 5.0)):
        raw = _register(spark, [("Leves", "T", "E", "F", "C1", y, "n", "p", "a", "m", "0") for y in some])
        got = [r.antiguedad for r in cs.prepare(raw, seniority_median=True).collect()]
        assert sorted(got) == sorted(float(y) if y and y.isdigit() else want for y in some)


@pytest.mark.parametrize("n0,n1", [(7, 5), (100, 37), (3, 3), (1, 10)])
def test_split_allocation_and_membership(spark, n0, n1):
    rows = [(i, 0) for i in range(n0)] + [(1000 + i, 1) for i in range(n1)]
    df = spark.createDataFrame(rows, "k long, y int")
    s = ft.stratified_split(df, "y", ["k"], 0.25, seed=42)
    n = n0 + n1
    n_test = -(-n // 4)
    got = {r.y: r["count"] for r in s.filter("is_test").groupBy("y").count().collect()}
    assert sum(got.values()) == n_test
    assert s.count() == n


@pytest.mark.parametrize("n0,n1", [(12, 8), (5, 5), (23, 4)])
def test_folds_partition_rows(spark, n0, n1):
    rows = [(i, 0) for i in range(n0)] + [(1000 + i, 1) for i in range(n1)]
    df = spark.createDataFrame(rows, "k long, y int")
    f = ft.stratified_folds(df, "y", ["k"], 5)
    sizes = {(r.fold, r.y): r["count"] for r in f.groupBy("fold", "y").count().collect()}
    assert sum(sizes.values()) == n0 + n1
    # contiguous blocks per class in key order
    for y in (0, 1):
        folds = [r.fold for r in f.filter(F.col("y") == y).orderBy("k").collect()]
        assert folds == sorted(folds)


def test_weights_sum_to_n(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)] * 3, "y int")
    w = {r.label: (r.n, r.weight) for r in ft.balanced_weights(df, "y").collect()}
    assert w[0][1] == 12 / (2 * 9) and w[1][1] == 12 / (2 * 3)
    assert abs(sum(n * wt for n, wt in w.values()) - 12) < 1e-9


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=2, max_size=40))
def test_property_auc_complement(spark, rows):
    if len({y for y, _ in rows}) < 2:
        return
    df = spark.createDataFrame([(y, s / 20.0) for y, s in rows], "label int, score double")
    a = mt.roc_auc(df).first()[0]
    b = mt.roc_auc(df.withColumn("score", 1 - F.col("score"))).first()[0]
    assert abs(a + b - 1) < 1e-12
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(a - brute) < 1e-12


def test_roc_curve_shape(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.5), (0, 0.4)], "label int, score double")
    pts = [(r.fpr, r.tpr) for r in mt.roc_curve(df).orderBy("fpr", "tpr").collect()]
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    full = mt.roc_curve(df, drop_intermediate=False).count()
    assert full == 7 and len(pts) < full


def test_confusion_keeps_empty_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1)], "label int, pred int")
    cm = {(r.actual, r.predicted): r.n for r in mt.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    rep = {r.clase: r for r in mt.classification_report(df).collect()}
    assert rep["0"].precision == 0.0 and rep["0"].recall == 0.0 and rep["1"].recall == 1.0
    assert rep["accuracy"].precision == round(2 / 3, 3)


def test_running_totals_match_window(spark):
    rows = [(i % 3, (i * 7919) % 101, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v int, one int")
    out = running_totals(df, ["v"], {"s": F.col("one")}, group_cols=["g"], n_buckets=8, max_groups=3)
    for r in out.collect():
        assert r.s == r._idx + 1
    idx = row_index(spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "k string"), ["k"], n_buckets=4)
    assert sorted(r._idx for r in idx.collect()) == list(range(50))
    assert all(int(r.k[1:]) == r._idx for r in idx.collect())


def test_profile_matches_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, 2.0, 3.5, 10.0, 7.25, 0.5]
    df = spark.createDataFrame([(v, v * 2) for v in vals], "a double, b double")
    r = {x.column: x for x in pf.profile_numeric(df, ["a", "b"], n_bins=4).collect()}
    d = pd.Series(vals).describe()
    assert r["a"]["count"] == 7 and r["a"].p25 == round(d["25%"], 6) and r["a"].p50 == d["50%"]
    assert r["a"].p75 == round(d["75%"], 6) and r["a"].std == round(d["std"], 6)


def test_default_series_and_alert(spark):
    s = io.series_or_default(spark, None)
    r = pf.monthly_alert(s).first()
    assert r.Accidentes_promedio == 10.5 and r.alerta == "Riesgo alto de accidentalidad"
    path = io.scratch_path(spark, "series") + ".csv"
    io.export(s.drop("Mes"), path, fmt="csv")
    with pytest.raises(ValueError, match="Mes"):
        io.series_or_default(spark, path)
    ok = io.scratch_path(spark, "series") + ".csv"
    io.export(s, ok, fmt="csv")
    back = io.series_or_default(spark, ok)
    assert back.count() == 12 and sorted(back.columns) == ["Accidentes", "Mes"]


def test_format_dispatch():
    assert io.format_of("/x/a.csv") == "csv" and io.format_of("/x/a.parquet") == "parquet"
    with pytest.raises(ValueError):
        io.format_of("/x/book.xlsx")


def test_preview_is_topk(spark):
    df = spark.range(100).withColumn("k", (F.col("id") * 37) % 100)
    assert [r.k for r in pf.preview(df, 3, ["k"]).collect()] == [0, 1, 2]


def test_value_counts_raw_v2(spark):
    df = spark.createDataFrame([("1. Golpe",), ("1. Golpe",), ("1.Corte",), (" Caida",), (None,), (None,),
                                (None,), ("2. Golpe",)], "Naturaleza string")
    out = cs.value_counts_raw(df, "Naturaleza", "Naturaleza", top=3, relabel_prefix=True).collect()
    # nulls dropped, counts on the stored values; only "<digits>. " (with the space) is removed, after the top-N
    assert [(r.Naturaleza, r.Cantidad) for r in out] == [("Golpe", 2), ("Caida", 1), ("1.Corte", 1)]
    plain = cs.value_counts_raw(df, "Naturaleza", "N").collect()
    assert sum(r.Cantidad for r in plain) == 5 and " Caida" in {r.N for r in plain}


def test_v2_kpis_and_unrounded_job_mean(spark):
    rows = [("Leves", "T", "E", "F", "C1", "1", "n", "p", "a", "m", "0")]
    k = cs.case_kpis(cs.normalize_names(_register(spark, rows)), no_leave_mean=float("nan")).first()
    assert k.promedio_dias != k.promedio_dias                  # NaN, as the earliest variant shows it
    rows = [("Leves", "T", "E", "F", "C1", "1", "n", "p", "a", "m", "1"),
            ("Leves", "T", "E", "F", "C1", "1", "n", "p", "a", "m", "1"),
            ("Leves", "T", "E", "F", "C1", "1", "n", "p", "a", "m", "2")]
    j = cs.mean_days_by_job(cs.normalize_names(_register(spark, rows)), digits=None).first()
    assert j.Dias_promedio == 4 / 3


def test_fit_encode_on_train_rows(spark):
    df = spark.createDataFrame([("b", False), ("a", False), ("z", True), ("a", True)], "x string, is_test boolean")
    out = {(r.is_test, r.x, r.is_unseen) for r in ft.fit_encode(df, ["x"], fit_rows=~F.col("is_test")).collect()}
    # "z" only occurs in test rows: unseen by the train-fitted dictionary -> code 0 and flagged
    assert out == {(False, 1.0, False), (False, 0.0, False), (True, 0.0, True), (True, 0.0, False)}
    leak = {r.x for r in ft.fit_encode(df, ["x"]).collect()}
    assert leak == {0.0, 1.0, 2.0}          # fitted on all rows: "z" gets its own code


def test_encoded_cases_fit_on_train(spark, sf_small):
    from vigia.plans import catalog
    e = catalog.encoded_cases(spark, sf_small, fit_on="train")
    assert {"is_test", "is_unseen"} <= set(e.columns)
    assert e.count() == catalog.encoded_cases(spark, sf_small).count()
    with pytest.raises(ValueError):
        catalog.encoded_cases(spark, sf_small, fit_on="test")


def test_spread_only_narrow_scans(spark):
    from vigia.session import spread
    one = spark.range(1000).coalesce(1)
    s = spread(one, ["id"])
    assert s.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.id for r in s.collect()) == list(range(1000))          # rows kept whole
    wide = spark.range(0, 1000, 1, 16)
    assert spread(wide, ["id"]) is wide                                    # enough splits: unchanged


def test_attach_row_single_subquery(spark):
    from vigia.session import attach_row
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    tot = df.agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    out = attach_row(df, tot)
    assert sorted((r.x, r.s, r.n) for r in out.collect()) == [(1, 6, 3), (2, 6, 3), (3, 6, 3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_keys_at_ranks_hot_key_refinement(spark, limit):
    from pyspark.sql import Window
    from vigia.operators.ordering import keys_at_ranks
    # label 0 has one hot leading value (a third of its rows) with ties broken by the second column
    rows = [(0, 7, i) for i in range(30)] + [(0, k, 0) for k in range(60)] + [(1, k % 5, k) for k in range(40)] \
        + [(0, 7, 99)] * 4                           # full-key duplicates inside the hot value
    df = spark.createDataFrame(rows, "label int, a int, b int")
    ranks = spark.createDataFrame([(0, r) for r in range(0, 94, 7)] + [(1, r) for r in (0, 13, 39, 40)],
                                  "label int, r long")
    got = {(r.label, r.r): (r.key.a, r.key.b)
           for r in keys_at_ranks(df, "label", ["a", "b"], ranks, n_bins=4, max_sort_rows=limit).collect()}
    w = Window.partitionBy("label").orderBy("a", "b")
    brute = {(r.label, r.rn): (r.a, r.b)
             for r in df.withColumn("rn", F.row_number().over(w) - 1).collect()}
    want = {(l, r): brute[(l, r)] for l, r in [(0, r) for r in range(0, 94, 7)] + [(1, 0), (1, 13), (1, 39)]}
    assert got == want


def test_row_index_keeps_null_keys_and_groups(spark):
    from vigia.operators.ordering import row_index
    for kind, rows in (("string", [("b",), (None,), ("a",)]), ("double", [(2.0,), (None,), (1.0,)])):
        got = row_index(spark.createDataFrame(rows, f"k {kind}"), ["k"]).collect()
        assert [r.k for r in sorted(got, key=lambda r: r._idx)] == [None, *sorted(x[0] for x in rows if x[0])]
    df = spark.createDataFrame([("g", 1), (None, 5), (None, 3), ("g", None), (None, None)], "g string, k int")
    got = {(r.g, r.k): r._idx for r in row_index(df, ["k"], ["g"]).collect()}
    assert got == {("g", None): 0, ("g", 1): 1, (None, None): 0, (None, 3): 1, (None, 5): 2}
    assert row_index(df.filter("k is null"), ["k"]).count() == 2


def test_auc_and_curve_leave_null_scores_out(spark):
    from vigia.operators import metrics as mt
    rows = [(1, 0.2), (0, None), (1, None), (0, 0.1), (None, 0.9)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert mt.roc_auc(df).first().auc == 1.0
    assert [(r.fpr, r.tpr) for r in mt.roc_curve(df).orderBy(mt.F.desc("threshold")).collect()] == [(0, 0), (0, 1), (1, 1)]


def test_auc_and_curve_of_one_class_are_null(spark):
    from vigia.operators import metrics as mt
    one = spark.createDataFrame([(1, 0.2), (1, 0.7)], "label int, score double")
    assert mt.roc_auc(one).first().auc is None
    assert all(r.fpr is None for r in mt.roc_curve(one).filter("threshold < 1").collect())
    assert mt.roc_auc(one.limit(0)).first().auc is None


def test_split_leaves_rows_without_label_unmarked(spark):
    from vigia.operators import features as ft
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "k long, y int")
    got = ft.stratified_split(df, "y", ["k"]).collect()
    assert len(got) == 100 and all((r.is_test is None) == (r.y is None) for r in got)
    assert sum(bool(r.is_test) for r in got) == 23


def test_checkpoint_folder_is_required_on_a_cluster(spark):
    import types

    from vigia.session import checkpoint_dir
    conf = types.SimpleNamespace(get=lambda k, d=None: d)
    far = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(far)


def test_text_order_is_cut_inside_a_shared_prefix(spark, monkeypatch):
    """Keys that share a long prefix still fall into many ranges."""
    from vigia.operators import ordering
    seen = []
    real = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df: seen.append(real(df)) or seen[-1])
    df = spark.createDataFrame([(f"NATION_{i:04d}",) for i in range(2000)], "k string").repartition(5)
    got = ordering.row_index(df, ["k"], n_buckets=16).collect()
    assert all(r._idx == int(r.k[-4:]) for r in got)
    sizes = [r["count"] for r in seen[0].groupBy("_bucket").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 600


# --- exact quantiles, neighbours of running totals, reader with bad records -----------

@settings(max_examples=6, deadline=None)
@given(values=st.lists(st.one_of(st.none(), st.just(float("nan")), st.sampled_from([1.0, 2.0, 7.5]),
                                 st.floats(-1e6, 1e6)), max_size=60),
       accuracy=st.sampled_from([3, 50, 10_000]), limit=st.sampled_from([1, 5, 1_000_000]))
def test_exact_quantiles_property(spark, values, accuracy, limit):
    """Any sketch accuracy and any limit of a last step give numpy's quantiles."""
    import numpy as np

    from vigia.operators.quantiles import exact_quantiles
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(2)
    fractions = (0.0, 0.25, 0.5, 0.9, 1.0)
    row, got = exact_quantiles(df, ["v"], fractions, {"n": F.count}, accuracy=accuracy, max_sort_rows=limit)
    real = [v for v in values if v is not None and v == v]
    assert row["n0"] == len(real)
    for f in fractions:
        if real:
            assert got["v", f] == pytest.approx(float(np.quantile(real, f)), rel=1e-12, abs=1e-9)
        else:
            assert got["v", f] is None


def test_exact_quantiles_hot_value_and_refinement(spark):
    """A value with a third of all rows, and stretches that must be cut again."""
    import numpy as np

    from vigia.operators.quantiles import exact_quantiles
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(5_000.0)).otherwise(F.col("id").cast("double")).alias("a b"),
                                    F.sqrt(F.col("id").cast("double")).alias("w"))
    pdf = df.toPandas()
    _, got = exact_quantiles(df, ["a b", "w"], (0.1, 0.25, 0.5, 0.75), accuracy=20, max_sort_rows=40)
    for c in ("a b", "w"):
        for f in (0.1, 0.25, 0.5, 0.75):
            assert got[c, f] == pytest.approx(float(np.quantile(pdf[c], f)), rel=1e-12)


def test_profile_skips_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    rows = pf.profile_numeric(df, ["a", "b"]).collect()
    assert [(r.column, r["count"], r.p50) for r in rows] == [("a", 2, 2.0)]
    assert pf.profile_numeric(df.limit(0), ["a", "b"]).collect() == []


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_following(spark, descending):
    rows = [(g, float(v), i) for i, (g, v) in enumerate((i % 2, (i * 37) % 101) for i in range(101))]
    rows = list({(g, v): (g, v, i) for g, v, i in rows}.values())
    df = spark.createDataFrame(rows, "g int, v double, x int")
    out = running_totals(df, ["v"], {"s": F.col("x")}, ["g"], descending=descending, n_buckets=7, max_groups=2,
                         following={"nx": F.col("x")})
    got = {(r.g, r.v): (r.s, r.nx) for r in out.collect()}
    assert set(out.columns) == {"g", "v", "x", "s", "_idx", "nx"}
    for g in (0, 1):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending)
        total = 0
        for k, (_, v, x) in enumerate(mine):
            total += x
            assert got[g, v] == (total, mine[k + 1][2] if k + 1 < len(mine) else None)


@settings(max_examples=10, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=1, max_size=60))
def test_roc_curve_drops_collinear_points_only(spark, rows):
    df = spark.createDataFrame([(y, s / 12) for y, s in rows], "label int, score double")
    pos, neg = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    pts, tp, fp = [], 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        tp += sum(y for y, t in rows if t == s)
        fp += sum(1 - y for y, t in rows if t == s)
        pts.append((s / 12, fp, tp))
    keep = [p for k, p in enumerate(pts) if k in (0, len(pts) - 1) or
            any(pts[k + 1][c] - 2 * p[c] + pts[k - 1][c] for c in (1, 2))]
    want = [(t, f / neg if neg else None, p / pos if pos else None) for t, f, p in keep]
    got = [tuple(r) for r in mt.roc_curve(df).filter("threshold < 2").orderBy(F.desc("threshold")).collect()]
    assert got == want


def test_load_checked_routes_bad_records(spark, tmp_path):
    schema = "a int, b double, c string"
    (tmp_path / "x.csv").write_text("a,b,c\n1,2.5,u\nx,1,v\n3,,\n4\n\n5,6,w,extra\n")
    good, bad = io.load_checked(spark, str(tmp_path / "x.csv"), schema)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2.5, "u"), (3, None, None)]
    assert sorted(r.line for r in bad.collect()) == ["4", "5,6,w,extra", "x,1,v"]
    assert all(r.file.endswith("/x.csv") for r in bad.collect())
    (tmp_path / "y.json").write_text('{"a":1,"b":2.5,"c":"u"}\n{"a":"x"}\n{"a":2\n\n{"c":"only"}\n[1,2]\n')
    good, bad = io.load_checked(spark, str(tmp_path / "y.json"), schema)
    assert sorted((tuple(r) for r in good.collect()), key=repr) == [(1, 2.5, "u"), (None, None, "only")]
    assert {'{"a":"x"}', '{"a":2'} <= {r.line for r in bad.collect()}
    spark.createDataFrame([(1, 2.0, "p")], schema).write.parquet(str(tmp_path / "z.parquet"))
    good, bad = io.load_checked(spark, str(tmp_path / "z.parquet"), schema)
    assert good.count() == 1 and bad.count() == 0 and bad.columns == ["file", "line"]
    (tmp_path / "none.csv").write_text("a,b,c\n")
    good, bad = io.load_checked(spark, str(tmp_path / "none.csv"), schema)
    assert good.count() == 0 and bad.count() == 0
