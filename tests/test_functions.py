"""Scalar expressions on literal edge-case frames."""

import math

import pytest
from pyspark.sql import functions as F

from vigia.functions import rates, rules, text


def _one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_calc_if_guards(spark):
    rows = [(1.0, 240000.0), (2.0, 0.0), (3.0, -5.0), (4.0, None), (5.0, float("nan")), (0.0, 100.0)]
    got = _one(spark, rates.calc_if("n", "h"), "n double, h double", rows)
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_calc_if_rounds_to_4(spark):
    got = _one(spark, rates.calc_if("n", "h"), "n double, h double", [(1.0, 700000.0)])
    assert got == [round(240000 / 700000, 4)]


def test_severity_and_ili(spark):
    df = spark.createDataFrame([(3.0, 10.0), (0.0, 5.0), (None, 5.0)], "n double, d double")
    sev = [r[0] for r in df.select(rates.calc_severity("n", "d")).collect()]
    assert sev == [3.33, 0.0, 0.0]
    ili = spark.range(1).select(rates.calc_ili(F.lit(2.5204), F.lit(60.1))).first()[0]
    assert ili == round(2.5204 * 60.1 / 1000, 4)


def test_if_level_boundaries(spark):
    rows = [(2.54,), (2.5401,), (3.81,), (3.8101,), (None,), (float("nan"),), (0.0,)]
    got = _one(spark, rates.if_level("v"), "v double", rows)
    assert got == ["BAJO", "MEDIO", "MEDIO", "ALTO", "ALTO", "ALTO", "BAJO"]


def test_probability_band_boundaries(spark):
    got = _one(spark, rules.probability_band("p"), "p double", [(0.6,), (0.5999,), (0.35,), (0.3499,), (1.0,)])
    assert got == ["Alto", "Medio", "Medio", "Bajo", "Alto"]


@pytest.mark.parametrize("txt,expected", [
    ("12", 12.0), (" 3.5 ", 3.5), ("x", None), ("5d", None), ("3,5", None), ("1_000", None), ("", None),
    ("-2", -2.0), (".5", 0.5), ("1e3", 1000.0), ("NaN", None), (None, None)])
def test_parse_number(spark, txt, expected):
    got = _one(spark, text.parse_number("s"), "s string", [(txt,)])[0]
    assert got == expected


def test_seniority_sentinels(spark):
    rows = [("Sin información",), ("Sin informacion",), ("nan",), ("None",), ("",), (" 3 ",), ("abc",), (None,)]
    got = _one(spark, text.seniority("s"), "s string", rows)
    assert got == [5.0, 5.0, 5.0, 5.0, 5.0, 3.0, 5.0, 5.0]


def test_strip_tab_and_nbsp(spark):
    got = _one(spark, text.strip("s"), "s string", [("\tGraves ",), ("  Leves ",)])
    assert got == ["Graves", "Leves"]


def test_catalogue_prefix(spark):
    got = _one(spark, text.drop_catalogue_prefix("s"), "s string", [(" 1.Golpe ",), ("12. Torcedura",), ("Otros",)])
    assert got == ["Golpe", "Torcedura", "Otros"]


def test_category_null(spark):
    got = _one(spark, text.category("s"), "s string", [(None,), (" a ",)])
    assert got == ["Sin informacion", "a"]


def test_what_if(spark):
    df = spark.createDataFrame([(200000.0,)], "h double")
    r = df.select(*[v.alias(k) for k, v in rates.what_if(F.col("h"), F.lit(3.0)).items()]).first()
    assert r.IF_caso == 1.2 and r.IS_caso == 3.6 and r.delta_meta == round(1.2 - 2.54, 4)


def test_alert(spark):
    got = _one(spark, rates.accident_alert("m"), "m double", [(10.5,), (10.0,)])
    assert got == [rates.ALERT_HIGH, rates.ALERT_OK]


def test_rules_order_and_default(spark):
    schema = ("naturaleza string, mecanismo string, parte_cuerpo string, antiguedad double, agente string, "
              "tipo string, band string")
    rows = [("1.Lesion Lumbar", "x", "1.Espalda", 1.0, "1.Aeronave", "Transito", "Alto"),
            ("x", "1.Sobre-esfuerzo", "x", 10.0, "x", "Violencia", "Bajo"),
            ("x", "x", "x", 10.0, "x", "x", "Medio"),
            (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = df.select(rules.fired_rule_ids().alias("ids"), rules.recommendations().alias("recs")).collect()
    assert out[0].ids == [1, 2, 3, 4, 5, 7]
    assert out[1].ids == [1, 6]
    assert out[2].ids == [0] and out[2].recs == [rules.REC_DEFAULT]
    assert out[3].ids == [0]
    assert out[0].recs[0] == rules.REC_TEXTS[1]


def test_rules_case_sensitive(spark):
    df = spark.createDataFrame([("lumbar", "ESFUERZO")], "naturaleza string, mecanismo string")
    r = df.select(rules.fired_rule_ids(parte_cuerpo=F.lit(None).cast("string"), antiguedad=F.lit(9.0),
                                       agente=F.lit("x"), tipo=F.lit("x"), band=F.lit("Bajo"))).first()[0]
    assert r == [0]


def test_nan_is_not_positive(spark):
    assert not math.isnan(_one(spark, rates.calc_is("d", "h"), "d double, h double", [(1.0, float("nan"))])[0])


def test_rules_v2_variant(spark):
    schema = ("naturaleza string, mecanismo string, parte_cuerpo string, antiguedad double, agente string, "
              "tipo string, band string")
    rows = [("Lesión Lumbar", "x", "Manos", 1.0, "Turbulencia", "Tránsito", "Alto"),
            ("Lesion Lumbar", "Sobre-esfuerzo", "Miembros", 10.0, "presion", "Violencia", "Bajo"),
            ("x", "esfuerzo", "x", 10.0, "x", "Transito", "Medio")]
    df = spark.createDataFrame(rows, schema)
    out = df.select(rules.fired_rule_ids(variant="v2").alias("ids"),
                    rules.recommendations(variant="v2").alias("recs")).collect()
    assert out[0].ids == [1, 2, 3, 4, 5, 7]
    assert out[1].ids == [1]                       # no violence rule, "Miembros"/"presion" not in this list
    assert out[2].ids == [0] and out[2].recs == [rules.REC_DEFAULT_V2]
    assert out[0].recs[-1] == rules.REC_TEXTS_V2[7]
