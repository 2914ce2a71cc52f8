"""DuckDB SQL oracles, one per registered query that SQL can express."""

from __future__ import annotations

from vigia.plans.sqlparts import LOST_DAYS, SENIORITY_SENTINELS, d, sql_if, sql_is, sql_level, sql_sev, with_exposure

ORACLES: dict[str, str] = {}


def _station_rates(src: str, keys: str) -> str:
    return f"""
  SELECT {keys}, SUM(N_AT) AS N_AT, SUM(N_Dias_Total) AS N_Dias, SUM(HHT) AS h
  FROM {src} GROUP BY {keys}"""


ORACLES["rate_by_station"] = with_exposure(f"""
, g AS ({_station_rates('general', 'Estacion')})
SELECT Estacion, N_AT, N_Dias, round(h, 3) AS HHT,
       {sql_if('N_AT', 'h')} AS "IF", {sql_is('N_Dias', 'h')} AS "IS",
       {sql_sev('N_AT', 'N_Dias')} AS Severidad, {sql_level(sql_if('N_AT', 'h'))} AS Nivel_IF
FROM g WHERE N_AT > 0
""")


ORACLES["rate_agil_by_station"] = ORACLES["rate_by_station"].replace(
    "FROM general GROUP BY", "FROM exposure WHERE fuente = 'AGIL' GROUP BY")

ORACLES["exposure_clean"] = with_exposure("SELECT * FROM exposure")

ORACLES["rate_global"] = with_exposure(f"""
, s AS (SELECT CAST(trunc(coalesce(SUM(N_AT), 0)) AS BIGINT) AS N_AT,
               CAST(trunc(coalesce(SUM(N_Dias_Total), 0)) AS BIGINT) AS N_Dias,
               coalesce(SUM(HHT), {d(0.0)}) AS h FROM general),
r AS (SELECT N_AT, N_Dias, h, {sql_if('N_AT', 'h')} AS "IF", {sql_is('N_Dias', 'h')} AS "IS",
             {sql_sev('N_AT', 'N_Dias')} AS Severidad FROM s)
SELECT N_AT, N_Dias, round(h, 3) AS HHT, "IF", "IS", Severidad,
       round("IF" * "IS" / {d(1000.0)}, 4) AS ILI, {sql_level('"IF"')} AS Nivel_IF FROM r
""")

ORACLES["rate_by_population_top12"] = with_exposure(f"""
, g AS ({_station_rates('general', 'Estacion, Poblacion')}),
r AS (SELECT Estacion, Poblacion, N_AT, N_Dias, h, {sql_if('N_AT', 'h')} AS "IF", {sql_is('N_Dias', 'h')} AS "IS"
      FROM g WHERE N_AT > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY Estacion ORDER BY "IF" DESC, Poblacion ASC) AS rk FROM r)
SELECT Estacion, Poblacion, CAST(rk AS INTEGER) AS rank, N_AT, N_Dias, round(h, 3) AS HHT, "IF", "IS"
FROM k WHERE rk <= 12
""")

# the same twelve populations, ranked by IS
ORACLES["rate_by_population_is"] = ORACLES["rate_by_population_top12"].replace("CAST(rk AS INTEGER) AS rank", """CAST(row_number()
       OVER (PARTITION BY Estacion ORDER BY "IS" DESC, Poblacion ASC) AS INTEGER) AS rank""")

ORACLES["rate_by_month"] = with_exposure(f"""
, g AS ({_station_rates('general', 'Estacion, Mes')})
SELECT Estacion, CAST(Mes AS INTEGER) AS Mes, round(N_AT, 3) AS N_AT, round(N_Dias, 3) AS N_Dias,
       round(h, 3) AS HHT, round({sql_if('N_AT', 'h')}, 3) AS "IF", round({sql_is('N_Dias', 'h')}, 3) AS "IS"
FROM g
""")

ORACLES["rate_grouping_sets"] = with_exposure(f"""
, e AS (SELECT Estacion, Poblacion, CAST(Mes AS INTEGER) AS Mes, N_AT, N_Dias_Total, HHT FROM general),
g AS (SELECT Estacion, Poblacion, Mes, SUM(N_AT) AS N_AT, SUM(N_Dias_Total) AS N_Dias, SUM(HHT) AS h,
             GROUPING(Estacion, Poblacion, Mes) AS gid
      FROM e GROUP BY GROUPING SETS ((), (Estacion), (Estacion, Poblacion), (Estacion, Mes)))
SELECT CASE gid WHEN 7 THEN 'global' WHEN 3 THEN 'estacion' WHEN 1 THEN 'estacion_poblacion'
                ELSE 'estacion_mes' END AS grain,
       Estacion, Poblacion, Mes, N_AT, N_Dias, round(h, 3) AS HHT,
       {sql_if('N_AT', 'h')} AS "IF", {sql_is('N_Dias', 'h')} AS "IS", {sql_sev('N_AT', 'N_Dias')} AS Severidad,
       {sql_level(sql_if('N_AT', 'h'))} AS Nivel_IF
FROM g
""")

ORACLES["rate_what_if"] = with_exposure(f"""
, s AS (SELECT Estacion, Mes, SUM(HHT) AS h FROM general GROUP BY Estacion, Mes)
SELECT Estacion, Mes, round(h, 3) AS HHT, {sql_if(d(1.0), 'h')} AS IF_caso, {sql_is(d(3.0), 'h')} AS IS_caso,
       round({sql_if(d(1.0), 'h')} - {d(2.54)}, 4) AS delta_meta
FROM s WHERE h > 0
""")

ORACLES["rate_what_if_scenarios"] = with_exposure(f"""
, s AS (SELECT Estacion, Mes, SUM(HHT) AS h FROM general GROUP BY Estacion, Mes),
first_of AS (SELECT MIN(Estacion) AS Estacion FROM general GROUP BY Unidad_Negocio),
x AS (SELECT 'leve' AS escenario, Estacion, Mes, h, 1 AS dias FROM s WHERE h > 0
      UNION ALL SELECT 'grave', Estacion, Mes, h, 30 FROM s WHERE h > 0
      UNION ALL SELECT 'doble turno', Estacion, Mes, 2 * h, 3 FROM s WHERE h > 0
      UNION ALL SELECT 'enero', Estacion, Mes, h, 15 FROM s WHERE h > 0 AND Mes = '1'
      UNION ALL SELECT 'mes de 20000 h', Estacion, Mes, 20000, 6 FROM s WHERE h > 0 AND Mes = '6'
      UNION ALL SELECT 'estacion', Estacion, Mes, {d(0.5)} * h, 10 FROM s WHERE h > 0 AND Estacion IN (SELECT Estacion FROM first_of)),
y AS (SELECT escenario, Estacion, Mes, CAST(h AS DOUBLE) AS h, CAST(dias AS DOUBLE) AS dias FROM x)
SELECT escenario, Estacion, Mes, round(h, 3) AS HHT, dias, {sql_if(d(1.0), 'h')} AS IF_caso, {sql_is('dias', 'h')} AS IS_caso,
       round({sql_if(d(1.0), 'h')} - {d(2.54)}, 4) AS delta_meta
FROM y
""")

# --- indicator sheet ---------------------------------------------------------

MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def _indicator_ctes() -> str:
    def wide(acc: str, ytd: bool) -> str:
        cols = []
        for i, m in enumerate(MONTHS, start=1):
            n = f"SUM(CASE WHEN CAST(Mes AS INTEGER) = {i} THEN {acc} END)"
            h = f"SUM(CASE WHEN CAST(Mes AS INTEGER) = {i} THEN HHT END)"
            cols.append(f"{sql_if(n, h)} AS {m}")
        if ytd:
            cols.append(f"{sql_if(f'SUM({acc})', 'SUM(HHT)')} AS ACUM")
        return (f"SELECT Estacion, {', '.join(cols)} FROM exposure_rated WHERE fuente = 'GENERAL' "
                f"GROUP BY Estacion HAVING length(Estacion) > 1")
    return f", ind_total AS ({wide('N_AT', True)}), ind_ind AS ({wide('N_AT_IND', False)})"


ORACLES["indicator_melt"] = with_exposure(_indicator_ctes() + f"""
, u AS (UNPIVOT (SELECT Estacion, {', '.join(MONTHS)} FROM ind_total WHERE ACUM > 0)
        ON {', '.join(MONTHS)} INTO NAME Mes VALUE "IF")
SELECT Estacion, Mes, "IF" FROM u WHERE "IF" > 0
""")

ORACLES["indicator_ytd"] = with_exposure(_indicator_ctes() + f"""
SELECT Estacion, ACUM AS IF_YTD, {sql_level('ACUM')} AS Nivel FROM ind_total WHERE ACUM > 0
""")

ORACLES["indicator_total_vs_ind"] = with_exposure(_indicator_ctes() + f"""
SELECT t.Estacion, {', '.join(f'round(t.{m}, 3) AS IF_{m}' for m in MONTHS)}, round(t.ACUM, 3) AS IF_ACUM,
       {', '.join(f'round(i.{m}, 3) AS IF_IND_{m}' for m in MONTHS)}
FROM ind_total t LEFT JOIN ind_ind i ON t.Estacion = i.Estacion
""")

# --- sheet grid ----------------------------------------------------------------

_BOARD_NAMES = ["Mes", "Meses", "Unidad_Negocio", "Estacion", "Poblacion", "N_AT", "N_AT_IND", "N_Dias_Total",
                "N_Dias_Ind", "HHT", "IF", "IF_IND", "IS"]


def _cell_text(c: str) -> str:
    if c in ("N_AT", "N_AT_IND", "N_Dias_Total", "N_Dias_Ind"):
        return f'CAST(CAST("{c}" AS BIGINT) AS VARCHAR)'
    if c == "HHT":
        return 'CAST(CAST(HHT AS DECIMAL(20,3)) AS VARCHAR)'
    if c in ("IF", "IF_IND", "IS"):
        return f'CAST(CAST("{c}" AS DECIMAL(20,4)) AS VARCHAR)'
    return f'"{c}"'


def _grid_ctes() -> str:
    data_cells = []
    for fuente, col_from in (("GENERAL", 1), ("AGIL", 16)):
        for i, c in enumerate(_BOARD_NAMES):
            data_cells.append(f"SELECT row_no, {col_from + i} AS col_no, {_cell_text(c)} AS value "
                              f"FROM grid_rows WHERE fuente = '{fuente}'")
    head = ["SELECT 0 AS row_no, 0 AS col_no, 'Tablero Accidentalidad' AS value",
            "SELECT 1, 1, 'GENERAL'", "SELECT 1, 16, 'AGIL'"]
    for col_from in (1, 16):
        for i, n in enumerate(_BOARD_NAMES):
            head.append(f"SELECT 2, {col_from + i}, '{n}'")
            head.append(f"SELECT n + 3, {col_from + i}, '{n}' FROM general_rows")
    return f"""
, grid_rows AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY fuente ORDER BY Estacion, Poblacion, CAST(Mes AS INTEGER)) + 2
                 AS INTEGER) AS row_no
  FROM exposure_rated),
general_rows AS MATERIALIZED (SELECT COUNT(*) AS n FROM grid_rows WHERE fuente = 'GENERAL'),
grid AS MATERIALIZED (
  SELECT 'board' AS source, 'Data' AS sheet, CAST(row_no AS INTEGER) AS row_no, CAST(col_no AS INTEGER) AS col_no, value
  FROM ({' UNION ALL '.join(data_cells + head)}) WHERE value IS NOT NULL),
header AS (SELECT col_no, value AS name FROM grid WHERE row_no = 2),
cells AS (SELECT g.source, g.sheet, g.row_no, g.col_no, h.name, g.value
          FROM grid g LEFT JOIN header h ON g.col_no = h.col_no WHERE g.row_no > 2)
"""


ORACLES["grid_promote_header"] = with_exposure(_grid_ctes() + "SELECT * FROM cells")
ORACLES["grid_block_slice"] = ORACLES["exposure_clean"]


def _indicator_cells(table: str, block: str, names: list[str]) -> str:
    """The first 12 rows of an indicator table as cells of its sheet."""
    text = ["Estacion", *[f"CAST(CAST({n} AS DECIMAL(20,4)) AS VARCHAR)" for n in names[1:]]]
    cells = ", ".join(f"{{'name': '{n}', 'value': {v}}}" for n, v in zip(names, text))
    return (f"SELECT 'board' AS source, 'Data Indicadores' AS sheet, '{block}' AS block, row_no, c.name AS name, c.value AS value "
            f"FROM (SELECT row_no, unnest([{cells}]) AS c FROM (SELECT *, CAST(row_number() OVER (ORDER BY Estacion) + 1 AS INTEGER) "
            f"AS row_no FROM {table}) WHERE row_no < 14) WHERE c.value IS NOT NULL")


ORACLES["grid_slices"] = with_exposure(_indicator_ctes() + _grid_ctes() + f"""
SELECT source, sheet, CASE WHEN col_no < 14 THEN 'GENERAL' ELSE 'AGIL' END AS block, row_no, name, value
FROM cells WHERE col_no BETWEEN 1 AND 13 OR col_no BETWEEN 16 AND 28
UNION ALL {_indicator_cells('ind_total', 'TOTAL', ['Estacion', *MONTHS, 'ACUM'])}
UNION ALL {_indicator_cells('ind_ind', 'INDICADOR', ['Estacion', *MONTHS])}
""")

_AS_SHOWN = ", ".join(f"CAST(CAST({m} AS DECIMAL(20,4)) AS DOUBLE) AS {m}" for m in MONTHS)
ORACLES["indicator_sheet"] = with_exposure(_indicator_ctes() + f"""
SELECT Estacion, {_AS_SHOWN}, CAST(CAST(ACUM AS DECIMAL(20,4)) AS DOUBLE) AS ACUM, 'TOTAL' AS bloque
FROM ind_total QUALIFY row_number() OVER (ORDER BY Estacion) <= 12
UNION ALL SELECT Estacion, {_AS_SHOWN}, NULL, 'INDICADOR' FROM ind_ind QUALIFY row_number() OVER (ORDER BY Estacion) <= 12
""")

# --- case register ---------------------------------------------------------------

from vigia.plans.sqlparts import (MODEL_COLS, sql_num, sql_num_or, sql_prefix_drop, sql_strip,  # noqa: E402
                                  with_cases)

ORACLES["case_clean"] = with_cases(f"SELECT {', '.join(MODEL_COLS)} FROM cases_model")

ORACLES["case_kpis"] = with_cases(f"""
, k AS (SELECT {sql_num_or('r_dias', 0.0)} AS dd, r_clas FROM cases_raw)
SELECT COUNT(*) AS total,
       round(coalesce(avg(CASE WHEN dd > 0 THEN {d(1.0)} ELSE {d(0.0)} END) * {d(100.0)}, {d(0.0)}), 4) AS pct_incapacidad,
       round(coalesce(avg(CASE WHEN dd > 0 THEN dd END), {d(0.0)}), 4) AS promedio_dias,
       CAST(coalesce(SUM(CASE WHEN {sql_strip("coalesce(r_clas, 'nan')")} = 'Graves' THEN 1 ELSE 0 END), 0) AS BIGINT)
         AS n_graves
FROM k
""")


def _counts(expr: str, name: str, top: int | None) -> str:
    lim = f" ORDER BY Cantidad DESC, {name} ASC LIMIT {top}" if top else ""
    return with_cases(f"SELECT {expr} AS {name}, COUNT(*) AS Cantidad FROM cases_raw GROUP BY 1{lim}")


ORACLES["class_counts"] = _counts(sql_strip("coalesce(r_clas, 'nan')"), "Clasificacion", None)
ORACLES["type_top7"] = _counts(sql_strip("coalesce(r_tipo, 'nan')"), "Tipo", 7)
ORACLES["nature_top8"] = _counts(sql_prefix_drop("coalesce(r_nat, 'nan')"), "Naturaleza", 8)
ORACLES["bodypart_top8"] = _counts(sql_prefix_drop("coalesce(r_parte, 'nan')"), "Parte", 8)



def _counts_raw(col: str, name: str, top: int, relabel: bool) -> str:
    label = sql_strip(rf"regexp_replace({name}, '^\d+\. ', '')") if relabel else name
    return with_cases(f"""
, t AS (SELECT {col} AS {name}, COUNT(*) AS Cantidad FROM cases_raw WHERE {col} IS NOT NULL GROUP BY 1
        ORDER BY Cantidad DESC, {name} ASC LIMIT {top})
SELECT {label} AS {name}, Cantidad FROM t""")


ORACLES["type_top6_v2"] = _counts_raw("r_tipo", "Tipo", 6, False)
ORACLES["nature_top8_v2"] = _counts_raw("r_nat", "Naturaleza", 8, True)
ORACLES["bodypart_top8_v2"] = _counts_raw("r_parte", "Parte", 8, True)

ORACLES["job_mean_days_top10_v2"] = with_cases(f"""
, g AS (SELECT r_cargo AS Cargo, avg({sql_num('r_dias')}) AS m FROM cases_raw WHERE r_cargo IS NOT NULL GROUP BY r_cargo)
SELECT Cargo, m AS Dias_promedio FROM g ORDER BY m DESC NULLS LAST, Cargo ASC LIMIT 10
""")

ORACLES["job_mean_days_top10"] = with_cases(f"""
, g AS (SELECT r_cargo AS Cargo, avg({sql_num('r_dias')}) AS m FROM cases_raw WHERE r_cargo IS NOT NULL GROUP BY r_cargo)
SELECT Cargo, round(m, 2) AS Dias_promedio FROM g ORDER BY m DESC NULLS LAST, Cargo ASC LIMIT 10
""")

ORACLES["case_filter"] = with_cases("""
SELECT r_clas AS "Clasificacion del accidente", r_tipo AS "Tipo de accidente", r_gen AS "Genero",
       r_cargo AS "Puesto/Cargo", r_ant AS "Antiguedad en anos", r_nat AS "Naturaleza",
       r_parte AS "Parte del cuerpo afectada", r_agente AS "Agente de la lesion",
       r_mec AS "Mecanismo de accidente/ Tipo de contacto", r_dias AS "Total dias de incapacidad"
FROM cases_raw WHERE r_clas IN ('Graves', 'Severos') AND r_tipo IN ('PROMO', 'STANDARD')
""")

ORACLES["case_filter_counts"] = with_cases("""
SELECT COUNT(*) AS n_total,
       COUNT(*) FILTER (WHERE r_clas IN ('Graves', 'Severos') AND r_tipo IN ('PROMO', 'STANDARD')) AS n_filtrados
FROM cases_raw
""")

ORACLES["filter_options"] = with_cases("""
SELECT DISTINCT columna, valor FROM (
  SELECT 'Clasificacion del accidente' AS columna, r_clas AS valor FROM cases_raw
  UNION ALL SELECT 'Tipo de accidente', r_tipo FROM cases_raw) WHERE valor IS NOT NULL
""")

ORACLES["seniority_median_impute"] = with_cases(f"""
, a AS (SELECT CASE WHEN {sql_strip('r_ant')} IN {SENIORITY_SENTINELS} THEN NULL ELSE {sql_num(sql_strip('r_ant'))} END
               AS v FROM cases_raw),
m AS (SELECT median(v) AS med FROM a)
SELECT coalesce(v, med, {d(5.0)}) AS antiguedad, COUNT(*) AS n FROM a, m GROUP BY 1
""")

# --- profile, series, preview --------------------------------------------------------

ORACLES["profile_numeric"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT({c}) AS "count", round(avg(CAST({c} AS DECIMAL(38,12))), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       min({c}) AS "min", round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS "max" FROM lineitem WHERE NOT isnan({c})"""
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])

_KEEP_GRID_COLS = [c for c in range(29) if c not in (0, 14, 15)]
ORACLES["drop_all_null_columns"] = with_exposure(_grid_ctes() + f"""
SELECT row_no, {', '.join(f'max(CASE WHEN col_no = {c} THEN value END) AS c{c}' for c in _KEEP_GRID_COLS)}
FROM cells GROUP BY row_no
""")

MONTHLY = """
monthly AS (
  SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS ym, COUNT(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1
),
series AS (
  SELECT CAST(ym - (SELECT min(ym) FROM monthly) + 1 AS INTEGER) AS Mes, CAST(n AS DOUBLE) AS Accidentes FROM monthly
)
"""

ORACLES["monthly_alert"] = "WITH " + MONTHLY.strip() + f"""
SELECT round(avg(Accidentes), 2) AS Accidentes_promedio,
       CASE WHEN avg(Accidentes) > {d(10.0)} THEN 'Riesgo alto de accidentalidad' ELSE 'Riesgo controlado' END AS alerta
FROM series
"""

ORACLES["preview_rows"] = with_cases(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(MODEL_COLS)} FROM cases_model
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 300
""")

# --- features --------------------------------------------------------------------------

CATEGORICAL = ["clasificacion", "tipo", "estacion", "genero", "cargo", "naturaleza", "parte_cuerpo", "agente",
               "mecanismo"]
_DICT = ", dict AS (SELECT columna, valor, CAST(row_number() OVER (PARTITION BY columna ORDER BY valor) - 1 AS INTEGER) " \
        "AS codigo FROM (" + " UNION ".join(
            f"SELECT DISTINCT '{c}' AS columna, {c} AS valor FROM cases_model" for c in CATEGORICAL) + "))"

ORACLES["label_dictionary"] = with_cases(_DICT + " SELECT * FROM dict")

ORACLES["encode_cases"] = with_cases(_DICT + f"""
SELECT {', '.join(f'CAST(coalesce(d{i}.codigo, 0) AS DOUBLE) AS {c}' for i, c in enumerate(CATEGORICAL))},
       m.antiguedad, m.dias_incapacidad, m.con_incapacidad, m.incapacidad_alta,
       ({' OR '.join(f'd{i}.codigo IS NULL' for i in range(len(CATEGORICAL)))}) AS is_unseen
FROM cases_model m
{' '.join(f"LEFT JOIN (SELECT valor, codigo FROM dict WHERE columna = '{c}') d{i} ON m.{c} = d{i}.valor"
          for i, c in enumerate(CATEGORICAL))}
""")

_ALLOC = """
, cc AS (SELECT con_incapacidad AS label, COUNT(*) AS c FROM cases_model GROUP BY 1),
t1 AS (SELECT label, c, SUM(c) OVER () AS n FROM cc),
t2 AS (SELECT *, CAST(ceil(CAST(n AS DOUBLE) * 0.25) AS BIGINT) AS n_test FROM t1),
t3 AS (SELECT *, n - n_test AS n_train, (CAST(c AS HUGEINT) * (n - n_test)) // n AS base,
              (CAST(c AS HUGEINT) * (n - n_test)) % n AS rem FROM t2),
t4 AS (SELECT *, n_train - SUM(base) OVER () AS need, row_number() OVER (ORDER BY rem DESC, label ASC) - 1 AS r FROM t3),
alloc AS (SELECT label, c, CAST(base + CASE WHEN r < need THEN 1 ELSE 0 END AS BIGINT) AS train FROM t4)
"""

ORACLES["stratified_split_sizes"] = with_cases(_ALLOC + """
SELECT 'train' AS split, label, train AS n FROM alloc
UNION ALL SELECT 'test', label, CAST(c - train AS BIGINT) FROM alloc
""")

_SPLIT = _ALLOC + """
, drawn AS (SELECT *, row_number() OVER (PARTITION BY con_incapacidad ORDER BY
              CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, '42')), 1, 15)
                   AS BIGINT), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS nth FROM cases_model),
member AS (SELECT d.*, d.nth <= a.c - a.train AS is_test FROM drawn d JOIN alloc a ON d.con_incapacidad = a.label)
"""

ORACLES["split_membership"] = with_cases(_SPLIT + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, is_test FROM member
""")

ORACLES["score_inputs"] = with_cases(_SPLIT + ", dict AS (SELECT columna, valor, CAST(row_number() OVER (PARTITION BY "
                                     "columna ORDER BY valor) - 1 AS INTEGER) AS codigo FROM (" + " UNION ".join(
    f"SELECT DISTINCT '{c}' AS columna, {c} AS valor FROM member WHERE NOT is_test" for c in CATEGORICAL) + f"""))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {', '.join(f'CAST(coalesce(d{i}.codigo, 0) AS DOUBLE) AS {c}' for i, c in enumerate(CATEGORICAL))},
       CAST(coalesce(m.antiguedad, 0) AS DOUBLE) AS antiguedad,
       ({' OR '.join(f'd{i}.codigo IS NULL' for i in range(len(CATEGORICAL)))}) AS is_unseen
FROM member m
{' '.join(f"LEFT JOIN (SELECT valor, codigo FROM dict WHERE columna = '{c}') d{i} ON m.{c} = d{i}.valor"
          for i, c in enumerate(CATEGORICAL))}
""")

# the facts that every fit must meet; the values of a fit are beyond SQL
ORACLES["model_checks"] = with_cases(_ALLOC + """
, n AS (SELECT SUM(train) AS n_train, SUM(c - train) AS n_test,
               SUM(CASE WHEN label = 1 THEN c - train ELSE 0 END) AS n_positive FROM alloc)
SELECT algo, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, CAST(n_test AS BIGINT) AS n_scored,
       CAST(n_positive AS BIGINT) AS n_positive, TRUE AS probabilities_ok, TRUE AS auc_ok, TRUE AS importances_ok
FROM n, (VALUES ('lr'), ('rf')) a(algo)
""")

ORACLES["score_checks"] = with_cases("""
SELECT COUNT(*) AS n, TRUE AS probabilities_ok, COUNT(*) AS n_nivel, CAST(0 AS BIGINT) AS n_unseen FROM cases_model
""")

ORACLES["class_weights"] = with_cases(_ALLOC + """
SELECT label, train AS n, CAST(SUM(train) OVER () AS DOUBLE) / (CAST(COUNT(*) OVER () AS DOUBLE) * CAST(train AS DOUBLE))
       AS weight FROM alloc
""")

_FOLDS = """
, r AS (SELECT con_incapacidad AS label,
               row_number() OVER (PARTITION BY con_incapacidad
                                  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS rn
        FROM cases_model),
cc AS (SELECT label, COUNT(*) AS c FROM r GROUP BY label),
c0 AS (SELECT label, c, coalesce(SUM(c) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before
       FROM cc),
f AS (SELECT label, fold, floor((c_before + c + 4 - fold) / 5) - floor((c_before + 4 - fold) / 5) AS n
      FROM c0, (SELECT CAST(range AS INTEGER) AS fold FROM range(5))),
u AS (SELECT label, fold, SUM(n) OVER (PARTITION BY label ORDER BY fold) AS upto FROM f),
rf AS (SELECT r.label, (SELECT CAST(COUNT(*) AS INTEGER) FROM u WHERE u.label = r.label AND u.upto <= r.rn) AS fold FROM r)
"""

ORACLES["cv_fold_sizes"] = with_cases(_FOLDS + "SELECT fold, label, COUNT(*) AS n FROM rf GROUP BY fold, label")

# the areas themselves are the learner's; a test lets DuckDB repeat them from the written fold predictions
ORACLES["cv_checks"] = with_cases(_FOLDS + """
SELECT fold, COUNT(*) AS n_scored, CAST(SUM(label) AS BIGINT) AS n_positive, TRUE AS probabilities_ok, TRUE AS once_ok,
       TRUE AS auc_ok, TRUE AS mean_ok
FROM rf GROUP BY fold
""")

# --- evaluation on the score proxy -----------------------------------------------------------

SCORED = f"""WITH scored AS (
  SELECT CAST({LOST_DAYS} > 0 AS INTEGER) AS label,
         CAST((l_partkey * 37 + l_suppkey * 11) % 1000 AS DOUBLE) / {d(1000.0)} AS score
  FROM lineitem),
sp AS (SELECT *, CAST(score >= {d(0.5)} AS INTEGER) AS pred FROM scored),
g AS (SELECT score, CAST(SUM(label) AS BIGINT) AS pos, CAST(SUM(1 - label) AS BIGINT) AS neg FROM scored GROUP BY score),
pts AS (SELECT score, pos, neg,
               SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
               SUM(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
               row_number() OVER (ORDER BY score DESC) - 1 AS idx FROM g),
tot AS (SELECT SUM(pos) AS P, SUM(neg) AS N, COUNT(*) AS M FROM g)
"""

ORACLES["roc_auc"] = SCORED + f"""
SELECT SUM(CAST(pos AS DOUBLE) * (CAST(N - fps AS DOUBLE) + {d(0.5)} * CAST(neg AS DOUBLE)))
       / (CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) AS auc
FROM pts, tot
"""

ORACLES["roc_curve"] = SCORED + f"""
, nb AS (SELECT *, lag(tps) OVER (ORDER BY idx) AS tp_p, lag(fps) OVER (ORDER BY idx) AS fp_p,
                lead(tps) OVER (ORDER BY idx) AS tp_n, lead(fps) OVER (ORDER BY idx) AS fp_n FROM pts)
SELECT CAST('inf' AS DOUBLE) AS threshold, {d(0.0)} AS fpr, {d(0.0)} AS tpr
UNION ALL
SELECT score, CAST(fps AS DOUBLE) / CAST(N AS DOUBLE), CAST(tps AS DOUBLE) / CAST(P AS DOUBLE)
FROM nb, tot
WHERE idx = 0 OR idx = M - 1 OR coalesce(fp_n - 2 * fps + fp_p <> 0 OR tp_n - 2 * tps + tp_p <> 0, false)
"""

ORACLES["confusion_matrix"] = SCORED + """
, cells AS (SELECT a AS actual, p AS predicted FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(p)),
c AS (SELECT label AS actual, pred AS predicted, COUNT(*) AS n FROM sp GROUP BY 1, 2)
SELECT CAST(cells.actual AS INTEGER) AS actual, CAST(cells.predicted AS INTEGER) AS predicted,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM cells LEFT JOIN c ON cells.actual = c.actual AND cells.predicted = c.predicted
"""


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE {d(0.0)} END"


ORACLES["classification_report"] = SCORED + f"""
, c AS (SELECT CAST(SUM(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS c00,
               CAST(SUM(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c01,
               CAST(SUM(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS c10,
               CAST(SUM(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c11 FROM sp),
m AS (SELECT {_ratio('c00', 'c00 + c10')} AS p0, {_ratio('c00', 'c00 + c01')} AS r0,
             {_ratio('2 * c00', '2 * c00 + c10 + c01')} AS f0, c00 + c01 AS s0,
             {_ratio('c11', 'c11 + c01')} AS p1, {_ratio('c11', 'c11 + c10')} AS r1,
             {_ratio('2 * c11', '2 * c11 + c01 + c10')} AS f1, c11 + c10 AS s1,
             c00 + c01 + c10 + c11 AS n, {_ratio('c00 + c11', 'c00 + c01 + c10 + c11')} AS acc FROM c),
rows AS (
  SELECT '0' AS clase, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM m
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM m
  UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM m
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / CAST(n AS DOUBLE), (r0 * s0 + r1 * s1) / CAST(n AS DOUBLE),
                   (f0 * s0 + f1 * s1) / CAST(n AS DOUBLE), n FROM m)
SELECT clase, round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1_score, 3) AS f1_score,
       CAST(support AS BIGINT) AS support FROM rows
"""

_BAND = f"CASE WHEN score >= {d(0.6)} THEN 'Alto' WHEN score >= {d(0.35)} THEN 'Medio' ELSE 'Bajo' END"

ORACLES["probability_band"] = SCORED + f"""
SELECT {_BAND} AS banda, COUNT(*) AS n, min(score) AS min_score, max(score) AS max_score FROM scored GROUP BY 1
"""


def _relabel(col: str, m: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items())
    return f"CASE {col} {whens} ELSE {col} END"


_REC_RELABEL = {
    "naturaleza": {"1.STANDARD": "1.Lesion Lumbar"},
    "mecanismo": {"1.EUROPE": "1.Sobre-esfuerzo"},
    "parte_cuerpo": {"1.Brand#1": "1.Espalda", "1.Brand#2": "1.Miembros superiores"},
    "agente": {"1.1-URGENT": "1.Aeronave y sus componentes", "1.2-HIGH": "1.Cambios de presion brusca"},
    "tipo": {"PROMO": "Transito", "SMALL": "Violencia"},
}


def _has(col: str, *needles: str) -> str:
    return "(" + " OR ".join(f"coalesce(strpos({col}, '{n}') > 0, false)" for n in needles) + ")"


_RULES = [
    f"{_has('naturaleza', 'Lumbar')} OR {_has('mecanismo', 'esfuerzo')}",
    _has("parte_cuerpo", "Espalda", "Miembros"),
    "coalesce(antiguedad <= 2, false)",
    _has("agente", "Aeronave", "presion"),
    _has("tipo", "Transito"),
    _has("tipo", "Violencia"),
    "banda = 'Alto'",
]

ORACLES["recommendation_rules"] = with_cases(f"""
, rl AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, antiguedad,
         {', '.join(f'{_relabel(c, m)} AS {c}' for c, m in _REC_RELABEL.items())},
         {_BAND.replace('score', 's')} AS banda
  FROM (SELECT *, CAST((l_partkey * 37 + l_suppkey * 11) % 1000 AS DOUBLE) / {d(1000.0)} AS s FROM cases_model)),
fired AS (
  SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {r} THEN '{i}' END" for i, r in enumerate(_RULES, start=1))}) AS ids
  FROM rl)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, banda,
       CASE WHEN ids = '' THEN '0' ELSE ids END AS reglas,
       CAST(CASE WHEN ids = '' THEN 1 ELSE length(ids) - length(replace(ids, ',', '')) + 1 END AS INTEGER)
         AS n_recomendaciones
FROM fired
""")

_REC_RELABEL_V2 = {
    "naturaleza": {"1.STANDARD": "1.Lesión Lumbar"},
    "mecanismo": {"1.EUROPE": "1.Sobre-esfuerzo"},
    "parte_cuerpo": {"1.Brand#1": "1.Espalda", "1.Brand#3": "1.Manos"},
    "agente": {"1.1-URGENT": "1.Aeronave", "1.3-MEDIUM": "1.Turbulencia"},
    "tipo": {"PROMO": "Tránsito"},
}
_RULES_V2 = [
    (1, f"{_has('naturaleza', 'Lesión Lumbar')} OR {_has('mecanismo', 'Sobre-esfuerzo')}"),
    (2, _has("parte_cuerpo", "Espalda", "Manos")),
    (3, "coalesce(antiguedad <= 2, false)"),
    (4, _has("agente", "Turbulencia", "Aeronave")),
    (5, _has("tipo", "Tránsito")),
    (7, "banda = 'Alto'"),
]
_RAW_COLS = {"naturaleza": "r_nat", "mecanismo": "r_mec", "parte_cuerpo": "r_parte", "agente": "r_agente",
             "tipo": "r_tipo"}

ORACLES["recommendation_rules_v2"] = with_cases(f"""
, a AS (SELECT *, CASE WHEN {sql_strip('r_ant')} IN {SENIORITY_SENTINELS} THEN NULL
                       ELSE {sql_num(sql_strip('r_ant'))} END AS ant_v FROM cases_raw),
med AS (SELECT median(ant_v) AS med FROM a),
rl AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(ant_v, med, {d(5.0)}) AS antiguedad,
         {', '.join(f"{_relabel(f'coalesce({_RAW_COLS[c]}, ' + chr(39) + 'Sin informacion' + chr(39) + ')', m)} AS {c}"
                    for c, m in _REC_RELABEL_V2.items())},
         {_BAND.replace('score', 's')} AS banda
  FROM (SELECT *, CAST((l_partkey * 37 + l_suppkey * 11) % 1000 AS DOUBLE) / {d(1000.0)} AS s FROM a), med),
fired AS (
  SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {r} THEN '{i}' END" for i, r in _RULES_V2)}) AS ids FROM rl)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, banda,
       CASE WHEN ids = '' THEN '0' ELSE ids END AS reglas,
       CAST(CASE WHEN ids = '' THEN 1 ELSE length(ids) - length(replace(ids, ',', '')) + 1 END AS INTEGER)
         AS n_recomendaciones
FROM fired
""")

# --- sources / sinks -------------------------------------------------------------------

ORACLES["csv_round_trip"] = ORACLES["exposure_clean"]
ORACLES["export_filtered"] = ORACLES["case_filter"]
ORACLES["exposure_stream_clean"] = ORACLES["exposure_clean"]
ORACLES["rate_by_station_stream"] = ORACLES["rate_by_station"]

# Every oracle rounds like Spark (half-up on the decimal form).
from vigia.plans.sqlparts import half_up  # noqa: E402

ORACLES = {k: half_up(v) for k, v in ORACLES.items()}

ORACLES["load_checked"] = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(15,2)) AS p, CAST(o_orderdate AS DATE) AS d,
                  o_orderpriority AS q, o_orderstatus = 'P' AS broken FROM orders),
t AS (SELECT *, concat_ws(',', k, 'USD ' || p, d, q) AS csv_line,
             '{"o_orderkey":' || k || ',"o_totalprice":' || p || ',"o_orderdate":"' || d || '","o_orderpriority":"' || q || '"' AS json_line
      FROM o),
f AS (SELECT 'csv' AS format, *, broken AS bad, csv_line AS line FROM t
      UNION ALL SELECT 'json', *, broken, json_line FROM t
      UNION ALL SELECT 'parquet', *, false, '' FROM t)
SELECT format, COUNT(*) FILTER (NOT bad) AS n_good, CAST(SUM(k) FILTER (NOT bad) AS BIGINT) AS key_sum,
       CAST(SUM(CAST(p * 100 AS BIGINT)) FILTER (NOT bad) AS BIGINT) AS cents, MIN(d) FILTER (NOT bad) AS first_day,
       COUNT(DISTINCT q) FILTER (NOT bad) AS n_priorities, COUNT(*) FILTER (bad) AS n_bad,
       CAST(coalesce(SUM(length(line)) FILTER (bad), 0) AS BIGINT) AS bad_chars, COUNT(*) FILTER (bad) AS n_located
FROM f GROUP BY format
"""
ORACLES["station_list"] = with_exposure("SELECT DISTINCT Estacion FROM general WHERE Estacion IS NOT NULL")
ORACLES["station_detail"] = half_up(ORACLES["rate_global"].replace(
    "FROM general)", "FROM general WHERE Estacion = 'NATION_1')").replace(
    "AS Nivel_IF FROM r", "AS Nivel_IF, 'NATION_1' AS Estacion FROM r"))


# --- models as tables ------------------------------------------------------------

ORACLES["score_cases_from_table"] = with_cases("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRUE AS agrees, TRUE AS same_band FROM cases_model
""")

ORACLES["metrics_from_table"] = with_cases(_ALLOC + """
, n AS (SELECT SUM(train) AS n_train, SUM(c - train) AS n_test FROM alloc)
SELECT algo, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, TRUE AS auc_ok, TRUE AS accuracy_ok,
       TRUE AS precision_ok, TRUE AS recall_ok, TRUE AS f1_ok
FROM n, (VALUES ('lr'), ('rf'), ('gbt')) a(algo)
""")

ORACLES["model_node_checks"] = """
SELECT algo, CAST(n AS BIGINT) AS n_trees, CAST(n AS BIGINT) AS n_roots, TRUE AS leaves_ok, TRUE AS rows_ok, TRUE AS children_ok
FROM (VALUES ('rf', 200), ('gbt', 150)) a(algo, n)
"""

ORACLES["importances_from_table"] = """
SELECT algo, CAST(10 AS BIGINT) AS n_features, TRUE AS agrees, TRUE AS adds_up FROM (VALUES ('rf'), ('gbt')) a(algo)
"""

ORACLES["forecast_by_station"] = """
WITH acc AS (SELECT n_name AS Estacion, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS ym
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R'),
last AS (SELECT Estacion, MAX(ym) - (SELECT MIN(ym) FROM acc) + 1 AS m FROM acc GROUP BY Estacion)
SELECT Estacion, CAST(m + k AS INTEGER) AS Mes, TRUE AS from_table, TRUE AS in_range FROM last, range(1, 7) r(k)
"""
