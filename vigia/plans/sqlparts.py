"""SQL building blocks for the DuckDB oracles.

The oracles are written independently of the Spark code: plain joins and
GROUP BYs over the base tables (``lineitem orders customer nation region
part``), no pre-aggregation tricks.  Literals are typed explicitly because
DuckDB reads bare ``2.0`` as DECIMAL.
"""

from __future__ import annotations


def d(x) -> str:
    """A DOUBLE literal."""
    return f"CAST({x!r} AS DOUBLE)"


def sql_if(n: str, h: str) -> str:
    return (f"CASE WHEN {h} IS NOT NULL AND NOT isnan({h}) AND {h} > 0 "
            f"THEN round({n} * {d(240000.0)} / {h}, 4) ELSE {d(0.0)} END")


sql_is = sql_if


def sql_sev(n: str, days: str) -> str:
    return (f"CASE WHEN {n} IS NOT NULL AND NOT isnan({n}) AND {n} > 0 "
            f"THEN round({days} / {n}, 2) ELSE {d(0.0)} END")


def sql_level(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR isnan({v}) THEN 'ALTO' WHEN {v} <= {d(2.54)} THEN 'BAJO' "
            f"WHEN {v} <= {d(2.54)} * {d(1.5)} THEN 'MEDIO' ELSE 'ALTO' END")


LOST_DAYS = "greatest(CAST(trunc(l_quantity) AS INTEGER) - 21, 0)"

# Exposure proxy, one row per (station, unit, population, month, block),
# accident-free rows included.  Measures as in the board sheet.
EXPOSURE_RAW = f"""
exposure_base AS (
  SELECT n_name AS Estacion, r_name AS Unidad_Negocio, c_mktsegment AS Poblacion,
         CAST(month(o_orderdate) AS INTEGER) AS mes_i,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS agil,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS acc,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS ind,
         {LOST_DAYS} AS days,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
exposure_wide AS (
  SELECT Estacion, Unidad_Negocio, Poblacion, mes_i,
         SUM(acc) AS g_n, SUM(ind) AS g_ni, SUM(acc * days) AS g_d, SUM(ind * days) AS g_di, SUM(cents) AS g_c,
         SUM(agil * acc) AS a_n, SUM(agil * ind) AS a_ni, SUM(agil * acc * days) AS a_d,
         SUM(agil * ind * days) AS a_di, SUM(agil * cents) AS a_c
  FROM exposure_base GROUP BY Estacion, Unidad_Negocio, Poblacion, mes_i
),
exposure_m AS (
  SELECT Estacion, Unidad_Negocio, Poblacion, mes_i, 'GENERAL' AS fuente,
         g_n AS n, g_ni AS ni, g_d AS dd, g_di AS di, g_c AS c FROM exposure_wide
  UNION ALL
  SELECT Estacion, Unidad_Negocio, Poblacion, mes_i, 'AGIL' AS fuente,
         a_n, a_ni, a_d, a_di, a_c FROM exposure_wide
),
exposure_raw AS (
  SELECT CAST(mes_i AS VARCHAR) AS Mes,
         ['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'][mes_i] AS Meses,
         Unidad_Negocio, Estacion, Poblacion,
         CAST(n AS DOUBLE) AS N_AT, CAST(ni AS DOUBLE) AS N_AT_IND,
         CAST(dd AS DOUBLE) AS N_Dias_Total, CAST(di AS DOUBLE) AS N_Dias_Ind,
         CAST(c * 6 AS DOUBLE) / {d(1000.0)} AS HHT, fuente
  FROM exposure_m
),
exposure_rated AS (
  SELECT Mes, Meses, Unidad_Negocio, Estacion, Poblacion, N_AT, N_AT_IND, N_Dias_Total, N_Dias_Ind, HHT,
         {sql_if('N_AT', 'HHT')} AS "IF", {sql_if('N_AT_IND', 'HHT')} AS IF_IND,
         {sql_is('N_Dias_Total', 'HHT')} AS "IS", fuente
  FROM exposure_raw
),
exposure AS (
  SELECT * FROM exposure_rated WHERE Mes IS NOT NULL AND Mes <> 'Mes' AND N_AT > 0
),
general AS (SELECT * FROM exposure WHERE fuente = 'GENERAL')
"""


def with_exposure(body: str) -> str:
    return "WITH " + EXPOSURE_RAW.strip() + "\n" + body


NUMBER_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


_WS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
_WS_SQL = " || ".join(f"chr({ord(ch)})" for ch in _WS)


def sql_strip(x: str) -> str:
    """Python's str.strip(): trim every whitespace code point at both ends."""
    return f"trim({x}, {_WS_SQL})"


def sql_num(x: str) -> str:
    """Strict text -> DOUBLE, NULL when not a plain number."""
    return f"CASE WHEN regexp_matches({x}, '{NUMBER_RE}') THEN TRY_CAST({sql_strip(x)} AS DOUBLE) END"


def sql_num_or(x: str, default: float) -> str:
    return f"coalesce({sql_num(x)}, {d(float(default))})"


def sql_cat(x: str) -> str:
    return sql_strip(f"coalesce({x}, 'Sin informacion')")


def sql_prefix_drop(x: str) -> str:
    return sql_strip(rf"regexp_replace({sql_strip(x)}, '^\d+\.', '')")


SENIORITY_SENTINELS = "('Sin informacion', 'Sin información', 'nan', 'None', '')"


def sql_seniority(x: str) -> str:
    s = sql_strip(f"CAST({x} AS VARCHAR)")
    return f"coalesce(CASE WHEN {s} IN {SENIORITY_SENTINELS} THEN NULL ELSE {sql_num(s)} END, {d(5.0)})"


# Case register proxy: raw text columns (short aliases), then the model table.
CASES = f"""
cases_raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         CASE o_orderstatus WHEN 'F' THEN 'Leves' WHEN 'O' THEN 'Severos' WHEN 'P' THEN 'Graves' END AS r_clas,
         p_type AS r_tipo, n_name AS r_est, l_linestatus AS r_gen, c_mktsegment AS r_cargo,
         CASE WHEN p_size % 7 = 0 THEN 'Sin información' ELSE CAST(p_size AS VARCHAR) END AS r_ant,
         '1.' || p_type AS r_nat, '1.' || p_brand AS r_parte, '1.' || o_orderpriority AS r_agente,
         '1.' || r_name AS r_mec,
         CAST({LOST_DAYS} AS VARCHAR) AS r_dias
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
cases AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         {sql_cat('r_clas')} AS clasificacion, {sql_cat('r_tipo')} AS tipo, {sql_cat('r_est')} AS estacion,
         {sql_cat('r_gen')} AS genero, {sql_cat('r_cargo')} AS cargo, {sql_seniority('r_ant')} AS antiguedad,
         {sql_cat('r_nat')} AS naturaleza, {sql_cat('r_parte')} AS parte_cuerpo, {sql_cat('r_agente')} AS agente,
         {sql_cat('r_mec')} AS mecanismo, {sql_num_or('r_dias', 0.0)} AS dias_incapacidad
  FROM cases_raw
),
cases_model AS (
  SELECT *, CAST(dias_incapacidad > 0 AS INTEGER) AS con_incapacidad,
         CAST(dias_incapacidad >= 5 AS INTEGER) AS incapacidad_alta
  FROM cases
)
"""

MODEL_COLS = ["clasificacion", "tipo", "estacion", "genero", "cargo", "antiguedad", "naturaleza", "parte_cuerpo",
              "agente", "mecanismo", "dias_incapacidad", "con_incapacidad", "incapacidad_alta"]


def with_cases(body: str) -> str:
    return "WITH " + CASES.strip() + "\n" + body


def half_up(sql: str) -> str:
    """Make every two-argument ``round(x, n)`` of an oracle round like Spark:
    half-up on the decimal form of the double (Spark: 2.0195 -> 2.020,
    DuckDB's plain ``round`` works on the binary value: 2.019).  The value is
    first fixed to 12 decimals as DECIMAL, rounded there, and cast back."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        if comma < 0:                           # one-argument round: keep
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        arg = half_up(sql[j + 6:comma])
        digits = sql[comma + 1:k].strip()
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST({arg} AS DECIMAL(38,12)), {digits}) AS DOUBLE)")
        i = k + 1
