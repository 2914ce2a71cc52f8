"""Occupational-safety rate formulas as native Spark column expressions.

All functions take and return ``Column`` objects, so they stay inside
whole-stage codegen; no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the domain definitions:
#   IF  = accidents * 240000 / man-hours, rounded to 4 decimals
#   IS  = lost days * 240000 / man-hours, rounded to 4 decimals
#   severity = lost days / accidents, rounded to 2 decimals
#   ILI = IF * IS / 1000, rounded to 4 decimals
#   IF target 2.54 (BAJO up to it, MEDIO up to 1.5 times it, ALTO above)
#   IS reference 3.00
#   monthly alert: mean accidents above 10 is high risk
HOURS_BASE = 240000.0
META_IF = 2.54
META_IS = 3.00
MEDIO_FACTOR = 1.5
ALERT_MEAN = 10.0
LEVEL_LOW, LEVEL_MID, LEVEL_HIGH = "BAJO", "MEDIO", "ALTO"
ALERT_HIGH = "Riesgo alto de accidentalidad"
ALERT_OK = "Riesgo controlado"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _positive(c: Column) -> Column:
    # null, NaN and non-positive all fail (Spark orders NaN above every number,
    # so ``NaN > 0`` alone would be true).
    return c.isNotNull() & ~F.isnan(c) & (c > 0)


def calc_if(n_at, hht) -> Column:
    """Frequency index; 0.0 when hours are null, NaN or not positive."""
    n, h = _col(n_at), _col(hht)
    return F.when(_positive(h), F.round(n * F.lit(HOURS_BASE) / h, 4)).otherwise(F.lit(0.0))


def calc_is(n_days, hht) -> Column:
    """Severity index; same guard as :func:`calc_if`."""
    d, h = _col(n_days), _col(hht)
    return F.when(_positive(h), F.round(d * F.lit(HOURS_BASE) / h, 4)).otherwise(F.lit(0.0))


def calc_severity(n_at, n_days) -> Column:
    """Mean lost days per accident; 0.0 when accidents are null/NaN/<= 0."""
    n, d = _col(n_at), _col(n_days)
    return F.when(_positive(n), F.round(d / n, 2)).otherwise(F.lit(0.0))


def calc_ili(if_col, is_col) -> Column:
    """Disabling-injury index from the already rounded IF and IS."""
    return F.round(_col(if_col) * _col(is_col) / F.lit(1000.0), 4)


def if_level(v) -> Column:
    """BAJO / MEDIO / ALTO against the IF target; null and NaN count as ALTO."""
    c = _col(v)
    return (F.when(c.isNull() | F.isnan(c), F.lit(LEVEL_HIGH))
            .when(c <= F.lit(META_IF), F.lit(LEVEL_LOW))
            .when(c <= F.lit(META_IF) * F.lit(MEDIO_FACTOR), F.lit(LEVEL_MID))
            .otherwise(F.lit(LEVEL_HIGH)))


def what_if(hht, days) -> dict[str, Column]:
    """IF of a single accident and IS of ``days`` lost days for ``hht`` hours,
    and the IF gap to the target.  Callers keep only rows with ``hht > 0``."""
    if_case = calc_if(F.lit(1.0), hht)
    return {
        "IF_caso": if_case,
        "IS_caso": calc_is(days, hht),
        "delta_meta": F.round(if_case - F.lit(META_IF), 4),
    }


def accident_alert(mean_col) -> Column:
    """Monthly-series alert: mean above 10 accidents is high risk."""
    c = _col(mean_col)
    return F.when(c > F.lit(ALERT_MEAN), F.lit(ALERT_HIGH)).otherwise(F.lit(ALERT_OK))
