"""Compare every registered query with its DuckDB oracle, like the driver does.

    python tests/oracle_check.py [sf_dir] [name ...]

Prints one line per query: row counts, column names, exact value match and a
tolerant (1e-9 relative) value match.  Exit status 1 if any exact match fails.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


_TYPE_MAP = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
             "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]",
             "array<double>": "DOUBLE[]", "float": "FLOAT", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE",
             "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def _norm(v, tol):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if tol:
            return float(f"{v:.9g}")
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, tol) for x in v)
    if hasattr(v, "item"):
        return v.item()
    return v


def _rows(cols, rows, tol):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], tol) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(srows), oracle=None, secs=round(t1 - t0, 2))
    rel = con.sql(sql)
    ocols = rel.columns
    orows = rel.fetchall()
    res = dict(name=name, rows=len(srows), orows=len(orows), secs=round(t1 - t0, 2))
    res["cols"] = sorted(scols) == sorted(ocols)
    if not res["cols"]:
        res["col_diff"] = (sorted(set(scols) - set(ocols)), sorted(set(ocols) - set(scols)))
        return res
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    otypes = dict(zip(ocols, [str(t) for t in rel.types]))
    bad_types = {c: (stypes[c], otypes[c]) for c in scols if _TYPE_MAP.get(stypes[c], stypes[c]) != otypes[c]}
    if bad_types:
        res["types"] = bad_types
    res["exact"] = _rows(scols, srows, False) == _rows(ocols, orows, False)
    res["tol"] = _rows(scols, srows, True) == _rows(ocols, orows, True)
    if not res["tol"]:
        a, b = _rows(scols, srows, True), _rows(ocols, orows, True)
        sa, sb = set(a), set(b)
        res["spark_only"] = sorted(sa - sb, key=repr)[:3]
        res["oracle_only"] = sorted(sb - sa, key=repr)[:3]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from vigia.session import checkpoint_dir, get_session
    spark = get_session("local[8]", 8)
    checkpoint_dir(spark)
    con = duck(sf_dir)
    qs, oracles = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = dict(name=name, error=f"{type(e).__name__}: {str(e)[:400]}")
        if r.get("error") or r.get("types") or (r.get("oracle", 1) is not None and not r.get("exact")):
            bad += 1
        print(r, flush=True)
    print(f"non-exact: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
