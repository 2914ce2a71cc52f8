"""File sources and sinks: format dispatch, explicit schemas, partitioned
export and the inline default series.

Paths for intermediate output are derived from the session's shared
checkpoint folder (``spark.checkpoint.dir``), never from a machine-local
temporary directory, so every executor sees them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from vigia.session import checkpoint_dir

# The default monthly accident series (months 1..12).
DEFAULT_SERIES = [5, 7, 6, 8, 9, 12, 11, 10, 13, 15, 14, 16]

_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def format_of(path: str) -> str:
    """Reader format from the file suffix (a folder of part files is read by
    its suffix too).  Workbooks have no Spark reader: land them as cell grids
    (see :mod:`vigia.sources.grid`) or export them to CSV first."""
    p = path.rstrip("/").lower()
    for suffix, fmt in _FORMATS.items():
        if p.endswith(suffix):
            return fmt
    if p.endswith((".xlsx", ".xls")):
        raise ValueError("workbook files have no Spark reader; land the sheet as a cell grid or CSV")
    return "parquet"


def load_table(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None,
               header: bool = True) -> DataFrame:
    """Read a table.  With ``schema`` nothing is inferred (no extra pass over
    the files); without it CSV types are inferred, for ad-hoc use."""
    fmt = fmt or format_of(path)
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", str(header).lower())
        if schema is None:
            r = r.option("inferSchema", "true")
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def load_checked(spark: SparkSession, path: str, schema: StructType | str, fmt: str | None = None,
                 header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Read a table of text records and part the ones that do not parse:
    ``(good, bad)``.  ``good`` has the columns of ``schema``; ``bad`` has one
    row per unparsable record with ``file`` and ``line`` (its text).

    A record is bad if a value is not of its column's type, or a line has too
    few or too many fields, or is no JSON object.  Blank lines are no records.
    The text is parsed once: both parts are folders of one written table, so
    neither read parses again nor sees the other's rows.  Parquet files carry
    typed values; their ``bad`` part is empty and nothing is written."""
    fmt = fmt or format_of(path)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    none_bad = StructType([StructField("file", StringType()), StructField("line", StringType())])
    if fmt == "parquet":
        return load_table(spark, path, fmt, schema), spark.createDataFrame([], none_bad)
    marks = [StructField("_line", StringType()), StructField("_file", StringType()), StructField("_ok", IntegerType())]
    r = spark.read.format(fmt).schema(StructType([*schema.fields, marks[0]])) \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
    if fmt == "csv":
        r = r.option("header", str(header).lower())
    rows = r.load(path).withColumns({"_file": F.col("_metadata.file_path"), "_ok": F.col("_line").isNull().cast("int")})
    out = scratch_path(spark, "checked")
    rows.write.partitionBy("_ok").parquet(out)
    both = spark.read.schema(StructType([*schema.fields, *marks])).parquet(out)
    good = both.filter(F.col("_ok") == 1).select(*[F.col(f"`{c}`") for c in schema.names])
    return good, both.filter(F.col("_ok") == 0).select(F.col("_file").alias("file"), F.col("_line").alias("line"))


def export(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
           mode: str = "overwrite", header: bool = True) -> str:
    """Write ``df`` (one file set per task, optionally partitioned into
    folders by ``partition_by``)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", str(header).lower())
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/vigia-io/{name}-{uuid.uuid4().hex}"


def default_series(spark: SparkSession) -> DataFrame:
    """The inline monthly series used when no file is given."""
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(DEFAULT_SERIES)],
                                 "Mes int, Accidentes double")


def series_or_default(spark: SparkSession, path: str | None) -> DataFrame:
    """The monthly series from ``path`` (csv/parquet/json by suffix), or the
    inline default; the two required columns are checked."""
    df = default_series(spark) if not path else load_table(spark, path)
    missing = [c for c in ("Mes", "Accidentes") if c not in df.columns]
    if missing:
        raise ValueError(f"the series needs columns Mes and Accidentes; missing {missing}")
    return df
