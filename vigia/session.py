"""Session construction and cluster-safe helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults that matter at scale: AQE re-plans joins and coalesces/splits
# shuffle partitions at runtime, skew-join splitting is on, and the UI
# server stays off.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "vigia", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests and
    the bench pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared (HDFS/object-store) folder in that setting and it
    is used as is.  Only when it is unset and the master is ``local`` — tests —
    a scratch folder is created and registered; on a cluster a folder of the
    driver's machine would lose data late, so an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master}")
        path = tempfile.mkdtemp(prefix="vigia-ckpt-", dir=os.environ.get("VIGIA_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in
    the shared checkpoint folder (survives executor loss, unlike a local
    checkpoint).  Meant for derived tables that are read several times."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Compute ``df`` once into Parquet at ``path`` (a fresh folder under the shared checkpoint folder if not given) and
    read it back: lineage cut like :func:`materialize`, but each reader takes only its columns.  For wide tables of
    which most steps read a few columns."""
    path = path or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/vigia-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key_cols: list[str], min_partitions: int | None = None) -> DataFrame:
    """Hash-partition a scan on ``key_cols`` when it yields fewer partitions
    than the cluster has cores (a file that cannot be split, e.g. one parquet
    row group), so the row-wise work after it runs on every core.

    Hash partitioning is deterministic on task retry (no sort needed, unlike
    round-robin), and a later group-by or join on the same key can reuse it.
    A large input already scans into more partitions than cores and is
    returned unchanged: no shuffle is added at scale."""
    spark = df.sparkSession
    # the target equals the shuffle width of the group-by/join on the same key
    # that follows, so that exchange is reused instead of added
    n = min_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if df.rdd.getNumPartitions() >= min(n, spark.sparkContext.defaultParallelism):
        return df
    return df.repartition(n, *[F.col(c) for c in key_cols])


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame (an aggregate without grouping keys) as a single
    scalar subquery returning a struct of its columns.  Spark computes it once
    before the outer query and substitutes the value: no join with the outer
    rows, and nothing but that one row reaches the driver.  Read fields with
    ``one_row(df)["name"]``."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("v")).scalar()


def attach_row(df: DataFrame, row_df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Add the columns of the one-row frame ``row_df`` to every row of ``df``
    through one scalar subquery (see :func:`one_row`) instead of a cross join."""
    tmp = "_one_row"
    cols = list(cols or row_df.columns)
    out = df.withColumn(tmp, one_row(row_df))
    return out.withColumns({c: F.col(tmp).getField(c) for c in cols}).drop(tmp)
