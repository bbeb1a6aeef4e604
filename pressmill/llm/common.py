"""Shared plumbing of the corpus operators: the cluster's shared folder, module shipping, reading tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can see: `spark.checkpoint.dir`; a folder of our own only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="pressmill-")
    return "file://" + _OWN_DIRS[app]


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing will read again, and let Spark drop the shuffles that made them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner act on the shuffles of finished writes: it does so when the driver finds their plans unreferenced."""
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that they need no shared source folder."""
    sc = spark.sparkContext
    if getattr(sc, "_pressmill_shipped", False):
        return
    import pressmill

    top = os.path.dirname(pressmill.__file__)
    target = os.path.join(tempfile.mkdtemp(prefix="pressmill-src-"), "pressmill_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("pressmill", os.path.relpath(full, top)))
    sc.addPyFile(target)
    sc._pressmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
