"""What operators need of the session: a folder that all machines share, lineage cuts, and this package on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set and the session is local (tests), one of our own. A cluster that names none is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named and not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="linguaspan-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that lost executors don't cost its lineage again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own, wherever the session's file system has it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session, so that kernels import wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(suffix=".zip", prefix="linguaspan-")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("linguaspan") / p.relative_to(root))
    sc.addPyFile(name)  # Spark's own file server hands it to every executor, also to those that start later
    _shipped.add(sc.applicationId)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, found by exact name and position: other columns may bear any name, also one that differs in case."""
    places = [df.columns.index(n) for n in names]
    flat = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_in{i}").alias(n) for i, n in zip(places, names)])
