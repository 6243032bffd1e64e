"""Reading the input tables and keeping intermediate results in storage that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SHARED: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: their Python workers import it by name."""
    context = spark.sparkContext
    if getattr(context, "_loomlog_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="loomlog-code-"))
    _LOCAL_SHARED.append(str(folder))
    with zipfile.ZipFile(folder / "loomlog.zip", "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, Path("loomlog") / path.relative_to(root))
    context.addPyFile(str(folder / "loomlog.zip"))
    context._loomlog_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; column pruning and filters reach the Parquet scan."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on one machine (tests), a temporary folder set for the session. On a cluster it
    must be set: executors don't share a folder of the driver's machine."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not context.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="loomlog-")
        _LOCAL_SHARED.append(at[len("file://") :])
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: The tables written by stored() in this application, with their file systems.
_STORED: list[tuple] = []


def forget() -> None:
    """Deletes all tables that stored() has written, when no DataFrame built on them is read any more; done at the end of an application, too."""
    while _STORED:
        system, path = _STORED.pop()
        system.delete(path, True)


@atexit.register
def _forget_at_exit() -> None:
    try:
        forget()
    except Exception:  # the JVM is gone
        _STORED.clear()


@atexit.register
def _drop_local() -> None:
    for path in _LOCAL_SHARED:
        shutil.rmtree(path, ignore_errors=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/loomlog/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    _STORED.append((at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), at))
    return df.sparkSession.read.schema(df.schema).parquet(path)
