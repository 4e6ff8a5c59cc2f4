"""Session helpers: shipping the package, shared folders, partition counts."""

from __future__ import annotations

import atexit
import gc
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application, through the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_corvault_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if not f.endswith(".pyc"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("corvault", os.path.relpath(path, root)))
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/corvault-{uuid.uuid4().hex}.zip")
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(at, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(fs.makeQualified(at).toString())
    sc._corvault_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables and checkpoints that all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and the master is local, as
    in tests, a folder of this machine is made and set; it is removed when Python ends.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="corvault-checkpoint-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(made)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a table to a new directory of the shared folder and read from there.

    It survives the loss of executors, and unlike a checkpointed DataFrame it doesn't hold on to
    the shuffle files that it was made from (see :func:`release`).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(schema).parquet(path)


#: Tables that :func:`checkpoint` wrote, by application.
_made: dict[str, list[str]] = {}


def drop_tables(spark: SparkSession) -> int:
    """Removes the tables that :func:`checkpoint` has written in this application; for when no result that reads them is needed any more."""
    sc = spark.sparkContext
    gone = _made.pop(sc.applicationId, [])
    for path in gone:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are written; else they stay until the driver's JVM happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
