"""Storage that the driver and every executor can reach.

Everything here goes through Spark's own readers and writers, so the folder may live in any
store Spark knows.  Nothing is kept in executor-local folders: a lost executor never loses a table.
"""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one is made only where the setting is unset (tests, local runs)."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        set_before = spark.sparkContext.getCheckpointDir()
        if set_before:
            return set_before
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: computed once, lineage cut, executor loss survived.

    by: a column by whose values the rows are kept in folders of their own, so that some can be discarded before others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quern_path = path
    return back


def discard(df: DataFrame | None, part: str = "") -> None:
    """Deletes the files of a materialised table (or its part ``by=value``) that no later plan reads."""
    path = getattr(df, "_quern_path", None)
    if path:
        path = f"{path}/{part}" if part else path
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished plans now instead of at the driver's next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's sources to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="quern-ship-"), "quern_sources.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
