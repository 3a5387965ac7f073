"""Session helpers that every part of the library shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Rows of an Arrow batch: texts are long, and a batch is held on both sides of the pipe.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Prepare a session: bound Arrow batches, unless the session sets its own bound,
    and make this package importable in the Python workers.

    Nothing is sent where the workers already see it (PYTHONPATH, or a working
    folder that holds the package); otherwise Spark distributes a zip of it.
    """
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, "2000")
    root = str(PACKAGE.parent)
    seen = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if root in seen or os.getcwd() == root or app in _shipped:
        return
    out = Path(tempfile.mkdtemp()) / "strandspark.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a session on one machine names none (tests, local runs) one is made; on a
    cluster that is an error, as executors don't share the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives
    lost executors, and is removed when the session's file system closes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def fewer(df: DataFrame, rows: int, per_file: int = 100_000) -> DataFrame:
    """``df``, of at most ``rows`` rows, in as many partitions as these call for, so that
    small tables are few files and large ones keep theirs. Partitions are read one after
    the other; no row moves, memory stays as it was."""
    return df.coalesce(max(1, -(-rows // per_file)))


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
