"""Session helpers: shared folders, table access, and shipping this package to Python workers."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, set[str]] = {}

#: Bounds of the Arrow batches that pass between the JVM and Python workers: texts can be long, so few rows go at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may live in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores: a small file whose rows are costly would be one task."""
    return rows.repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests) gets a folder of its own; on a cluster it is an error, as every
    executor would write to its own disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "corpusgraph")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, label: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors. ``by`` names columns that give folders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for t in tables:
        spark, path = t.sparkSession, t.__dict__.pop("_written_to", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (and once per change of its code), and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    digest, files = hashlib.sha256(), sorted(_PACKAGE.rglob("*.py"))
    for f in files:
        digest.update(f.relative_to(_PACKAGE.parent).as_posix().encode() + f.read_bytes())
    app, version = spark.sparkContext.applicationId, digest.hexdigest()[:16]
    sent = _shipped.setdefault(app, set())
    if version in sent:
        return
    target = os.path.join(tempfile.mkdtemp(), f"corpusgraph-{version}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, f.relative_to(_PACKAGE.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    sent.add(version)
