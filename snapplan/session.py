"""Spark session and shared-folder helpers.

The engine never invents machine-local scratch folders on a cluster: every
materialisation (checkpoints, content stores, manifests written by the demo
queries) goes below the shared folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (unit tests,
laptops) do we fall back to a fresh temporary folder and register it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings that results depend on; everything else is left as the
# submitter set it.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "snapplan") -> SparkSession:
    """The session of a job.  Without arguments the submitter's master,
    partition count and memory hold; tests and the bench pass their own."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false")
                   .config("spark.driver.memory", os.environ.get("SNAPPLAN_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    if master:
        spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``snapplan`` importable in the Python workers (UDFs, the
    inventory data source) the way ``--py-files`` does: zip the package
    once per SparkContext and ``addPyFile`` it; Spark copies it to every
    executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    stage = tempfile.mkdtemp(prefix="snapplan-pyfiles-")   # staged for addPyFile, served by Spark
    target = os.path.join(stage, "snapplan.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, names in os.walk(pkg):
            if "__pycache__" in root:
                continue
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.join("snapplan", os.path.relpath(full, pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``.  Only a local-mode
    session without one (tests, a laptop) gets a temporary folder; on a
    cluster the setting is required - a machine-local folder would not be
    visible to the other executors."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, NFS) for this job")
        root = tempfile.mkdtemp(prefix="snapplan-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A fresh folder name below the shared checkpoint root."""
    base = "/".join([checkpoint_root(spark), "snapplan", *parts])
    return f"{base}/{uuid.uuid4().hex}" if unique else base


def has_entries(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there and holds something, asked of its own file
    system; any other failure raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and len(fs.listStatus(p)) > 0


def few_rows(batch: pa.RecordBatch, most: int = 64) -> Iterator[dict]:
    """The rows of an Arrow batch, of which a few at a time are Python objects: payloads may be large."""
    for lo in range(0, batch.num_rows, most):
        yield from batch.slice(lo, most).to_pylist()


def local_fs_path(path: str) -> str:
    """Strip a ``file:`` scheme for Python-side file access inside tasks."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


def cut_lineage(df: DataFrame, how: str = "table") -> DataFrame:
    """Cut lineage in the shared folder (never a local checkpoint).

    ``table`` (default): write Parquet below ``spark.checkpoint.dir`` and
    read it back - columnar, so later passes read only the columns they
    need, and the scan carries exact statistics for AQE.  ``checkpoint``:
    Spark's reliable RDD checkpoint into the same folder."""
    spark = df.sparkSession
    if how == "checkpoint":
        checkpoint_root(spark)
        return df.checkpoint(eager=True)
    path = shared_path(spark, "cut")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
