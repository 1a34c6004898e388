"""Session and shared-storage helpers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "trialsift", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRIALSIFT_DRIVER_MEMORY", "12g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack capture per column
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a session without the setting (a local test) falls back to a new
    temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="trialsift-checkpoint-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trialsift/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/trialsift/package-{app}/trialsift-package.zip")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(raw.getvalue())
    finally:
        out.close()
    spark.sparkContext.addPyFile(target.toString())
    _SHIPPED.add(app)


_SHIPPED: set[str] = set()
_STAGES: dict[tuple[str, ...], DataFrame] = {}


def stage_table(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Stage table of the run: built once, kept in shared storage, read by every later step.

    Segments feed retrieval, contexts and quotes; like the result tables of a
    batch they are written once per session instead of being re-derived.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = materialize(build())
    return _STAGES[key]
