"""Session settings the library is written for, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Every key is a runtime SQL setting, so it can be applied to a session that
# somebody else started.  Adaptive execution splits skewed join partitions and
# turns joins into broadcasts from measured sizes, so no plan carries a hint.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# One temporary folder per local application that names none.
_LOCAL_FOLDERS: dict[str, str] = {}


def apply_recommended(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder stands in only when the setting is absent and the master
    is local, where driver and executors are one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="seasonloom-")
    return _LOCAL_FOLDERS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/seasonloom/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str, row_group: int | None = None) -> None:
    """Write ``df`` as Parquet and let Spark delete the write's shuffle files when it is done.

    Without that they stay until the driver happens to collect garbage, so a chain of staged
    steps would hold the shuffles of all of them on disk.  ``row_group`` is the size in bytes of
    a row group, which writers and vectorised readers hold at once (Parquet's default if None).
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        (df.write if row_group is None else df.write.option("parquet.block.size", row_group)).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def stage(df: DataFrame, label: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a frame feeds several jobs: later readers prune columns, and a
    lost executor re-reads files and does not replay the joins behind them.
    ``unstage`` removes the files once nothing reads the frame any more.
    """
    path = scratch_path(df.sparkSession, label)
    write_once(df, path, row_group)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(*frames: DataFrame) -> None:
    """Delete the files of staged frames; only those that ``stage`` itself returned."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(conf).delete(path, True)
