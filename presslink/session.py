"""Spark session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "presslink") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the existing one."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; create a scratch one only when unset (tests)."""
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        try:
            existing = spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001
            existing = None
        if existing:
            return existing
        master = str(spark.sparkContext.master)
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share (master {master})")
        current = tempfile.mkdtemp(prefix="presslink-ckpt-")
        try:
            spark.conf.set(CHECKPOINT_CONF, current)
        except Exception:  # noqa: BLE001 - some deployments lock core settings at runtime
            pass
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        if spark.conf.get(CHECKPOINT_CONF, None) is None:
            return spark.sparkContext.getCheckpointDir()   # the setting could not be stored
    except Exception:  # noqa: BLE001 - no SparkContext handle (remote session)
        pass
    return current


def cores(spark: SparkSession) -> int:
    """Cluster parallelism (default parallelism), with a configuration fallback."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.default.parallelism", "8"))


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used where a costly or non-deterministic step (a user's annotation function)
    must run exactly once although several reports read its result (T13).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder, deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/presslink-io/{name}-{uuid.uuid4().hex}"

    def forget():
        with contextlib.suppress(Exception):   # the session may be gone already
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    atexit.register(forget)
    return path


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has cores
    (e.g. one small file with one row group) so per-row work is parallel; on
    large inputs the scan already has enough splits and this is a no-op."""
    n = cores(df.sparkSession)
    try:
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (remote session): leave as is
        return df
    return df.repartition(n) if parts < n else df


ARROW_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def arrow_batch(spark: SparkSession, rows: int):
    """Run the enclosed (eager) execution with at most ``rows`` rows per Arrow batch,
    for Python steps whose rows are large (whole files, long prompts)."""
    old = spark.conf.get(ARROW_BATCH_CONF, None)
    spark.conf.set(ARROW_BATCH_CONF, str(rows))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(ARROW_BATCH_CONF)
        else:
            spark.conf.set(ARROW_BATCH_CONF, old)
