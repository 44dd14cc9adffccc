"""Spark session helpers.

Library code never creates its own session when one is handed in; it only
sets the few runtime options the engine relies on (UTC session time zone so
epoch-millisecond arithmetic is unambiguous) and makes sure a checkpoint
directory exists.  On a cluster ``spark.checkpoint.dir`` names a shared
folder and is respected as is; only when it is unset (tests, local runs) a
fresh scratch folder is created.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, app: str = "cohortflow",
                shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot user's partition even when the join feeds a per-user
        # aggregation (the extra shuffle then moves partially aggregated rows)
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """What every job of the engine assumes of a session that it is handed: a
    checkpoint folder, and UTC for epoch arithmetic."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (also without a SparkContext)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - e.g. a remote session without a context
        return spark.conf.get("spark.app.id", "app") or "app"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.  Where none is set, a scratch folder is
    made for a local master; on a cluster, or for a remote session whose
    master is not known here, that is an error, since executors do not share a
    machine's own folders."""
    path = spark.conf.get(_CHECKPOINT_KEY, None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        sc = None
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path and (sc is None or not (sc.master or "").startswith("local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="cohortflow-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, path)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return (sc.getCheckpointDir() if sc is not None else None) or path


def configure_for_scale(spark: SparkSession, input_bytes: int, total_cores: int,
                        target_partition_bytes: int = 256 << 20) -> int:
    """Shuffle sizing for a run over ``input_bytes`` of event data.

    Starts with enough shuffle partitions that each holds about
    ``target_partition_bytes`` of input (never fewer than 3 waves over the
    cluster's cores); AQE then coalesces small partitions and splits skewed
    ones at runtime.  Returns the partition count it set."""
    n = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(128 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 20))
    return n
