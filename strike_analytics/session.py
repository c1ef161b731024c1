"""Session helpers: building a local session for tests/bench, and resolving the
shared folder used for checkpoints and materialised tables.

On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
filesystem such as HDFS/S3/ABFS). A machine-local temp folder is only created
when the setting is absent, which is the case in tests and local benches.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_LOCAL_FALLBACK: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "strike_analytics",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured the way the tests and bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture on every Column call roughly doubles plan-building
        # time for the wide decode projections; error messages lose the
        # Python line only.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Deep pages of a listing sort by ranges; only shallow ones gather their rows.
        .config("spark.sql.execution.topKSortFallbackThreshold", "100000")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path under the cluster's shared checkpoint folder.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset
    and the master is ``local[...]`` (tests) a local folder is made once per
    application; on a cluster an unset setting is an error.
    """
    app = spark.sparkContext.applicationId
    base = (spark.conf.get(CHECKPOINT_CONF, None) or _LOCAL_FALLBACK.get(app)
            or spark.sparkContext.getCheckpointDir())
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            # Executors cannot see a driver-local folder; never guess on a cluster.
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder on shared storage")
        base = _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="strike-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base.rstrip("/") + "/rdd")
    return "/".join([base.rstrip("/"), *parts]) if parts else base


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared folder (never reused)."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")
