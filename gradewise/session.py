"""Session helpers: building a local session for tests/bench, locating the
shared checkpoint folder, and size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest lookup (rows) we hint as broadcast.  Lookups are aggregated tables
# (class x bucket, feature x level x fold); above this bound they are joined
# with a shuffle join and AQE may still demote them to broadcast at runtime.
BROADCAST_MAX_ROWS = 2_000_000


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "gradewise") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRADEWISE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when it is unset and the master is local a private folder is
    created; elsewhere executors could not read it, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="gradewise-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for written tables in shared storage: beside the checkpoint
    folder's per-application parts, so that a later application finds them."""
    own = ensure_checkpoint_dir(spark).rstrip("/")
    base = spark.conf.get("spark.checkpoint.dir", None) or own.rsplit("/", 1)[0]
    return f"{base.rstrip('/')}/tables/{name}"


def bounded_broadcast(lookup: DataFrame, bound_rows: int, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint ``lookup`` as broadcast only when its structural row bound is
    small; otherwise leave the choice to the planner / AQE."""
    return F.broadcast(lookup) if bound_rows <= max_rows else lookup


def counted_broadcast(lookup: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast a fitted lookup after checking its real size.

    The lookup is persisted first so the check does not recompute it at join
    time (fitted lookups are small aggregated tables)."""
    lookup = lookup.persist()
    n = lookup.count()
    return F.broadcast(lookup) if n <= max_rows else lookup
