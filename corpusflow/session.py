"""Session defaults and the shared scratch location.

Scale notes: AQE re-plans joins from runtime sizes (a side turns into a
broadcast only when its *measured* size is below the threshold) and splits
skewed shuffle partitions; both are on by default here.  Shuffle partition
counts are left to AQE coalescing, starting from a value the caller picks.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Coalesce small shuffle partitions, but keep them small enough that CPU-heavy
    # higher-order-function stages still use every core on modest inputs.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches handed to Python (min-hash kernel, model client) are capped by
    # bytes as well as rows, so a batch of very long documents stays bounded.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "corpusflow", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and streaming checkpoints.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system the
    cluster names).  Only when it is unset (local tests) do we create our own
    folder and register it as the checkpoint directory.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        # A folder of this machine serves only a session that runs on this machine alone.
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="corpusflow-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def new_scratch_dir(spark: SparkSession, purpose: str) -> str:
    """The path of a fresh, unique sub-folder of the shared scratch root (Spark creates it when it writes)."""
    return f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


# The shuffle files of a query are deleted when it has ended, not when the driver happens to collect its garbage.
FREED_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def session_conf(spark: SparkSession, conf: dict):
    """Set ``conf`` for the queries that start inside; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusflow`` importable in every Python worker (once per application).

    UDFs, ``mapInPandas`` functions and model clients refer to this package;
    executors of a cluster do not have it installed, so the package is zipped
    on the driver and distributed with ``addPyFile`` (Spark serves the file).
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="corpusflow-pyfiles-"), "corpusflow.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dp, dirs, files in os.walk(pkg_dir):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dp, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
