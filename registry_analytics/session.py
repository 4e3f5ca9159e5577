"""Session helpers.

The library never creates its own session inside an operator: every function takes the
caller's ``SparkSession`` or DataFrame. These helpers exist for tests, the bench and
command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are written for. ANSI stays on (Spark 4 default): every
# lenient conversion in the library uses try_* functions instead of relying on NULL
# from a failed cast.
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "registry-analytics", extra: dict | None = None) -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no driver-side context
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only when the session has none.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is; if it
    is missing there, this fails rather than fall back to a machine-local folder. Only a
    local-mode session without the setting (a bare test session) gets a fresh scratch
    folder.
    """
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc is None:
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return configured
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="ra-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def session_key(spark: SparkSession) -> str:
    """Identifier of the running application (classic or Connect session)."""
    sc = _context(spark)
    if sc is not None:
        return sc.applicationId
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def default_parallelism(spark: SparkSession, fallback: int = 10) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    value = spark.conf.get("spark.default.parallelism", None)
    return int(value) if value else fallback


def release_unused(spark: SparkSession) -> None:
    """Ask the driver for a garbage collection, after which Spark removes the cached blocks and
    shuffle files of results that nothing refers to any more."""
    sc = _context(spark)
    if sc is not None:
        sc._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's file systems; without a context (Connect) it stays."""
    sc = _context(spark)
    if sc is not None:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def testdata_dir(sf: str = "0.01") -> str:
    return os.environ.get("RA_TESTDATA", "/root/testdata") + f"/sf{sf}"
