"""Session construction and shared-storage helpers.

Everything the library writes (ingested parquet, layout variants, stage
tables, stream checkpoints) goes under the cluster's shared
``spark.checkpoint.dir``.  On a cluster that setting must already be
present; only a local session (tests, bench) gets a fresh scratch folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session should carry.  AQE re-plans joins and coalesces
# shuffle partitions at runtime; UTC keeps timestamp_ntz/date arithmetic
# identical to the DuckDB oracle.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "panelkit", extra: dict | None = None) -> SparkSession:
    """Local/test session.  Cluster jobs get their session from the platform
    and only need :func:`configure`."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("PANELKIT_DRIVER_MEMORY", "8g")
    if master.startswith("local"):
        # Tests keep catalog metadata out of the working directory.  The
        # checkpoint folder is not set here: shared_root() reads it from the
        # session (spark-defaults) and only invents one when it is unset.
        scratch = tempfile.mkdtemp(prefix="panelkit-")
        conf["spark.sql.warehouse.dir"] = os.path.join(scratch, "warehouse")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on to an existing
    session (safe to call repeatedly).  Needs no folder: only what writes
    asks :func:`shared_root` for one."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(k, BASE_CONF[k])
    return spark


def _is_local(spark: SparkSession) -> bool:
    """One process: ``local-cluster`` has executors of its own."""
    return re.match(r"local($|\[)", spark.sparkContext.master) is not None


_ROOTS: dict[str, str] = {}      # scratch folders of local sessions, by application


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only a local session without the setting gets a
    scratch folder of its own (tests).  A cluster session without it is an
    error: a machine-local folder would not survive executor loss.  The
    scheme is kept, so ``file:`` means the same to every writer and reader
    (on a cluster such a folder must be a mount that all machines share).
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None) or _ROOTS.get(sc.applicationId)
    if not path:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = os.path.join(tempfile.mkdtemp(prefix="panelkit-"), "checkpoint")
        _ROOTS[sc.applicationId] = path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    # setCheckpointDir appends a per-application uuid folder; keep our own
    # files next to it so every run of every app stays separate.
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder under the shared root for one job."""
    return f"{shared_root(spark)}/panelkit/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
