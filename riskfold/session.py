"""Session construction and checkpoint directory handling."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session time (timestamps compare equal to
# other engines), AQE for runtime re-planning of joins and skewed partitions,
# no web UI.
_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Long sessions run hundreds of queries: keep little execution history on the driver.
    "spark.sql.ui.retainedExecutions": "50",
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "20000",
}


def get_session(master: str | None = None, app: str = "riskfold",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point reliable checkpoints at ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared folder and is only read here.
    A local-mode session without the setting (tests, bench) gets a fresh
    scratch folder; a cluster session without it is an error, since a
    machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="riskfold-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, so Python workers import it by name even
    where it is neither installed nor on their path.  Once per application."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="riskfold-ship-")
    path = os.path.join(folder, "riskfold-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("riskfold", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED["app"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder, for a written
    intermediate table; remembered for :func:`release_scratch`."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def release_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far.  Call it when no result that
    may still read them is needed; returns the number of folders."""
    n, jvm, conf = len(_SCRATCH), spark._jvm, spark._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def cut_lineage(df):
    """Reliable checkpoint (written to the shared checkpoint folder)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df, name: str):
    """Lineage cut like :func:`cut_lineage`, by Parquet below the checkpoint folder: for rows that Python made, which
    a checkpoint keeps as boxed values that are slow to read, and for tables that are read again in part."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
