"""Spark session and shared-storage helpers.

Everything here is plain session configuration. The defaults aim at a
cluster: adaptive execution on (runtime join re-planning, partition
coalescing and skew-join splitting), a broadcast threshold that Spark
checks against the *measured* size of a finished stage, and no UI.
"""

from __future__ import annotations

import os
import tempfile
import time

from pyspark.sql import SparkSession

_CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE re-plans a join as a broadcast only when the finished stage is
    # below this many bytes, so broadcasts of data-sized sides stay size-checked.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # large keyed state of streams belongs in RocksDB, not on the executor heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "cadenza",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the cluster defaults above.

    ``master`` is only set when given, so spark-submit's master wins on a
    cluster. ``shuffle_partitions`` should be sized so a shuffle partition
    stays around 128-256 MB at the target scale; AQE coalesces small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_CLUSTER_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_session(cores: int = 8, memory: str = "16g") -> SparkSession:
    """Single-JVM session for tests and local benchmarks."""
    return build_session(
        master=f"local[{cores}]",
        shuffle_partitions=cores,
        extra={"spark.driver.memory": memory},
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for materialised stages and checkpoints.

    Read from ``spark.checkpoint.dir`` (the cluster names it), else from the
    context's checkpoint folder. Only a local session without either - a
    test - gets a fresh scratch folder, registered as the context's
    checkpoint dir so later calls agree; a cluster without one is an error,
    as its executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
        d = d.rsplit("/", 1)[0] if d else _LOCAL_DIRS.get(sc.applicationId)
    if not d:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="cadenza-ckpt-")
        _LOCAL_DIRS[sc.applicationId] = d
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


_LOCAL_DIRS: dict[str, str] = {}


def scratch_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([shared_dir(spark), *[p.strip("/") for p in parts]])


def app_scratch(spark: SparkSession, *parts: str) -> str:
    """A path for intermediate tables of this application, which ``clear_scratch`` deletes."""
    return scratch_path(spark, _TABLES, spark.sparkContext.applicationId, *parts)


_TABLES = "tables"


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: for when its results are written and no lazy frame that
    reads one of them is needed any more."""
    delete_path(spark, app_scratch(spark))


def sweep_scratch(spark: SparkSession, older_than_s: float = 7 * 86400) -> list[str]:
    """Delete the intermediate tables of other applications that have not been written to for so long, such as those
    of drivers that died; returns their ids."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, _TABLES))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    gone = []
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        newest = max([f.getModificationTime(), *(x.getModificationTime() for x in fs.listStatus(f.getPath()))])
        if name != spark.sparkContext.applicationId and time.time() - newest / 1000 > older_than_s:
            fs.delete(f.getPath(), True)
            gone.append(name)
    return gone


def is_local(spark: SparkSession) -> bool:
    """One JVM: ``local`` or ``local[n]``; a ``local-cluster`` has executors of its own."""
    return spark.sparkContext.master.split("[")[0] == "local"


def env_int(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except ValueError:
        return default
