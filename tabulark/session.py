"""Session settings the engine expects; a cluster's own settings win over these."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def build_session(app: str = "tabulark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on. `master` and `conf` override the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return build_session(
        master=f"local[{n}]",
        **{
            "spark.driver.memory": memory,
            "spark.sql.shuffle.partitions": str(n),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_BYTES at most in this session: a row count, the default, leaves their size to the
    texts. A lower setting of the session stays."""
    now = spark.conf.get(BATCH_SETTING, None) or ""
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and the master is local,
    as in tests, a temporary folder takes its place for the rest of the session; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tabulark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark knows; a missing one is fine."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder. What is there goes when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def clear() -> None:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may have gone first; nothing depends on it any more
            pass

    atexit.register(clear)
    return path
