"""Session construction and the shared working folder.

Jobs that cut lineage or hand tables between stages write to the folder the
cluster names in ``spark.checkpoint.dir``.  That setting is read from the
running session; on a local master a folder is made when it is unset, and deleted
when the process ends. On a cluster an unset folder is an error: a machine-local
one would leave each executor with its own part of a table.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings that matter for the plans in this package.
#  * AQE re-plans joins at runtime: a side whose *measured* shuffle size is
#    below the adaptive broadcast threshold becomes a broadcast hash join, a
#    bigger one stays a sort-merge join.  This is the size check behind every
#    data-dependent small side (split project sets, vocabularies, offsets).
#  * The window group limit threshold is raised so that per-class quotas of
#    a few thousand rows are trimmed inside each task before the exchange.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "patchlens",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_session_conf(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session."""
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


#: Shuffled bytes that a task gets, and input bytes (Parquet) for each of the partitions that rows are first dealt to.
TASK_BYTES = 4 << 20
DEALT_BYTES = 1 << 20
#: Bytes of Parquet that a task reads.
SCAN_BYTES = 32 << 20


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def size_tasks(spark: SparkSession, folder: str) -> None:
    """Tasks of one size, however large the tables in ``folder``: rows are dealt to as many partitions as the tables'
    bytes ask for, and adaptive execution joins small ones up to ``TASK_BYTES``. Settings that ask for less stay."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(least, -(-held // DEALT_BYTES)))
    for name, most in (("adaptive.advisoryPartitionSizeInBytes", TASK_BYTES), ("files.maxPartitionBytes", SCAN_BYTES)):
        spark.conf.set(f"spark.sql.{name}", f"{min(_bytes(spark.conf.get(f'spark.sql.{name}')), most)}b")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and stage hand-offs.

    ``spark.checkpoint.dir`` if it is set; otherwise, on a local master only, a
    folder that is made once, recorded in the session and deleted at exit.
    """
    conf = spark.sparkContext.getConf()
    d = conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="patchlens-shared-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    return d


_made: list = []  # (file system, path) of the tables that this process has put into the shared folder


def _clear() -> None:
    for fs, path in _made:
        with contextlib.suppress(Exception):  # the cluster, or the table, may be gone by then
            fs.delete(path, True)
    _made.clear()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never reused; what is written there is deleted when the process ends, on a cluster too."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clear)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made.append((at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at))
    return path


def materialize(df):
    """Cut a finished stage's lineage: a Parquet table in the shared folder.

    Unlike a checkpoint's serialised rows, later reads prune columns, push
    filters down and know the table's size.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
