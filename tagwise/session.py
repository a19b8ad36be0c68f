"""SparkSession construction and shared-folder helpers.

Cluster settings (``spark.checkpoint.dir``, shuffle partitions, memory) are read from
the session that the cluster hands us; we only fill in values that are unset, which is
what happens in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on for correct results (UTC event time, ANSI off-ramps via
# try_* functions) or for runtime re-planning (AQE coalesce / skew join / runtime
# broadcast decided from measured sizes).
_REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app_name: str = "tagwise",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or attach to) a SparkSession with the settings the jobs assume.

    ``master`` and ``shuffle_partitions`` are only applied when given, so a cluster
    submission keeps its own values.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        # local runs: no UI server, modest driver-side defaults
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("TAGWISE_DRIVER_MEM", "8g"))
    for key, value in _REQUIRED_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in _REQUIRED_CONF.items():
        if key != "spark.sql.streaming.stateStore.providerClass":
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A session that runs in this process alone (``local[...]``) and names none gets a fresh
    folder. Any other session must name one: executors write to it and the driver and other
    executors read it, so a machine-local folder would lose rows without a word.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tagwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir.rstrip("/")


#: Bytes of an Arrow batch on its way to a Python worker. Spark's own limit is 10,000 rows, which
#: for whole texts is all of a task's input, held by the JVM twice (as vectors and as a stream)
#: and by the worker once.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session names a bound itself. It stays, as what
    is planned now may run later."""
    name, size = ARROW_BATCH
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, size)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder of the shared checkpoint root for written intermediate tables
    and streaming checkpoints."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_SHARED: dict[tuple[str, str], str] = {}


def shared_path(spark: SparkSession, name: str, key: str, build) -> str:
    """The folder that ``build()`` returns, made once for each application, ``key`` (the input
    it derives from) and state of that input's files."""
    at = (f"{spark.sparkContext.applicationId}/{name}", f"{key}@{_input_state(spark, key)}")
    if at not in _SHARED:
        _SHARED[at] = build()
    return _SHARED[at]


def _input_state(spark: SparkSession, folder: str) -> int:
    """Latest modification time of the tables in an input folder and of their files, so that an
    input written anew is not taken for the one that was read before."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max((s.getModificationTime() for s in fs.listStatus(path)), default=0) if fs.exists(path) else 0


def shared_table(spark: SparkSession, name: str, key: str, build):
    """The table that ``build()`` describes, written once (see :func:`shared_path`) and read back
    by every later caller: queries over one curated corpus or one fitted model do not derive it
    again."""
    def write() -> str:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        return path
    return spark.read.parquet(shared_path(spark, name, key, write))


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and return a
    DataFrame reading it back. Used where one intermediate feeds several branches of a
    plan (each branch prunes different columns, so Spark cannot reuse the exchange and
    would recompute the whole upstream per branch) and to cut long lineages. The written
    table survives executor loss, unlike cached blocks."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
