"""Session helpers: local sessions for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks.  On a cluster, pass the cluster's own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mailposture")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of compressed columns that one shuffle task starts from.  Rows of the views are highly alike, so a megabyte of them is some 100,000 rows.
TASK_BYTES = 8 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SCAN_BYTES = "spark.sql.files.maxPartitionBytes"
#: Where the session's own value of ``SCAN_BYTES`` is kept while a job has a smaller one.
OWN_SCAN_BYTES = "spark.mailposture.ownMaxPartitionBytes"


def input_bytes(spark: SparkSession, path: str) -> int:
    """Size of a table's files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def size_tasks(spark: SparkSession, read: int, fan_out: int = 1) -> None:
    """Let the number of shuffle partitions grow with the bytes read, so that the memory of a task does not.

    Adaptive execution still merges small partitions, but only up to ``TASK_BYTES``: the usual 64 MB of compressed rows may be ten million rows to sort.
    The session's own number of partitions is the least.

    ``fan_out`` is for jobs that derive many rows from each they read: how many times the bytes read one shuffle may hold.  Their scan tasks are bounded too, since
    they sort the derived rows before the shuffle; otherwise Spark lets a scan task grow with the input up to 128 MB.
    """
    wanted = -(-read * fan_out // TASK_BYTES)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))
    else:
        spark.conf.unset(INITIAL_PARTITIONS)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    bound_scans(spark, fan_out > 1)


def bound_scans(spark: SparkSession, bounded: bool) -> None:
    """Let a scan task read ``TASK_BYTES`` at most, or what the session had set before."""
    own = spark.conf.get(OWN_SCAN_BYTES, None)
    if bounded and own is None:
        spark.conf.set(OWN_SCAN_BYTES, spark.conf.get(SCAN_BYTES))
        spark.conf.set(SCAN_BYTES, str(min(TASK_BYTES, scan_bytes(spark))))
    elif not bounded and own is not None:
        spark.conf.set(SCAN_BYTES, own)
        spark.conf.unset(OWN_SCAN_BYTES)


def scan_bytes(spark: SparkSession) -> int:
    """Bytes a scan task may read in this session."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


#: Bytes of rows that Spark hands to a mapper over Arrow batches at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at ``BATCH_BYTES`` besides their number of rows: 10,000 whole texts may be any number of bytes, which executor and worker each hold at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder, as in tests on one machine.  A session on a
    cluster is refused then, since a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if shared:
        return shared
    if context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a shared folder before running jobs in several steps")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="mailposture-"))
    return context.getCheckpointDir()


def store(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This ends the lineage, so a lost executor costs a re-read, and a table read by several jobs is computed once.  Being a
    written table it keeps column pruning, pushed filters and its size for the choice of joins.
    """
    path = f"{shared_folder(df.sparkSession)}/mailposture-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def step(df: DataFrame) -> DataFrame:
    """:func:`store` for one step of a long job: packed closer, and the shuffle files of the step go before the next one writes its own."""
    stored = store(df, "zstd")
    release_shuffles(df.sparkSession)
    return stored


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`store` wrote.  Nothing that is still to run may read them."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nobody holds any more; it does so when the driver collects garbage, which may be never in a short job."""
    gc.collect()
    spark._jvm.System.gc()
