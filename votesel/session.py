"""Session helpers: configuration for local runs and a shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "votesel") -> SparkSession:
    """Session for tests and benchmarks. On a cluster the caller builds its own session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxPlanStringLength", "100000")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (tests) make a scratch one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="votesel-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


#: Spark drops the shuffle files of a query when it ends, rather than when the driver's garbage collector meets it.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, track: list | None = None, free_shuffles: bool = False) -> DataFrame:
    """Cut the lineage by writing ``df`` as a parquet table under the shared checkpoint folder
    and reading it back (one job; survives executor loss like a reliable checkpoint).
    The table's path is appended to ``track`` so a loop can drop it when done. ``free_shuffles``: the shuffle files
    of the job go with it (``df`` must not read persisted plans)."""
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/votesel-tables/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    if free_shuffles:
        conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode("error").option("compression", "zstd").parquet(path)
    finally:
        if free_shuffles:
            conf.unset(FREE_SHUFFLES) if before is None else conf.set(FREE_SHUFFLES, before)
    if track is not None:
        track.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list) -> None:
    """Delete written intermediate tables (call only once nothing reads them any more)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    paths.clear()


def materialize(df: DataFrame) -> DataFrame:
    """Compute an intermediate that several later plans read, once, as a written table.

    Written tables rather than ``persist``: a cached plan is matched against every later
    query's subtrees during optimization, so a pipeline that keeps many cache entries
    spends more and more driver time planning; a table is a plain file-scan leaf."""
    return cut_lineage(df)


def loop_state(df: DataFrame, step: int, track: list | None = None) -> DataFrame:
    """State of an iterative loop, written to the checkpoint folder at every step: the next
    step's plan starts from a file scan, so neither lineage nor plan size grows. (Persisting
    instead would nest cached plans, and dropping an older cache invalidates the newer ones.)"""
    return cut_lineage(df, track)
