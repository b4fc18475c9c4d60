"""Session helpers: shared scratch space, lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound on the rows of a lookup table that may be broadcast. Lookup rows
# here are a few short keys and one number, so this stays near 100 MB.
MAX_BROADCAST_ROWS = 1_000_000


def build_session(app: str = "broadsheet", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one machine, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="broadsheet-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_within(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` if it has at most ``max_rows`` rows, else ``(df, False)``.

    The check stops counting one row past the bound. Pass a table that is already
    written or checkpointed, so that the check does not compute it twice.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df), True
    return df, False


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a small input has fewer splits than there are cores.

    Large inputs have more splits than cores and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
