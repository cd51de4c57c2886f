"""Session defaults and the one place that decides where durable scratch data goes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, app: str = "quire") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.minPartitionNum", str(partitions))
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on for right results.

    Spark 4.1 lets a union claim the partitioning of its inputs. With nested
    unions of repartitioned inputs this skipped a needed shuffle and lost
    matches in window queries (seen on 4.1.2), so it is switched off. Rows hold
    whole texts, so batches for Python workers are bounded in bytes.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def prepared(operator: Callable) -> Callable:
    """An operator that unions its inputs: makes sure of prepare() for the session of its first DataFrame."""

    @wraps(operator)
    def run(*args, **named):
        for value in (*args, *named.values()):
            if isinstance(value, DataFrame):
                prepare(value.sparkSession)
                break
        return operator(*args, **named)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a single machine where none is set (tests)."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if not named and not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spark-")
    if not current:
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, for what reads them more than once; columns not asked for are not read again."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor, and keeps loop plans short."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
