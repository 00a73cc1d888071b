"""Session, shared folder and table access used by every plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "caudal") -> SparkSession:
    """A session for tests and local runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: the session's ``spark.checkpoint.dir``; only a local session without one gets its own."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="caudal-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there and lost executors lose nothing.

    A written table keeps column pruning and pushed filters, which ``checkpoint()`` would lose. It lies under the application's
    own folder; ``clear_shared`` removes that. ``by``: a column of few values that later filters name, laid out as folders.
    """
    path = shared_folder(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def shared_folder(spark: SparkSession) -> str:
    """A new folder of the application in the shared folder, for tables that are written step by step."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/caudal-{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession) -> None:
    """Remove every table that ``cut`` wrote in this application. Results not yet read are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row frames as one row; the right one becomes scalar subqueries, so no join is planned."""
    return left.select("*", *[right.select(c).scalar().alias(c) for c in right.columns])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
