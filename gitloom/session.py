"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they hold for any session handed to the library, the
# cluster's own included.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even where the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows placed by some of a join's keys already are joined where they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, wherever they were started."""
    context = spark.sparkContext
    if getattr(context, "_gitloom_shipped", False):
        return
    package = Path(__file__).parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='gitloom-')}/gitloom-package", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._gitloom_shipped = True


def local_session(cores: int | str = "*", app: str = "gitloom") -> SparkSession:
    """A single-machine session for tests, benchmarks and the command line."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="gitloom-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gitloom/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Drop the tables this application wrote on the way. Frames built on them end here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(frame: DataFrame, name: str) -> DataFrame:
    """Write *frame* as a table in the shared folder and read it back.

    This is the library's lineage cut: what is read back survives the loss of
    executors, keeps its column statistics for join planning, and is read with
    column pruning. It also fixes values that depend on physical placement.
    """
    spark = frame.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def pieces(units: DataFrame, each: int) -> int:
    """How many parts costly row work is cut into: one for every *each* of the units."""
    return max(1, -(-units.count() // each))
