"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows stay under this bound.
BROADCAST_ROWS = 200_000


def local_session(app: str = "cellgrid", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("CELLGRID_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only where none is named on one machine (tests), a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("a cluster must name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellgrid-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder; what follows survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables that this process has written: what they were made from -> their path.
_WRITTEN: dict[tuple, str] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)))


def materialized(spark: SparkSession, name: str, sf_dir: str, sources: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read: written once, as columns, to the checkpoint folder, and again only when its source files change."""
    key = (spark.sparkContext.applicationId, name, sf_dir, *[_stamp(spark, f"{sf_dir}/{s}.parquet") for s in sources])
    path = _WRITTEN.get(key)
    if path is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.read.parquet(path)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    build().write.parquet(path)
    _WRITTEN[key] = path
    return spark.read.parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the counted rows are under the bound."""
    return F.broadcast(df) if rows <= bound else df
