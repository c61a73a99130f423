"""Session helpers shared by every operator: lineage cuts, bounded broadcasts and table reads."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import WeftlineError

#: A driver-side or broadcast copy may hold at most this many rows unless the caller proves a tighter bound.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A folder of this machine stands in only where the executors are this process; on a cluster, an unset folder is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise WeftlineError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "weftline-checkpoints")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    A checkpoint survives the loss of any executor; ``localCheckpoint`` would not, so it is never used. The frame returned
    knows nothing of the plan before: the constraints a checkpoint carries on would double in every round of a loop.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    kept = df.checkpoint(eager=eager)
    bare = kept.sparkSession._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    return DataFrame(bare, kept.sparkSession)


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a columnar lineage cut that prunes columns on each read.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str = "ix") -> tuple[DataFrame, int]:
    """``df`` written once with a dense number from 0 on for each row in ``column``, and how many rows there are.

    Numbers are given part by part; only the parts' sizes come to the driver.
    """
    kept = written(df.withColumn(column, F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright(column, 33), F.col(column).bitwiseAND((1 << 33) - 1)
    sizes = dict(kept.groupBy(part).count().collect())
    before = [0]
    for i in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(i, 0))
    return kept.withColumn(column, F.get(F.array(*map(F.lit, before)), part).cast("long") + place), before[-1]


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` holds at most ``rows`` rows; reads no more than that bound needs."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast join when its checked size allows it, else ``df`` itself (a shuffled join)."""
    return F.broadcast(df) if small_enough(df, rows) else df


def parallel(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread the rows of a table with few, uneven files over the cluster's slots before per-row Python work.

    Skips the shuffle when the scan already has at least as many partitions as slots.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots * 2, key) if key else df.repartition(slots * 2)
