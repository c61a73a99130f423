"""Incremental indexing as a stream: files that arrive are parsed once and merged into keyed tables.

An extension of the batch build, which it shares the parser with. The file source lists new files, ``foreachBatch`` gives
exactly-once merges: a batch's tables are written to a folder named by its number, so a repeated batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.config import Config
from weftline.operators import parse
from weftline.plans.build import derive
from weftline.sources.files import relative_to


def read_stream(spark: SparkSession, root: str, max_files: int = 10_000) -> DataFrame:
    """New files below ``root`` as a stream of ``(path, content, modified)``."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    return rows.select(relative_to(root).alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))


def index_stream(files: DataFrame, out: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Parse every arriving file into ``out/<table>/batch=N``; ends when what is there has been read."""
    config = config or Config()

    def merge(batch: DataFrame, number: int) -> None:
        parsed = parse.parse_documents(batch.select("path", "content"), config).persist()
        try:
            tables = derive(parsed, config) | {"files": batch.select("path", "modified")}
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            parsed.unpersist()

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, table: str, file: str) -> DataFrame:
    """A table as of the last batch each file came in: later batches of a file replace earlier ones whole."""
    latest = spark.read.parquet(f"{out}/files").groupBy(F.col("path").alias(file)).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/{table}").join(latest, [file, "batch"], "left_semi").drop("batch")
