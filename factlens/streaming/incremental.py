"""Incremental facts: files arrive as a stream of (file, version, facts); the newest version of a file counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factlens import schema


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited wide facts with ``source_file``, ``version`` and ``arrived`` columns."""
    struct = schema.wide().add("source_file", "string").add("version", "long").add("arrived", "timestamp")
    return spark.readStream.schema(struct).json(path)


def new_facts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each fact of a file version once, though files are delivered again within ``late``."""
    cols = [c for c in stream.columns if c != "arrived"]
    return stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(cols)


def current(facts: DataFrame) -> DataFrame:
    """Of a table of all versions, each source file's newest."""
    newest = facts.groupBy("source_file").agg(F.max("version").alias("version"))
    return facts.join(newest, ["source_file", "version"], "left_semi")


def maintain(stream: DataFrame, table: str, checkpoint: str, refresh: Callable[[DataFrame, set[str]], None] | None = None) -> StreamingQuery:
    """Append versions to the Parquet ``table``, partitioned by kind; ``refresh(current facts, kinds that changed)`` follows each batch.

    A batch that is retried rewrites its own folder, so that it counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.drop("arrived")
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{table}/batch={number}")
        if refresh:
            spark = batch.sparkSession
            kinds = {r.kind for r in batch.select("kind").distinct().collect()}
            refresh(current(spark.read.option("basePath", table).parquet(f"{table}/batch=*")), kinds)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_rate(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Runtime call facts by window and callee: (window, calleeId, samples)."""
    return stream.where("kind = 'calls'").withWatermark("arrived", late).groupBy(F.window("arrived", window), "calleeId").agg(F.count("*").alias("samples"))
