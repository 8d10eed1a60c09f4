"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This session's folder under spark.checkpoint.dir; only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    held = getattr(sc, "_factlens_facts", None)
    if held:
        return held
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc._jsc.sc().getCheckpointDir().get()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="factlens-")
    held = sc._factlens_facts = f"{base.rstrip('/')}/facts-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            drop(spark, held)
        except Exception:  # the JVM may have gone first
            pass

    atexit.register(clear)
    return held


def drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def files_for(df: DataFrame, least: int) -> int:
    """How many files to write at most: one for each split's worth of what is read, ``least`` for small tables."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return min(max(least, -(-read // max(split, 1))), 1 << 30)


def save(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    df = df.coalesce(files_for(df, spark.sparkContext.defaultParallelism))
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factlens_path = path
    return out


def together(*tables: DataFrame) -> DataFrame:
    """Saved tables of one schema as one scan: nothing is copied, and the plan does not grow with their number."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*(t._factlens_path for t in tables))


def forget(*tables: DataFrame) -> None:
    for t in tables:
        if path := getattr(t, "_factlens_path", None):
            drop(t.sparkSession, path)
