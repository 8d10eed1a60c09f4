"""Reading and writing fact files, runtime facts and id-scheme snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens import schema
from factlens.facts import FactBase
from factlens.operators import integrity, relations, runtime


def read_json(spark: SparkSession, path: str, struct: T.StructType = schema.FACT) -> DataFrame:
    """A fact file (one JSON array a file) as one wide table with ``ord``, the place in its file.

    Missing fields are null; a bad file fails the read.  A file is one record
    here, so a very large base should be ingested as many files, one line a
    fact (``read_lines``).
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(struct), {"mode": "FAILFAST"}).alias("facts"))
    return whole.select(F.posexplode("facts").alias("ord", "fact")).select("fact.*", F.col("ord").cast("long").alias("ord"))


def read_lines(spark: SparkSession, path: str, struct: T.StructType = schema.FACT) -> DataFrame:
    """Line-delimited facts; ``ord`` follows (file path, place in the file), whatever order files are read in.

    It is the rank of the file's split (one row a split is ranked), then the row's place.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from")]
    rows = spark.read.schema(struct).json(path).select("*", *place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    splits = spark.read.text(path).select(*place).distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_from")).cast("long"))
    out = rows.join(splits, ["_file", "_from"]).withColumn("ord", F.shiftleft("_rank", 33) + F.col("_row"))
    return out.select(*struct.names, "ord")


def write(facts: DataFrame, path: str, mode: str = "overwrite", check: bool = False) -> None:
    """Deduplicated facts as Parquet, partitioned by kind.  Facts are on disk before ``check`` may raise."""
    relations.dedup(facts).write.mode(mode).partitionBy("kind").parquet(path)
    if check:
        integrity.assert_invariants(FactBase.read(facts.sparkSession, path))


def write_json(facts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Facts as JSON lines, absent fields left out; the order is that of ``ord`` within sorted files."""
    facts.orderBy("ord").drop("ord").write.mode(mode).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def upsert_runtime(spark: SparkSession, new: DataFrame, path: str, out: str) -> None:
    """Add a run's edges to merged ones at ``path``, if there are any yet: samples add up, runs are counted, first fields stay."""
    new = new.withColumn("runs", F.lit(1).cast("long")).withColumn("ord", F.col("ord") + F.lit(1 << 40))
    if exists(spark, path):
        old = spark.read.parquet(path).withColumn("ord", F.lit(0).cast("long"))
        keep = [c for c in old.columns if c in new.columns]
        new = old.select(*keep).unionByName(new.select(*keep))
    runtime.merge(new.drop("run")).write.mode("overwrite").parquet(out)


def write_snapshot(records: DataFrame, path: str, version: int = 1) -> None:
    """Records partitioned by commit and schema version; rerunning a commit replaces only its own partition."""
    (records.withColumn("schema_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("schema_version", "sha").parquet(path))


def read_snapshot(spark: SparkSession, path: str, sha: str, version: int = 1) -> DataFrame:
    return spark.read.parquet(path).where((F.col("schema_version") == version) & (F.col("sha") == sha))


def cached_commits(spark: SparkSession, path: str, version: int = 1) -> set[str]:
    """Commits that have a partition of this schema version; their names are what the caller listed, a few bytes each."""
    if not exists(spark, f"{path}/schema_version={version}"):
        return set()
    return {r.sha for r in spark.read.parquet(path).where(F.col("schema_version") == version).select("sha").distinct().collect()}


def schemes(columns: list[str]) -> list[str]:
    """Id schemes: every field that ends in 'Id'."""
    return [c for c in columns if c.endswith("Id")]
