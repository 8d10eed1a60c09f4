"""The history of a repository: each commit's records once, all pairs of commits matched in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.operators import snapshot
from factlens.shared import save
from factlens.sources import extract, facts_io, tree

BY = ("child",)
SCHEMES = ("entityId", "structureId", "contentId")


def commit_pairs(spark: SparkSession, repository: str, path: str = "", most: int | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """(pair_ord, child, parent) of the first-parent history, or of a sample of it."""
    tree.register(spark)
    log = spark.read.format("commit_log").option("repository", repository).option("path", path).load()
    return save(tree.sampled_pairs(save(log, "log"), most, prefixes), "pairs")


def collect(spark: SparkSession, repository: str, out: str, pairs: DataFrame, path: str = "", version: int = 1) -> list[str]:
    """Write records and figures of the pairs' commits to ``out``, but for those written before; the commits that were new."""
    shas = [r.sha for r in pairs.select(F.explode(F.array("child", "parent")).alias("sha")).distinct().orderBy("sha").collect()]
    new = sorted(set(shas) - facts_io.cached_commits(spark, f"{out}/commits", version))
    if not new:
        return []
    files = save(spark.read.format("snapshot_files").option("repository", repository).option("shas", ",".join(new)).option("path", path).load(), "files")
    raw = save(extract.snapshot_raw(files), "raw")
    records = save(extract.snapshot_records(raw), "records")
    facts_io.write_snapshot(records, f"{out}/records", version)
    # Written last: a commit that has its figures has its records.
    facts_io.write_snapshot(figures(files, raw, records), f"{out}/commits", version)
    return new


def figures(files: DataFrame, raw: DataFrame, records: DataFrame) -> DataFrame:
    """(sha, files, failed, error, declKeys, joined, schemes) of each commit."""
    sha = F.split("file", "\n", 2)[0]
    failed = raw.where("kind = 'error'").groupBy(sha.alias("sha")).agg(F.count("*").alias("failed"))
    one = records.groupBy("sha", *snapshot.KEY).agg(F.count("entityId").alias("found"), *(F.count(s).alias(s) for s in SCHEMES))
    has = one.groupBy("sha").agg(F.count("*").alias("declKeys"), F.count_if(F.col("found") > 0).alias("joined"), F.array_compact(F.array(*(F.when(F.sum(s) > 0, s) for s in SCHEMES))).alias("schemes"))
    out = files.groupBy("sha").agg(F.count("*").alias("files")).join(failed, "sha", "left").join(has, "sha", "left").fillna(0, ["failed", "declKeys", "joined"])
    error = F.when(F.col("failed") == F.col("files"), F.lit("no file could be parsed"))
    return out.select("sha", "files", "failed", error.alias("error"), "declKeys", "joined", F.coalesce("schemes", F.array().cast("array<string>")).alias("schemes"))


def compare(spark: SparkSession, out: str, pairs: DataFrame, min_nodes: int = snapshot.MIN_NODES, least_files: int = 100, version: int = 1) -> dict[str, DataFrame]:
    """The report's sections by name, over all pairs both commits of which pass the quality gate."""
    mine = pairs.select(F.explode(F.array("child", "parent")).alias("sha")).distinct()
    of = lambda t: spark.read.parquet(f"{out}/{t}").where(F.col("schema_version") == version).drop("schema_version").join(mine, "sha", "left_semi")
    meta = save(of("commits"), "commits")
    good = snapshot.quality_gate(meta, least_files)
    used = pairs.join(good.withColumnRenamed("sha", "child"), "child", "left_semi").join(good.withColumnRenamed("sha", "parent"), "parent", "left_semi").select("child", "parent")
    records = of("records")
    a = save(records.join(used.withColumnRenamed("parent", "sha"), "sha").drop("sha"), "parents")
    b = save(records.join(used.select(F.col("child").alias("sha"), "child"), "sha").drop("sha"), "children")
    schemes = snapshot.common_schemes(meta.join(good, "sha", "left_semi")) or list(SCHEMES)
    d = snapshot.diff(a, b, min_nodes, BY)
    e = save(snapshot.events(d, a, b, schemes, BY, min_nodes), "events")
    return {
        "commits": meta.agg(F.count("*").alias("commits"), F.count_if(F.col("error").isNull() & (F.col("files") >= least_files)).alias("used")),
        "rates": snapshot.rates(meta),
        "categories": snapshot.categories(d, snapshot.records(a, BY), snapshot.records(b, BY), BY).groupBy("cat").agg(F.sum("n").alias("entities"), F.sum("positional").alias("positional"), F.count("*").alias("commits")),
        "scores": snapshot.scheme_scores(d, a, b, schemes, BY),
        "members left out": snapshot.scheme_scores(d, a, b, schemes, BY, [t for t in extract.MATCHED if t not in ("method", "accessor", "property", "constructor")]),
        "distinct events": snapshot.distinct_events(d, a, b, schemes, BY),
        "clusters": snapshot.event_clusters(e),
        "other side's types": snapshot.reappearing_types(d, a, b, schemes[0], BY),
        "blind spots": snapshot.blind_spots(d, a, b, BY),
        "examples": snapshot.examples(d),
    }
