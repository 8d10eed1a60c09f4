"""Source trees: whole files with their paths, and the commit log of a repository."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from factlens.functions import ids


def source_files(spark: SparkSession, root: str, glob: str = "*.ts") -> DataFrame:
    """(path, text) of files under ``root``; test directories and test files are left out, paths are relative."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    # Paths come as URLs; a plus sign in them stands for itself.
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    out = raw.select(ids.relative(path, root).alias("path"), F.col("value").alias("text"))
    return out.where(~F.col("path").rlike(r"(^|/)tests/") & ~F.col("path").contains(".test."))


class CommitLog(DataSource):
    """``spark.read.format("commit_log").option("repository", dir).option("path", sub).load()``: single-parent commits of the first-parent history, oldest first.

    One read of the log on one task: it is a few bytes a commit, and git walks it in order anyway.
    """

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return "pair_ord long, child string, parent string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LogReader(dict(self.options))


class _LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cmd = ["git", "-C", self.options["repository"], "log", "--first-parent", "--reverse", "--format=%H %P"]
        if sub := self.options.get("path"):
            cmd += ["--", sub]
        n = 0
        for line in subprocess.run(cmd, check=True, capture_output=True, text=True).stdout.splitlines():
            shas = line.split()
            if len(shas) == 2:
                yield n, shas[0], shas[1]
                n += 1


def sampled_pairs(pairs: DataFrame, most: int | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Every k-th of the pairs, so that ``most`` stay, or those whose child has one of the sha prefixes."""
    if prefixes:
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | F.col("child").startswith(p)
        return pairs.where(cond)
    if not most:
        return pairs
    n = pairs.count()
    if n <= most:
        return pairs
    slot = F.floor(F.col("pair_ord") * most / n)
    return pairs.where(slot != F.floor((F.col("pair_ord") - 1) * most / n)) if n else pairs


class SnapshotFiles(DataSource):
    """``format("snapshot_files")`` with options repository, shas (comma-separated), path, suffix: (sha, path, text), a partition a commit."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_files"

    def schema(self) -> str:
        return "sha string, path string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SnapshotReader(dict(self.options))


class _SnapshotReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.options["shas"].split(",") if s]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import io
        import tarfile

        cmd = ["git", "-C", self.options["repository"], "archive", partition.value]
        if sub := self.options.get("path"):
            cmd.append(sub)
        suffix = self.options.get("suffix", ".ts")
        with tarfile.open(fileobj=io.BytesIO(subprocess.run(cmd, check=True, capture_output=True).stdout)) as tar:
            for m in tar:
                if m.isfile() and m.name.endswith(suffix) and "/tests/" not in f"/{m.name}" and ".test." not in m.name:
                    yield partition.value, m.name, tar.extractfile(m).read().decode("utf-8", "replace")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommitLog)
    spark.dataSource.register(SnapshotFiles)
