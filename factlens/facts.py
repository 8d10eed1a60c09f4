"""A fact base: typed relations by kind, each a lazy DataFrame with an ordinal column ``ord``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens import schema


class FactBase:
    """Relations by kind.  ``ord`` is the position in the fact file: first-wins and last-wins are by it."""

    def __init__(self, views: dict[str, DataFrame | Callable[[], DataFrame]]):
        self._views = dict(views)

    def view(self, kind: str) -> DataFrame:
        v = self._views[kind]
        if callable(v) and not isinstance(v, DataFrame):
            v = self._views[kind] = v()
        return v

    def __getitem__(self, kind: str) -> DataFrame:
        return self.view(kind)

    @property
    def kinds(self) -> list[str]:
        return list(self._views)

    @classmethod
    def of(cls, facts: DataFrame) -> FactBase:
        """From one wide table with ``kind`` and ``ord``; a view prunes partitions and columns."""
        have = set(facts.columns)
        return cls({k: facts.where(F.col("kind") == k).select(*(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in s.fields), "ord") for k, s in schema.KINDS.items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> FactBase:
        return cls.of(spark.read.parquet(path))

    def heritage(self) -> DataFrame:
        return self["extends"].unionByName(self["implements"])

    def register(self, prefix: str = "") -> None:
        """Temp views for Spark SQL (kind tags that are keywords get a trailing underscore)."""
        for k in self._views:
            name = k + "_" if k in {"import", "references", "extends", "implements", "contains"} else k
            self.view(k).createOrReplaceTempView(prefix + name)
