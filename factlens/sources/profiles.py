"""Sampling profiles: nodes and samples from .cpuprofile files, and positions through source maps."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens import schema

_DIGITS = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(profile, node, parent, functionName, url, line, col, hits) of each profile file; lines count from 1."""
    raw = spark.read.schema(schema.PROFILE).option("multiLine", "true").json(path).withColumn("profile", F.col("_metadata.file_name"))
    nodes = raw.select("profile", F.explode("nodes").alias("n"))
    up = nodes.select("profile", F.col("n.id").alias("parent"), F.explode("n.children").alias("node"))
    hits = raw.select("profile", F.explode("samples").alias("node")).groupBy("profile", "node").agg(F.count("*").alias("hits"))
    own = nodes.select("profile", F.col("n.id").alias("node"), F.col("n.callFrame.functionName"), F.col("n.callFrame.url"), F.col("n.callFrame.scriptId"), (F.col("n.callFrame.lineNumber") + 1).alias("line"), F.col("n.callFrame.columnNumber").alias("col"))
    return own.join(up, ["profile", "node"], "left").join(hits, ["profile", "node"], "left").fillna(0, ["hits"])


def in_corpus(url: Column, root: str) -> Column:
    """Whether a frame's file URL, decoded, lies under ``root``."""
    return F.regexp_replace(F.url_decode(url), r"^file://", "").startswith(root.rstrip("/") + "/")


def _numbers(text: str) -> Iterator[int]:
    """Base64 variable-length quantities of one mapping segment."""
    value = shift = 0
    for c in text:
        d = _DIGITS[c]
        value |= (d & 31) << shift
        if d & 32:
            shift += 5
        else:
            yield -(value >> 1) if value & 1 else value >> 1
            value = shift = 0


def decode_mappings(mappings: str) -> list[tuple[int, int, int, int, int]]:
    """(generated line, generated column, source, line, column), all from 0, in order."""
    out = []
    src = line = col = 0
    for g, row in enumerate(mappings.split(";")):
        at = 0
        for seg in filter(None, row.split(",")):
            n = list(_numbers(seg))
            at += n[0]
            if len(n) >= 4:
                src, line, col = src + n[1], line + n[2], col + n[3]
                out.append((g, at, src, line, col))
    return out


def source_map_segments(scripts: DataFrame) -> DataFrame:
    """(scriptId, gline, gcol, source, line, col) from (scriptId, text) with an inline base64 map; scripts without a readable one give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [("scriptId", pa.string()), ("gline", pa.int32()), ("gcol", pa.int32()), ("source", pa.string()), ("line", pa.int32()), ("col", pa.int32())]
        for b in batches:
            rows = []
            for sid, text in zip(b.column("scriptId").to_pylist(), b.column("text").to_pylist(), strict=True):
                mark = (text or "").rfind("sourceMappingURL=data:application/json")
                try:
                    m = json.loads(base64.b64decode(text[mark:].split("base64,", 1)[1].strip().split()[0])) if mark >= 0 else {"mappings": ""}
                    rows += [(sid, g, c, m["sources"][s], ln, co) for g, c, s, ln, co in decode_mappings(m["mappings"])]
                except (IndexError, KeyError, ValueError):  # an unreadable map gives no positions
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(names)], [n for n, _ in names])

    return scripts.select("scriptId", "text").mapInArrow(run, "scriptId string, gline int, gcol int, source string, line int, col int")


def original_positions(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames (scriptId, gline, gcol) with the source, line and col of the last mapping at or before them on their line.

    One ordered pass over both, line by line: a minified script on one line is a
    sort of its mappings and frames, not their product.
    """
    f = frames.select("scriptId", "gline", "gcol").distinct()
    none = F.lit(None).cast("struct<gcol:int,source:string,line:int,col:int>")
    s = segments.select("scriptId", "gline", "gcol", F.lit(0).alias("asks"), F.struct("gcol", "source", "line", "col").alias("m"))
    both = s.unionByName(f.select("scriptId", "gline", "gcol", F.lit(1).alias("asks"), none.alias("m")))
    line = Window.partitionBy("scriptId", "gline").orderBy("gcol", "asks", "m").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("m", F.last("m", ignorenulls=True).over(line)).where("asks = 1 and m is not null")
    return found.select("scriptId", "gline", "gcol", "m.source", "m.line", "m.col")
