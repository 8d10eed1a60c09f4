"""Near-duplicate embeddings by an epsilon grid order join.

Vectors are scaled to length one, so that a cosine of at least ``cosine`` is a
distance of at most epsilon = sqrt(2 - 2 * cosine).  They are projected on
leading principal directions, put in grid cells of width epsilon and sorted by
cell, dimension by dimension (the epsilon grid order); equal vectors are one
class.  The sorted sequence is cut into blocks, and a tree over the blocks
holds bounding boxes of the projections and of the length that they leave out
(both change by no more than the distance).  Sequence intervals are joined
recursively from the root: a pair of intervals whose boxes lie more than
epsilon apart is skipped with all it holds, else its halves are paired.  Pairs
of blocks that remain are compared by cosine in double precision.

Scale: the recursion is a loop of joins over interval pairs, level by level, in
Spark.  Block pairs are dealt out in tiles of ``TILE`` by ``TILE`` blocks, so
that a block travels once a tile, not once a pair.  A tile returns at most a few
rows a vector: link counts (copies weigh in), and each vector's smallest partner
of the tile instead of all pairs.  No task holds more than two tiles' sides, and
no key gathers an unbounded group.  The principal directions come from
``SAMPLE_BYTES`` of vectors, picked by hash: any directions give the same result,
good ones skip more.  What can't be skipped is quadratic work, and the shuffle
then is 2 / TILE of a block for each block pair.  ``skipped`` counts pairs.

Defined results: a null, zero or empty vector, or one with null or non-finite
components, links with nothing; vectors are compared among their own length only
(one pass for each length that occurs); ids may be of any type; a null vec_id
stays null, in no component; a repeated vec_id gives a result for each row,
shares one component, and its rows count as links of each other only if they are
different ids; cosines are compared with ``cosine`` itself, without tolerance; an
empty table gives an empty result; other columns (labels too) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components

#: Vectors of a block; two blocks of doubles of some hundred components take a few MB.
BLOCK = 512
#: Children of a node of the interval tree.
FAN = 4
#: Blocks on a side of a tile; the two sides of a tile of single-precision vectors of 100 components take 6 MB.
TILE = 16
#: Vectors of so many bytes at most tell the principal directions.
SAMPLE_BYTES = 8_000_000
#: Leading principal directions that the grid and the boxes use.
LEADING = 8


def _scaled(x: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of extreme vectors finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)


def _usable(number: str):
    """Vectors as bytes in their own precision: single ones travel at half the size and widen exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw, dims = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not v.is_valid or not len(v):
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if v.values.null_count or not np.isfinite(x).all() or not np.any(x):
                    continue
                ids.append(i)
                raw.append((x + 0.0).astype(number).tobytes())  # minus zero becomes zero: equal vectors have equal bytes
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(raw, pa.binary()), pa.array(dims, pa.int64())], ["vec_id", "raw", "dim"])

    return run


def _principal(classes: DataFrame, dim: int, number: str) -> tuple[np.ndarray, np.ndarray]:
    """(mean, leading directions) of a sample of the vectors."""
    most = max(SAMPLE_BYTES // (dim * int(number[1])), 100)
    n = classes.count()
    rows = classes.select("raw").where(F.pmod(F.xxhash64("raw"), F.lit(1 << 20)) < min(int(1.1 * most / max(n, 1) * (1 << 20)) + 1, 1 << 20)).limit(most)
    raw = rows.toArrow().column("raw").to_pylist()
    u = _scaled(_vectors(raw, dim, number)) if raw else np.zeros((1, dim))
    mean = u.mean(0)
    _, vec = np.linalg.eigh((u - mean).T @ (u - mean))
    return mean, np.ascontiguousarray(vec[:, ::-1][:, : min(LEADING, dim)])


def _placed(u: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Projections, and the length of what they leave out: no two differ by more than the vectors' distance."""
    p = (u - mean) @ axes
    rest = np.sqrt(np.maximum(((u - mean) ** 2).sum(1) - (p**2).sum(1), 0))
    return np.column_stack([p, rest])


def _classes(vectors: DataFrame, vec_id: str, embedding: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, str]:
    """(usable vectors, classes of equal ones with a number, the smallest id and the number of ids, the components' kind)."""
    kind = vectors.schema[vec_id].dataType.simpleString()
    number = "f4" if isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType) else "f8"
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id is not null")
    good = scratch.save(rows.mapInArrow(_usable(number), f"vec_id {kind}, raw binary, dim long"), "usable")
    ids = good.select("vec_id", "raw", "dim").distinct()
    classes = ids.groupBy("raw", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    # Written once, so that numbers stay.
    return good, scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes"), number


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    all_ = vectors.select(F.col(vec_id).alias("vec_id"))
    good, classes, number = _classes(vectors, vec_id, embedding, scratch)
    links, counts = None, None
    for row in classes.select("dim").distinct().orderBy("dim").collect():
        c, e = _join(classes.where(F.col("dim") == row.dim), row.dim, number, cosine, scratch)
        counts, links = (c, e) if counts is None else (counts.unionByName(c), links.unionByName(e))
    if counts is None:
        return all_.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    named = classes.select("cid", "rep")
    counts = counts.groupBy("cid").agg(F.sum("n").alias("n")).join(named, "cid").select("rep", "n")
    links = links.join(named.select(F.col("cid").alias("x"), F.col("rep").alias("a")), "x").join(named.select(F.col("cid").alias("y"), F.col("rep").alias("b")), "y").select("a", "b")
    member = scratch.save(good.join(classes.select("raw", "rep", "weight"), "raw").select("vec_id", "rep", "weight").distinct(), "members")
    # An id with different vectors on several rows ties its classes together.
    tied = member.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    labels = components(links.unionByName(tied), scratch)
    # Ids of the same class that differ link with each other: weight - 1; classes of one representative add up.
    found = member.join(counts.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.groupBy("vec_id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    found = scratch.save(found, "found")
    out = all_.select("vec_id").join(found, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


def _join(classes: DataFrame, dim: int, number: str, cosine: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((cid, n) link counts weighted by copies, (x, y) spanning links) among classes of one length."""
    blocks, pairs = block_pairs(classes, dim, number, cosine, scratch)
    # Tiles of block pairs, and the blocks on either side of each.
    tile = [F.floor(F.col(c) / TILE).alias(t) for c, t in (("a", "ta"), ("b", "tb"))]
    tiled = pairs.select(*tile, "a", "b")
    sides = tiled.select("ta", "tb", F.explode(F.array("a", "b")).alias("block")).distinct().join(blocks, "block")

    def compared(key: tuple, sides: pa.Table, wanted: pa.Table) -> pa.Table:
        return _compare(sides, wanted, dim, number, cosine)

    # Aliases of their own, as both come from the same pairs.
    sides = sides.select(F.col("ta").alias("sa"), F.col("tb").alias("sb"), "block", "ids", "weights", "raw")
    both = sides.groupBy("sa", "sb").cogroup(tiled.groupBy("ta", "tb")).applyInArrow(compared, "kind int, x long, y long")
    both = scratch.save(both, "links")
    return both.where("kind = 0").select(F.col("x").alias("cid"), F.col("y").alias("n")), both.where("kind = 1").select("x", "y")


def block_pairs(classes: DataFrame, dim: int, number: str, cosine: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(blocks of the sorted sequence, (a, b) pairs of those that can hold links)."""
    eps = float(np.sqrt(max(2 - 2 * cosine, 0)))
    mean, axes = _principal(classes, dim, number)
    k = axes.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = _placed(_scaled(_vectors(b.column("raw").to_pylist(), dim, number)), mean, axes)
                cells = np.floor(p[:, :k] / max(eps, 1e-6)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("raw"), b.column("weight"), *(pa.array(cells[:, j]) for j in range(k))], ["cid", "raw", "weight", *(f"c{j}" for j in range(k))])

    order = [f"c{j}" for j in range(k)] + ["cid"]
    grid = classes.select("cid", "raw", "weight").mapInArrow(placed, "cid long, raw binary, weight long, " + ", ".join(f"c{j} long" for j in range(k)))
    # The id is the last sort key, so that one full cell spreads over partitions.
    line = grid.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seq = 0

        def block() -> pa.RecordBatch:
            raw = [h[1] for h in held]
            p = _placed(_scaled(_vectors(raw, dim, number)), mean, axes)
            ids = np.array([h[0] for h in held], np.int64)
            return pa.RecordBatch.from_pydict(
                {"part": [held[0][3]], "seq": [seq], "ids": [ids.tobytes()], "weights": [np.array([h[2] for h in held], np.int64).tobytes()], "raw": [b"".join(raw)], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()]}
            )

        for b in batches:
            for h in zip(b.column("cid").to_pylist(), b.column("raw").to_pylist(), b.column("weight").to_pylist(), b.column("part").to_pylist(), strict=True):
                held.append(h)
                if len(held) == BLOCK:
                    yield block()
                    held, seq = [], seq + 1
        if held:
            yield block()

    blocks = line.select("cid", "raw", "weight", "part").mapInArrow(cut, "part long, seq long, ids binary, weights binary, raw binary, lo array<double>, hi array<double>")
    blocks = scratch.save(blocks, "blocks")
    # Number the blocks along the sequence: offsets of partitions are a few numbers.
    sizes = blocks.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    at, offsets = 0, []
    for r in sizes:
        offsets.append((r.part, at))
        at += r.n
    if not offsets:
        offsets = [(0, 0)]
    offset = spark_frame(blocks, offsets)
    blocks = scratch.save(blocks.join(offset, "part").withColumn("block", F.col("offset") + F.col("seq")).drop("part", "seq", "offset"), "numbered")
    dims = range(k + 1)
    tree = blocks.select(F.lit(0).alias("level"), F.col("block").alias("node"), *(F.col("lo")[j].alias(f"l{j}") for j in dims), *(F.col("hi")[j].alias(f"h{j}") for j in dims))
    levels = [tree]
    count = at
    while count > 1:
        up = levels[-1].groupBy((F.floor(F.col("node") / FAN)).alias("node")).agg(*(F.min(f"l{j}").alias(f"l{j}") for j in dims), *(F.max(f"h{j}").alias(f"h{j}") for j in dims))
        levels.append(scratch.save(up.select(F.lit(len(levels)).alias("level"), "node", *(f"l{j}" for j in dims), *(f"h{j}" for j in dims)), "tree"))
        count = -(-count // FAN)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for nodes in reversed(levels[:-1]):
        # Each side's children, the boxes of which must lie within epsilon of each other.
        kids = nodes.withColumn("up", F.floor(F.col("node") / FAN))
        x = kids.select(F.col("up").alias("a"), F.col("node").alias("ka"), *(F.col(f"l{j}").alias(f"al{j}") for j in dims), *(F.col(f"h{j}").alias(f"ah{j}") for j in dims))
        y = kids.select(F.col("up").alias("b"), F.col("node").alias("kb"), *(F.col(f"l{j}").alias(f"bl{j}") for j in dims), *(F.col(f"h{j}").alias(f"bh{j}") for j in dims))
        gap = lambda j: F.greatest(F.lit(0.0), F.col(f"al{j}") - F.col(f"bh{j}"), F.col(f"bl{j}") - F.col(f"ah{j}"))
        far = sum((gap(j) * gap(j) for j in dims[1:]), gap(0) * gap(0))
        pairs = pairs.join(x, "a").join(y, "b").where((F.col("ka") <= F.col("kb")) & (far <= (eps + 1e-9) ** 2)).select(F.col("ka").alias("a"), F.col("kb").alias("b"))
        pairs = scratch.save(pairs, "pairs")
    return blocks.select("block", "ids", "weights", "raw"), pairs


def skipped(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(dim, blocks, pairs, compared): of each vector length the blocks, all pairs of them, and those that aren't skipped."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    _, classes, number = _classes(vectors, vec_id, embedding, scratch)
    out = []
    for row in classes.select("dim").distinct().orderBy("dim").collect():
        blocks, pairs = block_pairs(classes.where(F.col("dim") == row.dim), row.dim, number, cosine, scratch)
        n = blocks.count()
        out.append((row.dim, n, n * (n + 1) // 2, pairs.count()))
    return vectors.sparkSession.createDataFrame(out, "dim long, blocks long, pairs long, compared long")


def spark_frame(like: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    return like.sparkSession.createDataFrame(pd.DataFrame(offsets, columns=["part", "offset"]))


def _compare(sides: pa.Table, wanted: pa.Table, dim: int, number: str, cosine: float) -> pa.Table:
    """Rows (0, id, weighted number of links) and (1, id, smallest id that the tile's links lead to)."""
    ids, weight, unit, at, n = [], [], {}, {}, 0
    for r in sides.sort_by("block").to_pylist():
        ids.append(np.frombuffer(r["ids"], np.int64))
        weight.append(np.frombuffer(r["weights"], np.int64))
        unit[r["block"]] = _scaled(_vectors([r["raw"]], dim, number))
        at[r["block"]] = slice(n, n + len(ids[-1]))
        n += len(ids[-1])
    ids, weight = np.concatenate(ids), np.concatenate(weight)
    many, low, links = np.zeros(n, np.int64), np.arange(n), []
    for a, b in zip(wanted.column("a").to_pylist(), wanted.column("b").to_pylist(), strict=True):
        near = unit[a] @ unit[b].T >= cosine
        if a == b:
            np.fill_diagonal(near, False)
            near |= near.T
        if not near.any():
            continue
        many[at[a]] += near @ weight[at[b]]
        if a != b:
            many[at[b]] += weight[at[a]] @ near
        links.append((at[a], at[b], near))
    # The least place that links lead to, until nothing changes.
    changed = True
    while changed:
        before = low.copy()
        for a, b, near in links:
            low[a] = np.minimum(low[a], np.where(near, low[b], n).min(1))
            low[b] = np.minimum(low[b], np.where(near.T, low[a], n).min(1))
        low = low[low]
        changed = bool((low != before).any())
    some, led = np.flatnonzero(many), np.flatnonzero(low != np.arange(n))
    kinds = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(led), np.int32)])
    return pa.table({"kind": pa.array(kinds), "x": pa.array(np.concatenate([ids[some], ids[led]])), "y": pa.array(np.concatenate([many[some], ids[low[led]]]))})
