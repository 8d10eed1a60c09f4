"""What the corpus operators share: shared-folder tables, vectorised words, components.

Word work runs on the bytes of Arrow string columns.  Word separators are
ASCII in every contract here, and bytes of a multi-byte UTF-8 character are
all >= 0x80, so classing single bytes is exact.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are cut into groups of about this many bytes (a longer text is a group alone).
SLICE_BYTES = 500_000

U64 = np.uint64


# --------------------------------------------------------------- shared tables


def shared_dir(spark: SparkSession) -> str:
    """The session's folder in the checkpoint folder that all executors see.

    It is taken from ``spark.checkpoint.dir``, or from the context's
    checkpoint folder.  Only a local master, where driver and executors are
    one process, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    held = getattr(sc, "_factlens_shared", None)
    if held:
        return held
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = sc._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="factlens-")
    held = sc._factlens_shared = f"{base.rstrip('/')}/factlens-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, held)
    return held


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # the JVM may have gone first
        pass


def files_for(df: DataFrame, least: int) -> int:
    """How many files to write at most: one for each split's worth of what is read, ``least`` for small tables.

    So tasks grow with the input and each does the work of about one split (a
    plan that explodes lists counts for more), while small tables don't become hundreds of files (each a few calls to the
    file system) where a plan has many empty partitions.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if "Generate explode" in plan.toString():
        read *= 16
    return min(max(least, -(-read // max(split, 1))), 1 << 30)


class Scratch:
    """Tables written once into the shared folder; ``drop`` removes one early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: its lineage ends in shared files."""
        df = df.coalesce(files_for(df, 2 * self.spark.sparkContext.defaultParallelism))
        path = f"{shared_dir(self.spark)}/{self.name}-{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)  # texts take a third less than with the default
        out = self.spark.read.schema(df.schema).parquet(path)
        out._factlens_scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_factlens_scratch", None):
                remove_path(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True for rows that no model may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


# ------------------------------------------------------------------ Arrow words


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    n = len(arr)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, whole rows always."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = string_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        del batch, offs
        pa.default_memory_pool().release_unused()


def byte_class(pattern_bytes: Callable[[int], bool]) -> np.ndarray:
    return np.array([pattern_bytes(b) for b in range(256)])


#: Bytes of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
SPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= (b | 0x20) <= 0x7A and (b & 0x40) != 0)

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _VALUES.copy()
_LOWER[0x41:0x5B] = _VALUES[0x61:0x7B]
_powers: dict[str, np.ndarray] = {}

#: Words longer than this are hashed one by one, as power sums are weak on very long inputs.
LONG_WORD = 256


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        m = 1 << (m - 1).bit_length()
        for k, b in (("up", _BASE), ("down", _INV)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@dataclass
class Words:
    """Words of several texts: byte spans, 64-bit hashes, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray


def words(arr: pa.Array, kind: np.ndarray = SPACED, lower: bool = False, hashed: bool = True) -> Words:
    data, offs = string_buffers(arr)
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(offs), np.int64), np.zeros(0, np.uint64))
    inside = kind[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offs[(offs < n)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    ptr = np.searchsorted(start, offs)
    h = np.zeros(0, np.uint64)
    if hashed:
        up, down = powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((_LOWER if lower else _VALUES)[data] * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > LONG_WORD):
            w = data[start[i] : end[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(w.lower() if lower else w, digest_size=8).digest(), "little")
    return Words(data, start, end, ptr, h)


def prefix_hashes(w: Words, k: int) -> np.ndarray:
    """Hashes of the words' first k bytes, lower-cased; 0 for words that aren't longer."""
    at = np.flatnonzero(w.end - w.start > k)
    up, _ = powers(k)
    h = np.full(len(at), k * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for j in range(k):
        h += _LOWER[w.data[w.start[at] + j]] * up[j]
    out = np.zeros(len(w.start), np.uint64)
    out[at] = mix(h)
    return out


def grams(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within a text, and where each text's grams begin.

    A text with fewer words, but not none, has one gram: its whole sequence.
    """
    counts = np.diff(ptr)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    gptr = np.concatenate(([0], np.cumsum(n)))
    total = int(gptr[-1])
    if total == 0:
        return np.zeros(0, np.uint64), gptr
    doc = np.repeat(np.arange(len(counts)), n)
    first = ptr[doc] + (np.arange(total) - gptr[doc])
    have = np.minimum(counts[doc], k)
    out = np.zeros(total, np.uint64)
    for j in range(k):
        at = np.minimum(first + j, len(h) - 1)
        term = mix(out + h[at] + U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        out = np.where(have > j, term, out)
    return out, gptr


def gram_windows(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling (Rabin-Karp) hashes of every k consecutive entries of h, in O(len(h))."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * up[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# ------------------------------------------------------------------- components


def components(edges: DataFrame, scratch: Scratch, jumps: int = 2) -> DataFrame:
    """(id, component): the smallest id reachable over undirected (a, b) edges.

    Each round points every vertex at its smallest neighbour, follows those
    pointers a few times, and contracts the edges; a path shrinks by a factor
    each round, so the rounds are logarithmic.  Only grouped minima, joins and
    distinct are used: no vertex's neighbours meet in one row.
    """
    live = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = scratch.save(live, "edges")
    labels = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(live.select(F.col("b").alias("id"), F.col("a").alias("to")))
        up = both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to"))
        up = scratch.save(up, "up")
        for _ in range(jumps):
            nxt = up.alias("x").join(up.select(F.col("id").alias("to"), F.col("to").alias("top")), "to", "left").select("id", F.coalesce("top", "to").alias("to"))
            nxt = scratch.save(nxt, "up")
            scratch.drop(up)
            up = nxt
        if labels is None:
            labels = up.select("id", F.col("to").alias("component"))
            mine = up
        else:
            new = labels.join(up.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            new = scratch.save(new, "labels")
            scratch.drop(mine)
            labels = mine = new
        left = live.join(up.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(up.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        left = left.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        left = scratch.save(left, "edges")
        scratch.drop(live, *([up] if up is not mine else []))
        live = left
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    return labels
