r"""Near-duplicate documents by min-max hashing.

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; a document's set is its
distinct word shingles.  Under each of ``PERMS`` permutations both the minimum
and the maximum are kept, so half as many hash evaluations give a signature of
the same length.  Bands of ``ROWS`` values (each from another permutation)
propose candidates; every link is confirmed on the full sets.

Scale: documents with equal sets collapse into one class first, so copies cost
one grouped minimum.  Within a band bucket no all-pairs list is made: members
are compared with a few leaders of the bucket, what is linked is contracted,
and only members that are still in different components are paired (a large
bucket in parts of some ``PART`` members, each against all), after the exact bounds of set sizes and of distances to the leaders (the Jaccard distance
is a metric) and a signature bound have removed what can't be linked.

A pair of similarity 0.8 shares no band with probability
(1 - 0.8**ROWS)**BANDS, about 5e-7; more similar pairs still less.

A very long text is one row of its shingles' hashes (8 bytes each) once it is a
candidate.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text of fewer words than a shingle has its whole
sequence as the one element; a null doc_id is kept, in no component (null); the
same doc_id in several rows gives one result row for each, each row's set takes
part, and they share the id's component; an empty table gives an empty result;
other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Scratch, components, grams, mix, signed, slices, words

ROWS, BANDS = 6, 48
PERMS = ROWS * BANDS // 2
#: Permutations of the longer sketch, one bit a value, that bounds the similarity of what stays open.
SKETCH_PERMS = 1024
SKETCH_LONGS = 2 * SKETCH_PERMS // 64
#: Members of a part of a bucket whose members are still open.
PART = 4096

_rng = np.random.default_rng(1729)
_MUL = _rng.integers(1, 1 << 63, PERMS + SKETCH_PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, PERMS + SKETCH_PERMS, dtype=np.uint64)


def min_max(x: np.ndarray, ptr: np.ndarray, first: int = 0, perms: int = PERMS) -> np.ndarray:
    """Minimum and maximum of each document's elements under each permutation; rows with elements only."""
    starts = ptr[:-1][np.diff(ptr) > 0]
    out = np.empty((len(starts), 2 * perms), np.uint64)
    for j in range(perms):
        y = x * _MUL[first + j]
        y += _ADD[first + j]
        out[:, j] = np.minimum.reduceat(y, starts)
        out[:, perms + j] = np.maximum.reduceat(y, starts)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """One hash a band: half its values are minima, half maxima, all of different permutations."""
    half = ROWS // 2
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        low = range(half * b, half * (b + 1))
        far = (b + BANDS // 2) % BANDS
        cols = [*low, *(PERMS + c for c in range(half * far, half * (far + 1)))]
        h = np.full(len(sig), (b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for c in cols:
            h = mix(h ^ sig[:, c]) + np.uint64(0x9E3779B97F4A7C15)
        out[:, b] = h
    return out


def sketch(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """One hashed bit of each of 2 * SKETCH_PERMS values, packed: equal values agree, others by chance 1/2."""
    bits = (mix(min_max(x, ptr, PERMS, SKETCH_PERMS)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def distinct_grams(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and where each text's begin."""
    w = words(batch.column("text"), SPACED, lower=True)
    g, ptr = grams(w.hash, w.ptr, k)
    parts, n = [], np.zeros(len(ptr) - 1, np.int64)
    for i in range(len(ptr) - 1):
        seg = g[ptr[i] : ptr[i + 1]]
        if len(seg):
            s = np.sort(seg)
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            parts.append(s)
            n[i] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(n)))


def _list(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(values))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x, ptr = distinct_grams(b, k)
            n = np.diff(ptr)
            has = n > 0
            starts = ptr[:-1][has]
            fp1, fp2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            bands = np.zeros((0, BANDS), np.uint64)
            if len(starts):
                fp1[has] = np.add.reduceat(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                fp2[has] = np.add.reduceat(mix(x + np.uint64(0x0123456789ABCDEF)), starts)
                bands = band_hashes(min_max(x, ptr))
            at = np.concatenate(([0], np.cumsum(has)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), pa.array(signed(fp1)), pa.array(signed(fp2)), _list(signed(bands).ravel(), at * BANDS)],
                ["doc_id", "n", "fp1", "fp2", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x, ptr = distinct_grams(b, k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _list(signed(x), ptr)], ["id", "elements"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            lists = b.column("elements")
            ptr = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
            sk = sketch(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ptr)
            yield pa.RecordBatch.from_arrays([b.column("id"), _list(sk.ravel(), np.arange(len(sk) + 1) * SKETCH_LONGS)], ["id", "sketch"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance, linked) of (a, b) pairs, from their full sets."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b").join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
    both = both.select("a", "b", F.size(F.array_intersect("ea", "eb")).cast("long").alias("inter"), (F.size("ea") + F.size("eb")).cast("long").alias("total"))
    union = F.col("total") - F.col("inter")
    return both.select("a", "b", (1 - F.col("inter") / union).alias("distance"), (100 * F.col("inter") >= percent * union).alias("linked"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, leaders: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their
    shingle sets.  ``component_id`` is the smallest doc_id reachable.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    kind = docs.schema["doc_id"].dataType.simpleString()
    feats = scratch.save(docs.select("doc_id", "text").mapInArrow(_signatures(shingle), f"doc_id {kind}, n long, fp1 long, fp2 long, bands array<long>"), "signatures")
    real = feats.where("n > 0 and doc_id is not null")
    key = ["fp1", "fp2", "n"]
    classes = scratch.save(real.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    member = real.select("doc_id", *key).join(classes, key).select("doc_id", "rep", "n")
    member = scratch.save(member, "members")
    # An id on several rows with different sets ties their classes together.
    again = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    reps = classes.join(feats.select(F.col("doc_id").alias("rep"), *key, "bands"), ["rep", *key]).dropDuplicates(["rep", *key])
    # Two rows of one id may be two classes of one representative; their bands both count.
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    order = [F.col("rep")] + [F.struct(F.xxhash64("rep", F.lit(k)), F.col("rep")) for k in range(1, leaders)]
    hot = rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), *(F.min(o).alias(f"l{k}") for k, o in enumerate(order))).where("lo <> hi")
    hot = scratch.save(hot.select("key", F.col("l0").alias("l0"), *(F.col(f"l{k}")["rep"].alias(f"l{k}") for k in range(1, leaders))), "buckets")
    in_bucket = scratch.save(rows.join(hot, "key"), "bucketed")
    wanted = in_bucket.select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(_sets(shingle), f"id {kind}, elements array<long>")
    sets = scratch.save(sets.join(in_bucket.select(F.col("rep").alias("id"), "n").distinct().withColumnRenamed("n", "size"), "id").where(F.size("elements") == F.col("size")).select("id", "elements"), "sets")
    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    stars = in_bucket.select(F.col("rep").alias("b"), F.explode(F.array_distinct(F.array(*(f"l{k}" for k in range(leaders))))).alias("a")).where("a <> b").distinct()
    tried = scratch.save(_confirm(stars, sets, percent), "stars")
    linked = tried.where("linked").select("a", "b").unionByName(again)
    labels = components(linked, scratch)
    # What is left: buckets that still hold several components.
    shown = in_bucket.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    shown = scratch.save(shown, "shown")
    mixed = shown.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / PART).alias("parts")).where("x <> y").select("key", "parts")
    open_ = shown.join(mixed, "key")
    dist = tried.select(F.col("b").alias("rep"), F.col("a").alias("leader"), "distance")
    for k in range(leaders):
        open_ = open_.join(dist.select("rep", F.col("leader").alias(f"l{k}"), F.col("distance").alias(f"d{k}")), ["rep", f"l{k}"], "left")
        open_ = open_.withColumn(f"d{k}", F.when(F.col("rep") == F.col(f"l{k}"), 0.0).otherwise(F.col(f"d{k}")))
    sharp = scratch.save(sets.join(open_.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").mapInArrow(_sketches, f"id {kind}, sketch array<long>"), "sketches")
    open_ = open_.join(reps.select("rep", "n", "bands"), ["rep", "n"]).join(sharp.withColumnRenamed("id", "rep"), "rep")
    open_ = scratch.save(open_.select("key", "parts", "rep", "n", "component", "bands", *(f"d{k}" for k in range(leaders)), *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_LONGS))), "open")
    bits = SKETCH_LONGS * 64
    # Bits differ with probability (1 - similarity) / 2; the bound lies 5.5 deviations out.
    p = (1 - percent / 100) / 2
    most = int(bits * p + 5.5 * (bits * p * (1 - p)) ** 0.5)
    a = open_.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("p")
    b = open_.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("q")
    col = lambda side, name: F.col(f"{side}.{name}")
    differ = sum((F.bit_count(col("p", f"s{i}").bitwiseXOR(col("q", f"s{i}"))) for i in range(1, SKETCH_LONGS)), F.bit_count(col("p", "s0").bitwiseXOR(col("q", "s0"))))
    apart = [F.coalesce(F.abs(col("p", f"d{k}") - col("q", f"d{k}")) <= 1 - percent / 100 + 1e-9, F.lit(True)) for k in range(leaders)]
    cond = (col("p", "key") == col("q", "key")) & (col("p", "part") == col("q", "part")) & (col("p", "rep") < col("q", "rep")) & (col("p", "component") != col("q", "component")) & near(col("p", "n"), col("q", "n"))
    for x in apart:
        cond = cond & x
    # A pair that shares several buckets is made in the first of them only.
    cond = cond & (differ <= most) & (F.element_at(F.array_intersect(col("p", "bands"), col("q", "bands")), 1) == col("p", "key"))
    rest = a.join(b, cond).select(col("p", "rep").alias("a"), col("q", "rep").alias("b")).distinct()
    rest = rest.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    more = scratch.save(_confirm(rest, sets, percent).where("linked").select("a", "b"), "more")
    if not more.isEmpty():
        labels = components(linked.unionByName(more), scratch)
    found = labels.select(F.col("id").alias("rep"), "component")
    ids = member.select("doc_id", "rep").join(found, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    ids = scratch.save(ids.groupBy("doc_id").agg(F.min("component").alias("component")), "ids")
    sizes = scratch.save(feats.select("doc_id", F.col("n").alias("n_shingles")), "sizes")
    out = sizes.join(ids, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    scratch.drop(sets, shown, open_, tried, in_bucket, hot, classes, member, sharp, more, feats)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: of each component its smallest doc_id stays, with all columns.

    Rows that repeat a doc_id stay or go together.
    """
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")
