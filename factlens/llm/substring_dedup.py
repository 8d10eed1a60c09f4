r"""Removal of repeated passages by Rabin-Karp hashes of every fixed-length word window.

Words are ``[^\x20\x09-\x0D]+``, unchanged.  A window is ``window`` consecutive
words of one document.  Rolling hashes of all windows are counted in Spark; a
window that also starts in a document of a smaller doc_id is removed, and
overlapping removed windows merge into maximal intervals.

Scale: equal word sequences are recognised by a fingerprint first: but for the
smallest id they go whole, and only that one takes part further.  Shuffling a
row for each window of the corpus would cost several times the input, so
windows that can't repeat are told apart before: two equal windows have the
same minimum among the hashes of their half-length sub-windows, thus a window
whose minimum occurs in one document only is unique.  Minima are about one for
13 words.  The minima found in several documents go to executors as a bitmap
of fixed size (false positives cost a shuffled row, nothing is lost).  Counting
is a grouped minimum with map-side combining, and hot windows meet the rest in
a plain join that adaptive execution splits.

Windows are compared by 64-bit polynomial hashes of word hashes, modulo 2**64
and mixed at the end: two different ones agree with probability 2**-64 as far as
word hashes are random (the base is odd and fixed, so texts made to collide
could).

Defined results: a null text has no words; texts shorter than a window lose
nothing unless they repeat inside no window (equal short texts all stay); a
very long text is cut whole; ids may be of any type, and a smaller one is one that Spark sorts first; a
null doc_id is never removed from and removes nothing; rows that repeat a
doc_id are judged each by its own text and don't remove from one another; an
empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import SPACED, Scratch, Words, gram_windows, mix, signed, slices, string_buffers, words


#: The name of a hash of doc_id, which may be of any type, for bitmaps.
ID_KEY = "id_key"


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive entries, by doubling."""
    span, out = 1, x
    while span * 2 <= k:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = k - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def window_hashes(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in the slice, hash, minimum of sub-window hashes) of each window."""
    n = len(w.hash)
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
    half = max(1, window // 2)
    low = _sliding_min(gram_windows(w.hash, half), window - half + 1)
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    return doc[at], at, gram_windows(w.hash, window)[at], low[at]


def _fingerprints(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit polynomial fingerprints of each text's word sequence."""
    n = len(w.ptr) - 1
    out = []
    place = (np.arange(len(w.hash)) - np.repeat(w.ptr[:-1], np.diff(w.ptr))).astype(np.uint64)
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(w.hash ^ mix(place * np.uint64(2) + np.uint64(salt))), dtype=np.uint64)))
        out.append(mix(total[w.ptr[1:]] - total[w.ptr[:-1]]) if n else np.zeros(0, np.uint64))
    return out[0], out[1]


def _joined(raw: bytes) -> bytes:
    return b" ".join(raw.split())


def _survey(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            text = b.column("text")
            w = words(text, SPACED)
            f1, f2 = _fingerprints(w)
            doc, _, _, low = window_hashes(w, window)
            new = np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))) if len(low) else np.zeros(0, bool)
            doc, low = doc[new], low[new]
            ptr = np.searchsorted(doc, np.arange(b.num_rows + 1))
            data, offs = string_buffers(text)
            sha = [hashlib.sha256(_joined(data[s:e].tobytes())).hexdigest() for s, e in zip(offs[:-1], offs[1:], strict=True)]
            anchors = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(signed(low)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(w.ptr).astype(np.int64)), pa.array(signed(f1)), pa.array(signed(f2)), pa.array(sha, pa.string()), anchors], ["doc_id", "n_words", "f1", "f2", "whole_sha256", "anchors"])

    return run


def _id_keys(b: pa.RecordBatch) -> np.ndarray:
    return b.column(ID_KEY).to_numpy().view(np.uint64)


def _candidates(window: int, hot, first):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            b = b.filter(pa.array(bitmap.maybe(first.value, _id_keys(b))))
            w = words(b.column("text"), SPACED)
            doc, _, h, low = window_hashes(w, window)
            pick = bitmap.maybe(hot.value, low)
            doc, h = doc[pick], h[pick]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), b.column("doc_id").take(pa.array(doc))], ["hash", "doc_id"])

    return run


def _affected(ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bitmap.maybe(ids.value, _id_keys(b)))).select(["doc_id", "text"])

    return run


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            text = b.column("text")
            w = words(text, SPACED)
            f1, f2 = _fingerprints(w)
            doc, at, h, _ = window_hashes(w, window)
            h = signed(h)
            removed = np.zeros(len(w.hash) + 1, np.int64)
            gone = b.column("gone")
            goff, gval = gone.offsets.to_numpy(), gone.values.to_numpy(zero_copy_only=False)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            n_removed, sha, kept_text, spans = [], [], [], []
            for i in range(b.num_rows):
                own = slice(cut[i], cut[i + 1])
                bad = at[own][np.isin(h[own], gval[goff[i] : goff[i + 1]])]
                removed[bad] += 1
                removed[bad + window] -= 1
            mask = np.cumsum(removed)[:-1] > 0
            for i in range(b.num_rows):
                own = slice(w.ptr[i], w.ptr[i + 1])
                keep = np.flatnonzero(~mask[own]) + w.ptr[i]
                out = b" ".join(w.data[w.start[k] : w.end[k]].tobytes() for k in keep)
                n_removed.append(int(mask[own].sum()))
                sha.append(hashlib.sha256(out).hexdigest())
                kept_text.append(out.decode("utf-8", "replace"))
                spans.append([{"start": s, "end": e} for s, e in intervals(mask[own])])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(w.ptr).astype(np.int64)), pa.array(signed(f1)), pa.array(signed(f2)), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "f1", "f2", "n_removed", "kept_sha256", "kept_text", "removed"],
            )

    return run


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs``."""
    out, _ = _judged(docs, window)
    return out


def removal_intervals(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, kept_text and the maximal removed intervals (in words) of the rows that keep a part."""
    _, cut = _judged(docs, window)
    return cut.where("n_removed > 0").select("doc_id", "n_words", "kept_text", "removed")


def _judged(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession, "substring")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    seen = scratch.save(texts.mapInArrow(_survey(window), f"doc_id {kind}, n_words long, f1 long, f2 long, whole_sha256 string, anchors array<long>"), "survey")
    key = ["f1", "f2", "n_words"]
    real = seen.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    first = scratch.save(real.groupBy(*key).agg(F.min("doc_id").alias("first_id")), "first")
    # Minima that two different sequences share.
    firsts = real.join(first.withColumnRenamed("first_id", "doc_id"), [*key, "doc_id"])
    shared = firsts.select("doc_id", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    hot = bitmap.build(shared, "anchor")
    some = bitmap.build(first.select(F.xxhash64("first_id").alias(ID_KEY)), ID_KEY)
    keyed = texts.where("doc_id is not null").withColumn(ID_KEY, F.xxhash64("doc_id"))
    rows = keyed.mapInArrow(_candidates(window, hot, some), f"hash long, doc_id {kind}")
    rows = scratch.save(rows, "windows")
    counted = rows.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash", "lo")
    counted = scratch.save(counted, "counted")
    gone = rows.join(counted, "hash").where("doc_id > lo").groupBy("doc_id").agg(F.collect_set("hash").alias("gone"))
    gone = scratch.save(gone, "gone")
    scratch.drop(rows, counted)
    # Written, so that nothing above the join keeps adaptive execution from splitting a large group of copies.
    named = scratch.save(seen.drop("anchors").join(first, key, "left").withColumn("copy", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))), "named")
    copies = named.where("copy")
    ids = bitmap.build(gone.select(F.xxhash64("doc_id").alias(ID_KEY)), ID_KEY)
    whole = keyed.mapInArrow(_affected(ids), texts.schema).join(gone, "doc_id")
    cut = whole.mapInArrow(_cut(window), f"doc_id {kind}, n_words long, f1 long, f2 long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:long,end:long>>")
    cut = cut.join(copies.select("doc_id", *key).distinct(), ["doc_id", *key], "left_anti")
    none = hashlib.sha256(b"").hexdigest()
    plain = named.where("not copy").join(gone.select("doc_id"), "doc_id", "left_anti")
    out = plain.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"))
    out = out.unionByName(copies.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(none).alias("kept_sha256")))
    return out.unionByName(cut.select("doc_id", "n_words", "n_removed", "kept_sha256")), cut
