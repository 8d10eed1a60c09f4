"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a few dozen statistics of its bytes, words and lines.  Random
Fourier features approximate a Gaussian kernel over the standardised
statistics; each partition sums its part of the normal equations, the driver
solves one small system, and pooled adjacent violators over a fixed number of
score bins turn ridge scores into probabilities.

Scale: one narrow pass; a slice of texts takes some 30 bytes a text byte for a
moment, a very long text as much for itself.

Defined results: a null text counts as an empty one and is scored like it; a
null doc_id is never a training row and is not held out; rows repeated in
``docs`` are each scored; ids with several labels train once per label row;
rows with a null label are ignored; without labelled rows every score is the
prior ``0.5``; an empty table gives an empty result; other columns pass through
untouched and may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, Scratch, held_out, slices, string_buffers, words

#: Columns of the feature matrix.
N_STATS = 30


def _per_doc(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[ptr[1:]] - total[ptr[:-1]]


def _runs(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its distinct entries, and the count of its commonest one."""
    n = len(ptr) - 1
    distinct, top = np.zeros(n), np.zeros(n)
    for i in range(n):
        seg = h[ptr[i] : ptr[i + 1]]
        if len(seg):
            s = np.sort(seg)
            at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            distinct[i], top[i] = len(at) - 1, np.diff(at).max()
    return distinct, top


def statistics(arr: pa.Array) -> np.ndarray:
    """One row of N_STATS numbers for each text of the column, bounded for any length."""
    data, offs = string_buffers(arr)
    w = words(arr, SPACED, lower=True)
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    count = np.diff(w.ptr).astype(float)
    safe, one = np.maximum(count, 1), np.maximum(size, 1)
    length = (w.end - w.start).astype(float)
    mean_len = _per_doc(length, w.ptr) / safe
    var_len = np.maximum(_per_doc(length**2, w.ptr) / safe - mean_len**2, 0)

    def share(mask: np.ndarray) -> np.ndarray:
        return _per_doc(mask[data], offs) / one

    def of(chars: bytes) -> np.ndarray:
        m = np.zeros(256)
        m[list(chars)] = 1
        return m

    upper = share(of(bytes(range(0x41, 0x5B))))
    lower = share(of(bytes(range(0x61, 0x7B))))
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    first = data[w.start] if len(w.start) else np.zeros(0, np.uint8)
    punct = of(bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum()))
    lines = _per_doc(of(b"\n")[data], offs) + (size > 0)
    distinct, top = _runs(w.hash, w.ptr)
    doc = np.repeat(np.arange(n), np.diff(w.ptr))
    same = np.zeros(len(w.hash))
    if len(w.hash) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    hist = np.bincount(np.repeat(np.arange(n), np.diff(offs)) * 256 + data, minlength=n * 256).reshape(n, 256) / one[:, None]
    entropy = -(hist * np.log(np.maximum(hist, 1e-12))).sum(1)
    out = np.stack(
        [
            np.log1p(size), np.log1p(count), np.minimum(mean_len, 40), np.minimum(np.sqrt(var_len), 40),
            upper, lower, upper / np.maximum(upper + lower, 1e-9), share(of(b"0123456789")), share(punct),
            share(of(b".,")), share(of(b"!")), share(of(b"?")), share(of(b"|")), share(of(b"%&$#*")), share(of(b"<>{}[]()=/;_")), share(of(b"'\"-:")),
            share((np.arange(256) >= 0x80).astype(float)), share(of(b" \t\r\x0b\x0c\n")), np.log1p(lines), np.log1p(one / np.maximum(lines, 1)),
            distinct / safe, np.log1p(distinct) / np.log1p(safe + 1), top / safe, _per_doc(same, w.ptr) / safe,
            _per_doc(punct[last], w.ptr) / safe, _per_doc(((first >= 0x41) & (first < 0x5B)).astype(float), w.ptr) / safe,
            _per_doc((length <= 3).astype(float), w.ptr) / safe, _per_doc((length >= 15).astype(float), w.ptr) / safe, _per_doc((length == 1).astype(float), w.ptr) / safe,
            entropy,
        ],
        axis=1,
    )
    return out


@dataclass
class QualityModel:
    """A fitted classifier; small and of fixed size whatever it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def expand(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.freq + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.hstack([np.ones((len(z), 1)), z, waves])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights if self.weights is not None else np.zeros(len(stats))

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats), self.knots, self.values)


def isotonic(centres: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; returns block centres and their rising rates."""
    blocks: list[list[float]] = []
    for c, p, m in zip(centres, pos, n, strict=True):
        if not m:
            continue
        blocks.append([c * m, p, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], x, strict=True)]
    b = np.array(blocks, float).reshape(-1, 3)
    rate = (b[:, 1] + 0.5) / (b[:, 2] + 1.0)
    return b[:, 0] / b[:, 2], np.maximum.accumulate(rate)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(statistics(b.column("text")))], ["doc_id", "stats"])


def _lists(stats: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, N_STATS), pa.int32()), pa.array(stats.ravel()))


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for each row, computed in one narrow pass over whole texts."""
    return docs.select("doc_id", "text").mapInArrow(_features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<double>")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", scratch: Scratch | None = None, waves: int = 256, ridge: float = 1e-3, max_rows: int = 400_000, bins: int = 512, parts: int = 16, seed: int = 11) -> QualityModel:
    """Fit on labelled rows that aren't held out.

    ``max_rows`` bounds the labelled rows that are used (a hash of doc_id picks
    them); ``parts`` is the number of partial sums the driver adds up.  Rows
    with crc32 mod 5 = 4 calibrate, the others fit the ridge weights.
    """
    scratch = scratch or Scratch(stats.sparkSession, "quality")
    lab = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y is not null and doc_id is not null").where(~held_out("doc_id"))
    rows = stats.join(lab, "doc_id").withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5)
    n = lab.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    rows = scratch.save(rows.select("stats", "y", "fold").repartition(parts), "labelled")
    sums = rows.select("y", "fold", *(F.col("stats")[i].alias(f"s{i}") for i in range(N_STATS)))
    got = sums.agg(F.count("y"), *(F.avg(f"s{i}") for i in range(N_STATS)), *(F.stddev_pop(f"s{i}") for i in range(N_STATS))).first()
    rng = np.random.default_rng(seed)
    if not got[0]:
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS), np.zeros((N_STATS, 1)), np.zeros(1), None, np.zeros(1), np.full(1, 0.5))
    mean = np.array(got[1 : 1 + N_STATS], float)
    scale = np.maximum(np.array(got[1 + N_STATS :], float), 1e-6)
    # The kernel's width is the usual one for standardised inputs: squared distances are about twice the dimension.
    freq = rng.normal(size=(N_STATS, waves)) / np.sqrt(N_STATS / 2.0)
    model = QualityModel(mean, scale, freq, rng.uniform(0, 2 * np.pi, waves), None, np.zeros(1), np.zeros(1))
    d = 1 + N_STATS + waves

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            x, y = model.expand(_matrix(batch)), batch.column("y").to_numpy()
            a += x.T @ x
            b += x.T @ y
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "b": [b.tobytes()]})

    fits = rows.where("fold <> 4") if rows.where("fold <> 4").select("y").distinct().count() > 1 else rows
    parts_ = fits.mapInArrow(normal, "a binary, b binary").collect()
    a = sum(np.frombuffer(r.a).reshape(d, d) for r in parts_)
    b = sum(np.frombuffer(r.b) for r in parts_)
    reg = np.eye(d) * ridge * max(a[0, 0], 1)
    reg[0, 0] = 0
    model.weights = np.linalg.solve(a + reg + np.eye(d) * 1e-9, b)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = model.raw(_matrix(batch))
            k = np.clip(((r + 0.5) / 2 * bins).astype(np.int64), 0, bins - 1)
            yield pa.RecordBatch.from_pydict({"bin": k, "y": batch.column("y").to_numpy()})

    cal = rows.where("fold = 4")
    cal = cal if cal.select("y").distinct().count() > 1 else rows
    hist = cal.mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("pos"), F.count("y").alias("n")).orderBy("bin").collect()
    centres = np.array([(r.bin + 0.5) / bins * 2 - 0.5 for r in hist])
    model.knots, model.values = isotonic(centres, np.array([r.pos for r in hist], float), np.array([r.n for r in hist], float))
    scratch.drop(rows)
    return model


def score(stats: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``features(docs)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b)))], ["doc_id", "score"])

    out = stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Fit on ``labels`` and score every row of ``docs``; texts are read once."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(features(docs), "stats")
    return score(stats, fit(stats, labels, label, scratch), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    Rows are written once with their statistics, which are fitted on and scored
    from there; texts aren't looked at again.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    tag = f"__stats_{uuid.uuid4().hex}"
    base = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(statistics(b.column("text")))], [*b.schema.names, tag])

    held = scratch.save(docs.mapInArrow(run, T.StructType([*base.fields, T.StructField(tag, T.ArrayType(T.DoubleType()))])), "held")
    model = fit(held.select("doc_id", F.col(tag).alias("stats")), labels, label, scratch)

    @F.pandas_udf("boolean")
    def good(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_list())) >= threshold if len(stats) else [], dtype=bool)

    return held.where(good(F.col(tag))).drop(tag)
