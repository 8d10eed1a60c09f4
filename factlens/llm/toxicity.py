r"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.  Document
frequencies in toxic and clean labelled texts, with a Dirichlet prior from the
frequencies in the whole corpus, give each token a log-odds; its lower
confidence bound, less a margin, is its score, and any other token costs
``COST``.  Word stems (the first 4 and 6 bytes) are counted beside whole tokens,
so that inflected forms share their evidence; a token scores the best of the
three, in steps of ``STEP``.  A linear scan (Ruzzo and Tompa) finds all maximal
segments.  By the extreme-value law of maximal segments a text of n tokens has
K n exp(-lambda S) segments of score S by chance; lambda and K are solved from the
scores that tokens have in clean labelled texts that the lexicon wasn't made from
(Karlin and Altschul).  What
these E-values fall below 1, as logarithms summed over a document's segments,
passes through a one-variable logistic fit.

Scale: labelled rows are copied out once, of ``max_rows`` ids at most; the model
is fitted on these.  All tokens of the toxic ones among them take part, so their
number is bounded by the sample, and so is what is broadcast and collected.  One
narrow pass counts those tokens in all documents (summed within each task before
the shuffle), one scores them; nothing of either is written but the result.

Defined results: a null text counts as empty; a text without tokens has no
evidence and the lowest score; a very long text is scored whole; ids may be of
any type; a null doc_id is never a training row; an id with several labels counts
as toxic if any is 1, and each of its rows trains; null labels are ignored;
without labels of both kinds every score is 0; rows repeated in ``docs`` are each
scored; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Scratch, Words, held_out, prefix_hashes, signed, slices, words

#: What a token outside the lexicon takes off a segment.
COST = 0.15
#: Bytes of the stems that are counted beside a token.
STEMS = (4, 6)
#: Scores are multiples of it (and so is COST): the extreme-value law is solved on this lattice.
STEP = 0.05


@dataclass
class ToxicModel:
    """Sorted token hashes and their scores, the extreme-value constants, and the logistic fit."""

    tokens: np.ndarray
    scores: np.ndarray
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -1e9
    known: bool = field(default=False)


def maximal_segments(at: list[int], score: list[float], cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score); ``at`` are the places of positive scores, all others cost ``cost``.

    Ruzzo and Tompa's algorithm, on runs: each candidate keeps the cumulative
    scores before its start (left) and at its end (right).
    """
    found: list[list[float]] = []  # start, end, left, right
    total, last = 0.0, -1
    for p, s in zip(at, score, strict=True):
        left = total - cost * (p - last - 1)
        right = left + s
        total, last = right, p
        cur = [p, p + 1, left, right]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j -= 1
            if j < 0 or found[j][3] >= cur[3]:
                found.append(cur)
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3]]
            del found[j:]
    return [(int(a), int(b), r - le) for a, b, le, r in found]


def _hashes(w: Words) -> tuple[np.ndarray, ...]:
    return (w.hash, *(prefix_hashes(w, k) for k in STEMS))


def _place(sorted_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each hash is in the sorted ones, whether it is)."""
    k = np.searchsorted(sorted_, h)
    k[k == len(sorted_)] = 0
    return k, sorted_[k] == h if len(sorted_) else np.zeros(len(h), bool)


def _token_scores(w: Words, model: ToxicModel) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the lexicon's tokens in the slice."""
    best = np.zeros(len(w.hash))
    if len(model.tokens):
        for h in _hashes(w):
            k, ok = _place(model.tokens, h)
            best = np.maximum(best, np.where(ok, model.scores[k], 0))
    at = np.flatnonzero(best)
    return at, best[at]


def _segments_of(arr: pa.Array, model: ToxicModel) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(text, its number of tokens, its segments) for texts that have any."""
    w = words(arr, ALNUM, lower=True)
    at, s = _token_scores(w, model)
    doc = np.searchsorted(w.ptr, at, side="right") - 1
    if not len(doc):
        return
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    for a, b in zip(cut, [*cut[1:], len(doc)], strict=True):
        d = int(doc[a])
        yield d, int(w.ptr[d + 1] - w.ptr[d]), maximal_segments((at[a:b] - w.ptr[d]).tolist(), s[a:b].tolist())


def extreme_value(score: np.ndarray, p: np.ndarray, cost: float = COST) -> tuple[float, float]:
    """(lambda, ln K) of maximal segments in sequences whose tokens have ``score`` with probability ``p``, else -cost.

    lambda is the positive root of E[exp(lambda X)] = 1; K comes from the random
    walk's partial sums (Karlin and Altschul's lattice form).  Where the mean is
    not below 0, so that there is no root, lambda is 0: no segment is significant.
    """
    x = np.concatenate([np.round(score / STEP), [-round(cost / STEP)]]).astype(np.int64)
    q = np.concatenate([p, [max(1 - p.sum(), 0)]])
    if not (x[q > 0] > 0).any():
        return 1.0, 0.0
    if (q * x).sum() >= 0:
        return 0.0, 0.0
    f = lambda r: float((q * np.exp(np.minimum(r * x, 700))).sum() - 1)
    low, high = 0.0, 1e-6
    while f(high) <= 0:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) <= 0 else (low, mid)
    lam = high
    # sigma = sum over k of (P(S_k >= 0) + E[exp(lambda S_k); S_k < 0]) / k.
    bottom, top = int(x.min()), int(x.max())
    one = np.zeros(top - bottom + 1)
    np.add.at(one, x - bottom, q)
    dist, least, sigma = one, bottom, 0.0
    for k in range(1, 401):
        s = np.arange(least, least + len(dist))
        term = float(dist[s >= 0].sum() + (dist[s < 0] * np.exp(lam * s[s < 0])).sum()) / k
        sigma += term
        if term < 1e-9:
            break
        dist, least = np.convolve(dist, one), least + bottom
        live = np.flatnonzero(dist > 1e-14)
        dist, least = dist[live[0] : live[-1] + 1], least + int(live[0])
    span = int(np.gcd.reduce(np.abs(x[q > 0])))
    entropy = lam * float((q * x * np.exp(lam * x)).sum())
    k = lam * span * np.exp(-2 * sigma) / (entropy * (1 - np.exp(-lam * span)))
    return lam / STEP, float(np.log(k))


def labelled_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "toxic", max_rows: int = 50_000) -> DataFrame:
    """(doc_id, text, y, learnt) of rows that aren't held out, of ``max_rows`` ids at most, picked by hash.

    The lexicon is made from ``learnt`` rows (crc32 mod 5 in 1, 2, 3); the others calibrate.
    """
    lab = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    lab = lab.groupBy("doc_id").agg((F.max("y") > 0).alias("y"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    lab = lab.where(fold != 0).select("doc_id", "y", (fold < 4).alias("learnt"))
    n = lab.count()
    if n > max_rows:
        # The bound leaves room for the hash's spread.
        lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(0.95 * max_rows / n * (1 << 20))).limit(max_rows)
    return scratch.save(docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("doc_id", "text", "y", "learnt"), "labelled")


def fit_lexicon(docs: DataFrame, sample: DataFrame, strength: float = 20.0, sigmas: float = 1.5, margin: float = 1.0) -> ToxicModel:
    """Token scores from the learnt rows of ``labelled_rows`` and all texts' frequencies; the law from clean rows apart."""
    spark = docs.sparkSession
    learnt = sample.where("learnt")
    size = {r.y: r.n for r in learnt.groupBy("y").agg(F.count("*").alias("n")).collect()}
    none = ToxicModel(np.zeros(0, np.uint64), np.zeros(0))
    if not size.get(True) or not size.get(False):
        return none

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"), ALNUM, lower=True)
            y = b.column("y").to_numpy(zero_copy_only=False)
            for want in (True, False):
                doc, h = _distinct(w, y == want)
                own, n = np.unique(h, return_counts=True)
                bad = n if want else np.zeros(len(own), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(own)), pa.array(bad), pa.array(n - bad)], ["token", "bad", "good"])

    seen = learnt.mapInArrow(tokens, "token long, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    got = seen.where("bad > 0").toPandas()  # a token in no toxic text can't score above 0
    got = got.assign(h=got["token"].to_numpy(np.int64).view(np.uint64)).sort_values("h")
    lexicon, bad, good = got["h"].to_numpy(), got["bad"].to_numpy(float), got["good"].to_numpy(float)
    sent = spark.sparkContext.broadcast(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(len(sent.value), np.int64), 0
        for b in slices(batches, "text"):
            rows += b.num_rows
            _, h = _distinct(words(b.column("text"), ALNUM, lower=True), np.ones(b.num_rows, bool), sent.value)
            held += np.bincount(h, minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1]])), pa.array(np.concatenate([held[at], [rows]]))], ["place", "n"])

    every = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    freq, total = np.zeros(len(lexicon)), float(every.loc[every["place"] < 0, "n"].sum())
    every = every[every["place"] >= 0]
    freq[every["place"].to_numpy()] = every["n"].to_numpy()
    prior = 0.5 + strength * freq / total
    odds = lambda k, n: np.log((k + prior) / (n + strength - k))
    delta = odds(bad, size[True]) - odds(good, size[False])
    score = delta - sigmas * np.sqrt(1 / (bad + prior) + 1 / (good + prior)) - margin
    score = np.floor(score / STEP) * STEP
    up = score > 0
    model = ToxicModel(lexicon[up], score[up], known=True)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"), ALNUM, lower=True)
            step, n = np.unique(np.round(_token_scores(w, model)[1] / STEP).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([step, [0]])), pa.array(np.concatenate([n, [len(w.hash) - n.sum()]]))], ["step", "n"])

    apart = sample.where("not y and not learnt")
    if apart.isEmpty():
        apart = sample.where("not y")
    clean = {r.step: r.n for r in apart.mapInArrow(spread, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()}
    # One occurrence is added, shared out as the lexicon's scores are: what wasn't seen is rare, not impossible.
    steps, own = np.unique(np.round(model.scores / STEP).astype(np.int64), return_counts=True)
    if len(steps):
        p = np.array([clean.get(k, 0) for k in steps.tolist()], float) + own / own.sum()
        model.lam, model.log_k = extreme_value(steps * STEP, p / (sum(clean.values()) + 1))
    return model


def _distinct(w: Words, rows: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) of each text's distinct tokens and stems; ``within`` sorted ones, as places in them."""
    doc = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
    ds, hs = [], []
    for h in _hashes(w):
        ok = (h != 0) & rows[doc]
        if within is not None:
            h, has = _place(within, h)
            ok &= has
        ds.append(doc[ok])
        hs.append(h[ok])
    d, h = np.concatenate(ds), np.concatenate(hs)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def evidence(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, n, segments) for each row: its tokens, and the score of each maximal segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            size, found = np.zeros(b.num_rows, np.int64), [[]] * b.num_rows
            for d, n, segs in _segments_of(b.column("text"), model):
                size[d], found[d] = n, [s for _, _, s in segs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "n", "segments"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, segments array<double>")


def _summed(model: ToxicModel) -> F.Column:
    """ln(1 + the sum of minus the log of the segments' E-values, where those are below 1)."""
    none = model.log_k + F.log(F.greatest(F.col("n"), F.lit(1)))
    return F.log1p(F.aggregate("segments", F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), model.lam * x - none)))


def logistic(x: np.ndarray, pos: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a binned one-variable logistic fit (Newton steps with a little ridge)."""
    w = np.array([0.0, np.log((pos.sum() + 0.5) / (n.sum() - pos.sum() + 0.5))])
    a = np.column_stack([x, np.ones(len(x))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (pos - n * p) - ridge * w
        h = (a * (n * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def calibrate(sample: DataFrame, model: ToxicModel, bins: int = 50) -> ToxicModel:
    """Fit the logistic step on rows apart from the learnt ones (on all, if those have one kind only), from counts in ``bins`` bins a unit.

    The sum is a logarithm, so bins are few.
    """
    found = evidence(sample.withColumn("doc_id", F.struct("y", "learnt")), model)
    for want in (~F.col("doc_id.learnt"), F.lit(True)):
        hist = found.where(want).groupBy(F.floor(_summed(model) * bins).alias("bin")).agg(F.sum(F.col("doc_id.y").cast("int")).alias("pos"), F.count("*").alias("n")).orderBy("bin").collect()
        pos, n = np.array([r.pos for r in hist], float), np.array([r.n for r in hist], float)
        if len(hist) and 0 < pos.sum() < n.sum():
            model.slope, model.offset = logistic(np.array([r.bin for r in hist], float) / bins, pos, n)
            break
    return model


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 50_000) -> ToxicModel:
    """The model fitted on ``labels`` but for held-out ids."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labelled_rows(docs, labels, scratch, label, max_rows)
    model = calibrate(sample, fit_lexicon(docs, sample))
    scratch.drop(sample)
    return model


def score(found: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    x = _summed(model) * model.slope + model.offset
    p = F.when(x > -700, 1 / (1 + F.exp(-x))).otherwise(0.0) if model.known else F.lit(0.0)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), p.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; fitted on ``labels`` but for held-out ids."""
    model = fitted(docs, labels, label)
    return score(evidence(docs, model), model, threshold)


def toxic_spans(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, start, end, segment_score, e_value) of every significant passage, in tokens, whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [(d, s, e, x, float(np.exp(np.log(max(n, 1)) + model.log_k - model.lam * x))) for d, n, segs in _segments_of(b.column("text"), model) for s, e, x in segs]
            rows = [r for r in rows if r[4] < 1]
            ids = b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64())))], ["doc_id", "start", "end", "segment_score", "e_value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, end long, segment_score double, e_value double")
