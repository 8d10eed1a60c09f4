r"""Benchmark decontamination with suffix arrays of the training texts.

Each shard (a few MB of documents) gets a suffix array over its words; every
test suffix's window is found in it by binary search, which yields all places
where it occurs verbatim.  From the first place that no match of the same item
holds yet, the match is extended as far as item and document agree (of several
places in the item the longest): the longest verbatim matches, with their places
in both.  Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.

Scale: documents are read in one narrow pass, without a shuffle.  The test set
is sent to executors in blocks of at most ``BLOCK_WORDS`` words on average, cut
by a hash of the item (its windows take 52 bytes a word, words and indexes some
30 more: 80 MB a block).  With several blocks the documents are numbered and
written once, each block's pass returns numbers and finds only, and those are put
together for each document.  An item of fewer words than the window, but not
none, is one window.

Defined results: a null or empty text has no words, no hits and isn't
contaminated; a very long text is a shard by itself; null or wordless items match
nothing; a null item_id counts as the text 'null'; several texts under one
item_id are all that item's, and places count within each text; repeated rows
each get their own result; empty tables give no hits or an empty result; extra
columns are kept, and may have any name if ``tag`` keeps the new ones apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Scratch, slices, words

#: Words of the test set that are held in memory at once.
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 1_500_000


@dataclass
class Windows:
    """The test set's windows of one length: word numbers, and the text each belongs to."""

    length: int
    ids: np.ndarray
    text: np.ndarray


@dataclass
class TestBlock:
    vocabulary: np.ndarray
    windows: list[Windows]
    #: Of each text: its item, and its words as numbers.
    items: list[str]
    texts: list[np.ndarray]


def test_block(items: list[str], hashes: list[np.ndarray], window: int) -> TestBlock:
    vocab = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    texts = [(np.searchsorted(vocab, h) + 1).astype(np.int32) for h in hashes]
    by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, ids in enumerate(texts):
        if len(ids):
            m = min(window, len(ids))
            by_length.setdefault(m, []).append((np.unique(np.lib.stride_tricks.sliding_window_view(ids, m), axis=0), k))
    out = []
    for m, found in sorted(by_length.items()):
        out.append(Windows(m, np.concatenate([w for w, _ in found]), np.concatenate([np.full(len(w), k, np.int32) for w, k in found])))
    return TestBlock(vocab, out, items, texts)


def numbered(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Each word's number in the test vocabulary, counted from 1; 0 for words that no test has."""
    if not len(vocab):
        return np.zeros(len(h), np.int64)
    at = np.searchsorted(vocab, h)
    at[at == len(vocab)] = 0
    return np.where(vocab[at] == h, at + 1, 0)


class SuffixArray:
    """Suffixes of a number sequence that start with a known word, sorted by their first ``depth`` words."""

    def __init__(self, seq: np.ndarray, top: int, window: int):
        self.bits = max(int(top).bit_length(), 1)
        self.head = max(1, min(62 // self.bits, 8))
        pad = np.zeros(window + 2 * self.head + 2, np.int64)
        self.seq = np.concatenate([seq, pad])
        n = len(seq)
        key = np.zeros(n, np.int64)
        for j in range(self.head):
            key = (key << self.bits) | self.seq[j : j + n]
        start = np.flatnonzero(seq)
        order = start[np.argsort(key[start], kind="stable")]
        depth = self.head
        sorted_key = key[order]
        while depth < window and len(order):
            # Refine by ranks (prefix doubling): places that agree so far share a rank.
            new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
            rank = np.zeros(len(self.seq) + depth, np.int64)
            rank[order] = np.cumsum(new)
            tie = ~(new & np.concatenate((new[1:], [True])))
            at = order[tie]
            r, nxt = rank[at], rank[at + depth]
            again = np.lexsort((nxt, r))
            order[tie] = at[again]
            pair = rank[order] * (len(order) + 1) + rank[order + depth]
            sorted_key = pair
            depth *= 2
        self.order = order
        self.keys = key[order]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ids, the interval of the array whose suffixes begin with it."""
        m = ids.shape[1]
        h = min(m, self.head)
        low = np.zeros(len(ids), np.int64)
        for j in range(h):
            low = (low << self.bits) | ids[:, j]
        shift = self.bits * (self.head - h)
        lo = np.searchsorted(self.keys, low << shift, side="left")
        hi = np.searchsorted(self.keys, ((low + 1) << shift) - 1, side="right")
        if m > self.head:
            live = np.flatnonzero(hi > lo)
            want = ids[live]
            lo[live], hi[live] = self._bound(want, lo[live], hi[live], False), self._bound(want, lo[live], hi[live], True)
        return lo, hi

    def _bound(self, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        cols = np.arange(want.shape[1])
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            have = self.seq[self.order[mid][:, None] + cols]
            differ = have != want[open_]
            first = differ.argmax(1)
            rows = np.arange(len(open_))
            less = differ[rows, first] & (have[rows, first] < want[open_][rows, first])
            go = less | (right & ~differ.any(1))
            lo[open_] = np.where(go, mid + 1, lo[open_])
            hi[open_] = np.where(go, hi[open_], mid)
        return lo


def longest(seq: np.ndarray, places: np.ndarray, text: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """(place in the text, first, end) of the longest matches, from the sorted places in ``seq`` of the text's windows of m words."""
    out, end = [], -1
    for a in places.tolist():
        if a + m <= end:
            continue
        same = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(text, m) == seq[a : a + m]).all(1)) if len(text) > m else np.zeros(1, np.int64)
        best, at = 0, 0
        for p in same.tolist():
            x, y = text[p + m :], seq[a + m : a + len(text) - p]
            n = min(len(x), len(y))
            off = np.flatnonzero(x[:n] != y[:n])
            n = m + (int(off[0]) if len(off) else n)
            if n > best:
                best, at = n, p
        end = a + best
        out.append((at, a, end))
    return out


def scan_shard(arr: pa.Array, block: TestBlock, window: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, list[tuple[str, int, int, int]]]]]:
    """(words in each text; for texts with hits: the words hit as runs, and (item, place in it, first, end) of each match)."""
    w = words(arr, ALNUM, lower=True)
    n = len(w.ptr) - 1
    doc = np.repeat(np.arange(n), np.diff(w.ptr))
    # One blank between texts, so that no passage runs across.
    seq = np.zeros(len(w.hash) + n, np.int64)
    seq[np.arange(len(w.hash)) + doc] = numbered(w.hash, block.vocabulary)
    first = w.ptr[:-1] + np.arange(n)
    array = SuffixArray(seq, len(block.vocabulary), window)
    at, length, text = [], [], []
    for group in block.windows:
        lo, hi = array.find(group.ids)
        many = hi - lo
        total = int(many.sum())
        if total:
            base = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many)
            at.append(array.order[base + np.arange(total)])
            length.append(np.full(total, group.length))
            text.append(np.repeat(group.text, many))
    if not at:
        return np.diff(w.ptr), {}
    at, length, text = np.concatenate(at), np.concatenate(length), np.concatenate(text)
    d = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((at, text, d))
    at, length, text, d = at[order], length[order], text[order], d[order]
    found: dict[int, tuple[np.ndarray, list]] = {}
    cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    for a, z in zip(cuts, [*cuts[1:], len(d)], strict=True):
        i, base = int(d[a]), int(first[d[a]])
        parts = np.flatnonzero(np.concatenate(([True], text[a + 1 : z] != text[a : z - 1]))) + a
        out = []
        for x, y in zip(parts, [*parts[1:], z], strict=True):
            t = int(text[x])
            out += [(block.items[t], p, s - base, e - base) for p, s, e in longest(seq, at[x:y], block.texts[t], int(length[x]))]
        found[i] = (united(at[a:z] - base, at[a:z] - base + length[a:z]), sorted(out))
    return np.diff(w.ptr), found


def united(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(first, end) of the words that any of the spans holds, as rows."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return np.column_stack([s[new], e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))]])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_MATCHES = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _found(column: pa.Array, block: TestBlock, window: int) -> tuple[list[pa.Array], np.ndarray]:
    """Arrow columns n_words, n_hit, items, matches, spans of a batch's texts; the rows that have hits."""
    n_words, found = scan_shard(column, block, window)
    n = len(n_words)
    hit, items, matches, spans = np.zeros(n, np.int64), [[]] * n, [[]] * n, [[]] * n
    for i, (u, m) in found.items():
        hit[i] = int((u[:, 1] - u[:, 0]).sum())
        items[i] = sorted({x[0] for x in m})
        matches[i] = [dict(zip(("item", "item_start", "start", "end"), x, strict=True)) for x in m]
        spans[i] = [{"start": s, "end": e} for s, e in u.tolist()]
    span = [("start", pa.int64()), ("end", pa.int64())]
    kinds = (pa.list_(pa.string()), pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()), *span])), pa.list_(pa.struct(span)))
    return [pa.array(n_words.astype(np.int64)), pa.array(hit), *(pa.array(x, k) for x, k in zip((items, matches, spans), kinds, strict=True))], np.array(sorted(found), np.int64)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, tag: str = "", texts: bool = True) -> DataFrame:
    """``docs`` (but for ``text`` unless ``texts``) with n_words, n_hit, items and matches, each after ``tag``.

    A match is (item, item_start, start, end), counted in words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "benchmark")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"), ALNUM, lower=True)
            raw = [w.hash[a:z].tobytes() for a, z in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(raw, pa.binary()), pa.array(np.diff(w.ptr))], ["item_id", "h", "n"])

    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where("text is not null")
    tests = scratch.save(tests.mapInArrow(hashed, "item_id string, h binary, n long").where("n > 0").distinct(), "hashed")
    total = tests.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))

    def block_of(k: int) -> TestBlock:
        rows = tests.where(F.pmod(F.xxhash64("item_id", "h"), F.lit(blocks)) == k).orderBy("item_id", "h").collect()
        return test_block([r.item_id for r in rows], [np.frombuffer(r.h, np.uint64) for r in rows], window)

    new = [T.StructField(f"{tag}{n}", k) for n, k in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("matches", _MATCHES))]
    base = [f for f in docs.schema.fields if texts or f.name != "text"]
    if blocks == 1:
        block = block_of(0)

        # Spark broadcasts a function's closure when it is large.
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", SHARD_BYTES):
                own = [c for n, c in zip(b.schema.names, b.columns, strict=True) if texts or n != "text"]
                yield pa.RecordBatch.from_arrays([*own, *_found(b.column("text"), block, window)[0][:4]], [f.name for f in (*base, *new)])

        return docs.mapInArrow(run, T.StructType([*base, *new]))
    row = f"__row_{uuid.uuid4().hex}"
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    parts = None
    for k in range(blocks):

        def each(batches: Iterator[pa.RecordBatch], block: TestBlock = block_of(k), all_: bool = k == 0) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", SHARD_BYTES):
                columns, hits = _found(b.column("text"), block, window)
                out = pa.RecordBatch.from_arrays([b.column("row"), columns[0], *columns[2:]], ["row", "n_words", "items", "matches", "spans"])
                yield out if all_ else out.take(pa.array(hits))

        schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", _MATCHES), T.StructField("spans", _SPANS)])
        part = scratch.save(rows.select(F.col(row).alias("row"), "text").mapInArrow(each, schema), "found")
        parts = part if parts is None else parts.unionByName(part)
    joined = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    got = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), joined("items").alias("items"), joined("matches").alias("matches"), joined("spans").alias("spans"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    got = got.select(F.col("row").alias(row), F.col("n_words").alias(f"{tag}n_words"), F.aggregate("spans", zero, step)["n"].alias(f"{tag}n_hit"), F.array_distinct("items").alias(f"{tag}items"), F.col("matches").alias(f"{tag}matches"))
    return rows.select(row, *(F.col(f"`{f.name}`") for f in base)).join(got, row).drop(row)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, matches, contaminated for each row of ``docs``.

    A document is contaminated if it has hits and they are ``percent`` of its words at least.
    """
    out = scan(docs.select("doc_id", "text"), benchmark, window, texts=False)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "matches", ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    tag = f"__{uuid.uuid4().hex}_"
    out = scan(docs, benchmark, window, tag)
    bad = (F.col(f"{tag}n_hit") > 0) & (100 * F.col(f"{tag}n_hit") >= percent * F.col(f"{tag}n_words"))
    return out.where(~bad).select(*(F.col(f"`{c}`") for c in docs.columns))
