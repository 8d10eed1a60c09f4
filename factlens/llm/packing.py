"""Best-fit packing into bins of several permitted lengths, chosen jointly.

Documents become chunks of at most the largest permitted length, cut between
words as the tokenizer counts them.  A bin of length c costs
``c * (1 + c / attention) + overhead``: attention makes long sequences dearer a
token, the overhead makes many short ones dearer, and room that stays empty is
paid for.  Chunks are dealt evenly to shards of a bounded number.  Within a
shard they go, longest first, to the fullest open bin that still holds them
(best fit, by binary search over the free room).  A chunk that fits nowhere opens
the bin size of the least cost a token, where each size is filled on trial, as
best fit would, with the chunks that are still to come.  At the end each bin shrinks
to the smallest permitted length that holds its contents.

Scale: one narrow pass counts tokens and cuts chunks; one shuffle of rows
without texts packs them.  The number of shards grows with the input, so that a
shard stays near ``SHARD_CHUNKS`` rows; dealing is by a hash that also has the
row's number, so that repeated rows and one large source spread out.
``sequences`` brings each chunk's text to its bin by two more shuffles of the
texts; no row or group is longer than the largest length.

Defined results: a null or empty text has only its end mark, if ``end_mark`` is
on, else no chunk; an end mark that a full chunk has no room for is a chunk of
its own; a word of more tokens than the largest length is cut every few
characters, and each piece counted by itself; a null doc_id is packed like any
other and stays null; repeated rows are each packed; ties in length are packed
in order of row number and chunk; an empty table gives an empty result; other
columns are ignored and may have any name.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, string_buffers
from .token_count import ENCODED_BYTES, Counter, plain, shared

#: Chunks that a shard holds on average.
SHARD_CHUNKS = 20_000
LENGTHS = (2048, 4096, 8192, 16384)
#: The length at which attention costs as much as all else, and the cost of a sequence besides its tokens.
ATTENTION, OVERHEAD = 24_576, 64


def bin_cost(c: int, attention: int = ATTENTION, overhead: int = OVERHEAD) -> float:
    return c * (1 + c / attention) + overhead


def trial_fill(lengths: np.ndarray, total: np.ndarray, k: int, room: int) -> int:
    """Tokens that chunks from k on (longest first; ``total`` are their running sums) put into ``room``: each time the longest that fits."""
    filled, n = 0, len(lengths)
    while room > 0 and k < n:
        k += int(np.searchsorted(-lengths[k:], -room))  # the first that fits
        if k >= n:
            break
        # As many in a row as fit together.
        to = int(np.searchsorted(total, total[k] + room, side="right")) - 1
        filled += int(total[to] - total[k])
        room -= int(total[to] - total[k])
        k = to
    return filled


def best_fit(lengths: np.ndarray, capacities: Sequence[int] = LENGTHS, attention: int = ATTENTION, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset of each chunk, final capacity of each bin) for chunks sorted longest first."""
    caps = sorted(capacities)
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    used: list[int] = []
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    total = np.concatenate(([0], np.cumsum(lengths)))
    for k, n in enumerate(lengths.tolist()):
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            cost = [(bin_cost(c, attention, overhead) / (n + trial_fill(lengths, total, k + 1, c - n)), -c) for c in caps if c >= n]
            b, room = len(used), -min(cost)[1]
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        if room > n:
            bisect.insort(free, (room - n, b))
    final = np.array([next(c for c in caps if c >= max(u, 1)) for u in used], np.int64)
    return bins, offsets, final


def cut(counter: Counter, arr: pa.Array, top: int, end_mark: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end byte, tokens) of the chunks of a string column, in order."""
    tokens, at, first = counter.parts(plain(arr))
    data, offs = string_buffers(plain(arr))
    n = len(offs) - 1
    last = np.concatenate((first[1:], [len(tokens)]))
    total = np.concatenate(([0], np.cumsum(tokens)))
    edge = np.concatenate((at, offs[-1:]))
    doc, start, end, size = [], [], [], []

    def put(d: int, s: int, e: int, m: int) -> None:
        doc.append(d)
        start.append(s - int(offs[d]))
        end.append(e - int(offs[d]))
        size.append(m)

    for d in range(n):
        k, z = int(first[d]), int(last[d])
        while k < z:
            if tokens[k] > top:
                for s, e, m in _pieces(counter, data[edge[k] : edge[k + 1]].tobytes().decode(), int(edge[k]), top):
                    put(d, s, e, m)
                k += 1
                continue
            to = min(z, int(np.searchsorted(total, total[k] + top, side="right")) - 1)
            if total[to] > total[k]:
                put(d, int(edge[k]), int(edge[to]), int(total[to] - total[k]))
            k = to
        if end_mark:
            if doc and doc[-1] == d and size[-1] < top:
                size[-1] += 1
            else:
                put(d, int(offs[d + 1]), int(offs[d + 1]), 1)
    return tuple(np.array(x, np.int64) for x in (doc, start, end, size))


def _pieces(counter: Counter, text: str, at: int, top: int) -> Iterator[tuple[int, int, int]]:
    """(first byte, end byte, tokens) of a long word's pieces; a character is at most four tokens, and a mark one."""
    step = max(1, (top - 1) // 4)
    for k in range(0, len(text), step):
        raw = text[k : k + step].encode()
        yield at, at + len(raw), counter.word(text[k : k + step]) if k else counter.part(raw)
        at += len(raw)


def chunks(docs: DataFrame, pieces: Sequence[tuple[str, float]], capacities: Sequence[int] = LENGTHS, end_mark: bool = True, byte_fallback: bool = True, texts: bool = False) -> DataFrame:
    """row (a number), doc_id, chunk, start, end (bytes of the text's UTF-8, with spaces for U+2581), n_tokens, and ``piece`` if ``texts``, of each chunk."""
    top = max(capacities)
    counter_of = shared(docs.sparkSession, pieces, byte_fallback)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of()
        for b in slices(batches, "text", ENCODED_BYTES):
            doc, start, end, size = cut(counter, b.column("text"), top, end_mark)
            at = np.arange(len(doc)) - np.searchsorted(doc, doc)
            columns = [b.column("row").take(pa.array(doc)), b.column("doc_id").take(pa.array(doc)), *(pa.array(x) for x in (at, start, end, size))]
            if texts:
                data, offs = string_buffers(plain(b.column("text")))
                columns.append(pa.array([data[offs[d] + s : offs[d] + e].tobytes().decode() for d, s, e in zip(doc, start, end, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, NAMES + ["piece"] * texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {kind}, chunk long, start long, end long, n_tokens long" + ", piece string" * texts)


NAMES = ["row", "doc_id", "chunk", "start", "end", "n_tokens"]


def binned(cut: DataFrame, capacities: Sequence[int] = LENGTHS, attention: int = ATTENTION, overhead: int = OVERHEAD) -> DataFrame:
    """Rows of ``chunks``, written before, with bin_id, capacity and offset in the bin."""
    shards = max(1, -(-cut.count() // SHARD_CHUNKS))
    dealt = cut.select(*NAMES).withColumn("shard", F.pmod(F.xxhash64("row", "chunk"), F.lit(shards)))
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "row", "chunk"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = best_fit(pdf["n_tokens"].to_numpy(), capacities, attention, overhead)
        out = pdf[NAMES].reset_index(drop=True)
        return out.assign(bin_id=[f"{key[0]}-{b}" for b in bins], capacity=final[bins], offset=offsets)

    schema = f"row long, doc_id {kind}, chunk long, start long, end long, n_tokens long, bin_id string, capacity long, offset long"
    return dealt.groupBy("shard").applyInPandas(run, schema)


def pack(docs: DataFrame, pieces: Sequence[tuple[str, float]], capacities: Sequence[int] = LENGTHS, attention: int = ATTENTION, overhead: int = OVERHEAD, end_mark: bool = True) -> DataFrame:
    """doc_id, chunk, start, end, n_tokens, bin_id, capacity, offset of each chunk.

    ``pieces`` are the tokenizer's (``token_count.load_pieces``).  Every byte of
    a text is in exactly one chunk; chunks of a bin lie one behind another from 0.
    """
    # Written once: row numbers must not change if a task runs again.
    cut = Scratch(docs.sparkSession, "packing").save(chunks(docs, pieces, capacities, end_mark), "chunks")
    return binned(cut, capacities, attention, overhead).drop("row")


def sequences(docs: DataFrame, pieces: Sequence[tuple[str, float]], capacities: Sequence[int] = LENGTHS, attention: int = ATTENTION, overhead: int = OVERHEAD, end_mark: bool = True) -> DataFrame:
    """One row for each packed sequence: bin_id, capacity, n_tokens, and in order its doc_ids, chunks, lengths and texts.

    A text that a sequence holds whole or in part stands for its tokens, and an
    end mark follows a document's last one; a document is read back by joining
    its texts in order of chunk.  The mark that stands for a space in the
    vocabulary is given back as a space.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(chunks(docs, pieces, capacities, end_mark, texts=True), "texts")
    placed = binned(cut, capacities, attention, overhead).select("row", "chunk", "bin_id", "capacity", "offset")
    whole = cut.select("row", "doc_id", "chunk", "n_tokens", "piece").join(placed, ["row", "chunk"])
    # One list of places keeps the sort within each bin.
    held = F.struct("offset", "doc_id", "chunk", "n_tokens", "piece")
    bins = whole.groupBy("bin_id").agg(F.first("capacity").alias("capacity"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(held)).alias("held"))
    return bins.select("bin_id", "capacity", "n_tokens", F.col("held.doc_id").alias("doc_ids"), F.col("held.chunk").alias("chunks"), F.col("held.n_tokens").alias("lengths"), F.col("held.piece").alias("texts"))
