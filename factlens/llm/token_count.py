"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton enumerates all vocabulary matches that end at each
place; dynamic programming carries the best score and its number of pieces, so
no path is kept.  The rules are those of the ``tokenizers`` library's Unigram
model after a Metaspace pre-tokenizer: every space becomes U+2581, a text gets
one in front, and each word is segmented by itself; of equal scores the longer
last piece (the earlier start) stays; a character without a piece of its own
costs the lowest score less 10 and, with byte fallback, counts its UTF-8 bytes.

Scale: one narrow pass.  A slice of texts becomes one Arrow array of its words
(cut before each space, and at line feeds where no piece holds one), which
Arrow's dictionary encoding reduces to the distinct ones; only those are looked
up, and words that a worker process has met are remembered in a table of bounded
size, from one task to the next.  The vocabulary (some ten thousand pieces) is
broadcast.

Defined results: null and empty texts have 0 tokens; a very long text, or word,
is counted whole; a null doc_id stays null; repeated rows each get their count; an empty table gives an empty result; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import slices, string_buffers

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers at most (some 100 MB), and their greatest length in bytes.
REMEMBERED, REMEMBERED_LENGTH = 800_000, 96
#: Bytes of text that are encoded at once (a longer text goes alone).
ENCODED_BYTES = 4_000_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in order of their ids."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Counter:
    def __init__(self, pieces: Sequence[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.byte_fallback = byte_fallback
        # With whole-number scores sums are exact, so that a character which no piece holds can split a word.
        whole = all(float(s).is_integer() and abs(s) < 2**32 for _, s in pieces)
        held = {c for p, _ in pieces for c in p}
        self.line_splits = whole and byte_fallback and "\n" not in held
        self.seen: dict[bytes, int] = {}

    def word(self, w: str) -> int:
        """Pieces of one word, by the best score; ties go to the earlier start."""
        n = len(w)
        best: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        if self.single.issuperset(w):
            # Each place has a match; the automaton gives those that end at one place longest first.
            done = -1
            for e, (length, score) in self.automaton.iter(w):
                s = best[e + 1 - length] + score
                if e != done or s > best[e + 1]:
                    best[e + 1], count[e + 1], done = s, count[e + 1 - length] + 1, e
            return count[n]
        found = self.automaton.iter(w)
        coming = next(found, None)
        run = False  # whether the best path to the last place ends in an unknown character
        runs = [False] * (n + 1)
        for e in range(n):
            c = w[e]
            ends = []
            while coming is not None and coming[0] == e:
                ends.append(coming[1])
                coming = next(found, None)
            got = False
            top, pieces, run = 0.0, 0, False
            for length, score in sorted(ends, reverse=True) if len(ends) > 1 else ends:
                s = best[e + 1 - length] + score
                if not got or s > top:
                    got, top, pieces = True, s, count[e + 1 - length] + 1
            if c not in self.single:
                s = best[e] + self.unknown
                if not got or s > top:
                    # Unknown characters in a row are one piece, or their bytes.
                    more = len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else (0 if runs[e] else 1)
                    top, pieces, run = s, count[e] + more, True
            best[e + 1], count[e + 1], runs[e + 1] = top, pieces, run
        return count[n]

    def part(self, raw: bytes) -> int:
        """Tokens of one part of a text: a mark and a word, or a line feed (one byte) and a word."""
        if self.line_splits and raw[:1] == b"\n":
            return 1 + (self.word(raw[1:].decode()) if len(raw) > 1 else 0)
        return self.word(SPACE + raw.removeprefix(b" ").decode())

    def parts(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of each part, first byte of each, first part of each text) of a string column.

        A text's parts are what stands before its first separator, and then each
        separator with what follows it; a leading space only stands for the mark
        that every text gets.
        """
        data, offs = string_buffers(arr)
        n = len(offs) - 1
        sep = data == 0x20
        if self.line_splits:
            sep |= data == 0x0A
        at = np.sort(np.concatenate([offs[:-1], np.flatnonzero(sep)]), kind="stable")
        first = np.searchsorted(at, offs[:-1], side="left")
        # Where texts are empty, several begin at one byte.
        first = np.maximum(first, np.searchsorted(at, offs[:-1], side="left") + np.arange(n) - np.searchsorted(offs[:-1], offs[:-1], side="left"))
        edges = np.concatenate([at, offs[-1:]]).astype(np.int32)
        whole = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = whole.dictionary_encode()
        tokens = np.zeros(len(coded.dictionary), np.int64)
        seen = self.seen
        for k, raw in enumerate(coded.dictionary.to_pylist()):
            got = seen.get(raw)
            if got is None:
                got = self.part(raw)
                if len(raw) <= REMEMBERED_LENGTH:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[raw] = got
            tokens[k] = got
        out = tokens[coded.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
        size = np.diff(offs)
        blank = size == 0
        blank[~blank] = data[offs[:-1][~blank]] == 0x20
        out[first[blank]] = 0
        return out, at, first

    def counts(self, arr: pa.Array) -> np.ndarray:
        out, _, first = self.parts(arr)
        total = np.concatenate(([0], np.cumsum(out)))
        return total[np.concatenate((first[1:], [len(out)]))] - total[first] if len(first) else np.zeros(0, np.int64)

    def count(self, text: str | None) -> int:
        return int(self.counts(plain(pa.array([text], pa.string())))[0])


def plain(arr: pa.Array) -> pa.Array:
    """The column with marks that stand in texts as the spaces that they count as."""
    if pc.any(pc.match_substring(arr, SPACE)).as_py():
        return pc.replace_substring(arr, SPACE, " ")
    return arr


def shared(spark: SparkSession, pieces: Sequence[tuple[str, float]], byte_fallback: bool = True) -> Callable[[], Counter]:
    """For use in tasks: the counter that the worker process keeps with the broadcast pieces."""
    sent = spark.sparkContext.broadcast({"pieces": list(pieces)})

    def get() -> Counter:
        held = sent.value
        if "counter" not in held:
            held["counter"] = Counter(held["pieces"], byte_fallback)
        return held["counter"]

    return get


def token_counts(docs: DataFrame, pieces: Sequence[tuple[str, float]], byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``, over whole texts."""

    counter_of = shared(docs.sparkSession, pieces, byte_fallback)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of()
        for b in slices(batches, "text", ENCODED_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counter.counts(plain(b.column("text"))))], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")
