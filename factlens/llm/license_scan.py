r"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.  Hashes of
every ``GRAM`` words of the templates are winnowed (the least of each
``WINNOW`` in a row stays) into an inverted index; any shared run of GRAM +
WINNOW - 1 words is sure to hit it.  A document's hits on one template become
runs of equal words, which chain up if both texts and templates go on (a gap of
more than half the template, or two words of a notice, parts two places).  What
lies between two runs of a chain, and before and behind it, is aligned in a
band around the diagonals: the longest common subsequence of words.  Runs and
alignments together yield the template's matched coverage and the matched span.
A short notice must match in all words that tell the license (its name and
version), whatever its coverage.

Scale: one narrow pass; the templates are a small set, a parameter.  Time and
memory are in proportion to a text: an alignment holds the gap's template words
times its band, and what shares too few words with the template isn't aligned.

Defined results: null and empty texts match nothing; a very long text is scanned
whole; a template that occurs several times gives a row for each place; of
overlapping places, of whatever templates, the one with most matched words
stays, then the better covered, then the earlier (so a notice inside a full text
is not a row of its own); a null doc_id stays null; repeated rows each give their
rows; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, gram_windows, slices, words
from .license_texts import PLAIN_WORDS, TEMPLATES

GRAM, WINNOW = 3, 2
#: Templates of so many words at most are notices.
NOTICE_WORDS = 12


@dataclass
class Index:
    """Winnowed hashes in order, with the template and place of each; the templates' words."""

    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray
    names: list[str]
    words: list[np.ndarray]
    #: Places of the words that a template can't do without.
    telling: list[np.ndarray]


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost least hash of each window."""
    if len(h) <= window:
        return np.arange(len(h)) if len(h) < window else np.array([len(h) - 1 - int(h[::-1].argmin())])
    w = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(w)) + window - 1 - w[:, ::-1].argmin(1))


def build_index(templates: dict[str, str]) -> Index:
    w = words(pa.array(list(templates.values())), ALNUM, lower=True)
    parts = [w.hash[a:z] for a, z in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
    hs, ts, ps = [], [], []
    for t, x in enumerate(parts):
        g = gram_windows(x, GRAM)
        at = winnow(g, WINNOW)
        hs.append(g[at])
        ts.append(np.full(len(at), t))
        ps.append(at)
    h, t, p = np.concatenate(hs), np.concatenate(ts), np.concatenate(ps)
    order = np.argsort(h, kind="stable")
    telling = []
    for a, z in zip(w.ptr[:-1], w.ptr[1:], strict=True):
        own = [w.data[w.start[k] : w.end[k]].tobytes().decode().lower() for k in range(a, z)]
        telling.append(np.array([k for k, x in enumerate(own) if x not in PLAIN_WORDS] if len(own) <= NOTICE_WORDS else [], np.int64))
    return Index(h[order], t[order], p[order], list(templates), parts, telling)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """(template place, text place) of the matches of the longest common subsequence on diagonals low..high."""
    m, width = len(template), high - low + 1
    rows = np.zeros((m + 1, width + 1), np.int32)
    for i in range(m):
        # Column c of row i stands for text place i + low + c; one row down is one diagonal back.
        at = np.arange(i + low, i + low + width)
        ok = (at >= 0) & (at < len(text))
        eq = np.zeros(width, bool)
        eq[ok] = text[at[ok]] == template[i]
        diag = rows[i, :width] + eq
        above = rows[i, 1:]
        rows[i + 1, :width] = np.maximum.accumulate(np.maximum(diag, above))
        rows[i + 1, width] = rows[i + 1, width - 1]
    c, i, out = int(rows[m, :width].argmax()), m, []
    while i > 0 and rows[i, c] > 0:
        v = rows[i, c]
        if c > 0 and rows[i, c - 1] == v:
            c -= 1
        elif rows[i - 1, c + 1] == v and c + 1 <= width:
            i, c = i - 1, min(c + 1, width - 1)
        else:
            out.append((i - 1, i - 1 + low + c))
            i -= 1
    return out[::-1]


def runs(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(first text word, end, first template word) of the runs of equal words that hits make, by first word."""
    d = at - place
    order = np.lexsort((at, d))
    at, d = at[order], d[order]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (at[1:] > at[:-1] + GRAM))))
    last = np.concatenate((new[1:] - 1, [len(at) - 1]))
    out = np.column_stack([at[new], at[last] + GRAM, at[new] - d[new]])
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def chains(r: np.ndarray, gap: int) -> list[list[int]]:
    """Chains of runs that go on in text and template, best first; each run is in one at most."""
    n = len(r)
    size = r[:, 1] - r[:, 0]
    score, back = size.astype(float), np.full(n, -1)
    stop = r[:, 2] + size
    reach = np.maximum.accumulate(r[:, 1])
    for i in range(1, n):
        lo = int(np.searchsorted(reach, r[i, 0] - gap))  # before it, all ended too far off
        if lo >= i:
            continue
        j = slice(lo, i)
        gain = np.minimum(np.minimum(r[i, 1] - r[j, 1], stop[i] - stop[j]), size[i])
        ok = (r[j, 0] < r[i, 0]) & (r[j, 2] < r[i, 2]) & (gain > 0) & (r[j, 1] >= r[i, 0] - gap)
        if ok.any():
            value = np.where(ok, score[j] + gain, -1)
            k = int(value.argmax())
            if value[k] > score[i]:
                score[i], back[i] = value[k], lo + k
    used, out = np.zeros(n, bool), []
    for k in np.argsort(-score, kind="stable").tolist():
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = int(back[k])
        if chain:
            out.append(chain[::-1])
    return out


def measured(r: np.ndarray, chain: list[int], template: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """(template place, text place) of all words that a chain's runs and the alignments around them match."""
    out: list[tuple[int, int]] = []

    def fill(p: int, q: int, a: int, b: int, low: int, high: int) -> None:
        if p < q and a < b:
            out.extend((p + i, a + j) for i, j in align(template[p:q], text[a:b], low, high))

    a0, _, p0 = r[chain[0]].tolist()
    slack = max(3, p0 // 8)
    a = max(0, a0 - p0 - slack)
    fill(0, p0, a, a0, a0 - a - p0 - slack, a0 - a - p0 + slack)
    at, tp = a0, p0
    for k in chain:
        s, e, p = r[k].tolist()
        cut = max(at - s, tp - p, 0)  # where it overlaps the run before
        s, p = s + cut, p + cut
        m, n = p - tp, s - at
        slack = max(3, min(m, n) // 8)
        fill(tp, p, at, s, min(0, n - m) - slack, max(0, n - m) + slack)
        out.extend((p + i, s + i) for i in range(e - s))
        at, tp = e, p + e - s
    rest = len(template) - tp
    slack = max(3, rest // 8)
    fill(tp, len(template), at, min(len(text), at + rest + slack), -slack, slack)
    return out


def matches(h: np.ndarray, index: Index, least: float) -> list[tuple[int, float, int, int]]:
    """(template, coverage, first word, end word) of the places where a text holds a template."""
    g = gram_windows(h, GRAM)
    lo = np.searchsorted(index.hashes, g, side="left")
    n = np.searchsorted(index.hashes, g, side="right") - lo
    at = np.repeat(np.arange(len(g)), n)
    if not len(at):
        return []
    k = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(at))
    t, p = index.template[k], index.place[k]
    found = []
    for x in np.unique(t).tolist():
        tpl = index.words[x]
        size = len(tpl)
        own, many = np.unique(tpl, return_counts=True)
        r = runs(at[t == x], p[t == x])
        for chain in chains(r, 2 if size <= NOTICE_WORDS else size // 2):
            # No alignment can match more than the words that both have.
            a, b = int(r[chain[0], 0] - r[chain[0], 2]), int(r[chain[-1], 1] + size)
            held = h[max(0, a - size // 8 - 3) : b]
            have, times = np.unique(held[np.isin(held, own)], return_counts=True)
            if np.minimum(times, many[np.searchsorted(own, have)]).sum() < least * size:
                continue
            got = measured(r, chain, tpl, h)
            if len(got) >= least * size and np.isin(index.telling[x], [i for i, _ in got]).all():
                places = [j for _, j in got]
                found.append((len(got), (x, len(got) / size, min(places), max(places) + 1)))
    starts: list[int] = []
    kept: list[tuple[int, float, int, int]] = []  # in order, apart from each other
    for _, f in sorted(found, key=lambda f: (-f[0], -f[1][1], f[1][2], f[1][0])):
        i = bisect.bisect_left(starts, f[3])
        if not i or kept[i - 1][3] <= f[2]:
            starts.insert(i, f[2])
            kept.insert(i, f)
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word) for each place of at least ``least`` coverage."""
    index = build_index(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"), ALNUM, lower=True)
            g = gram_windows(w.hash, GRAM)
            at = np.searchsorted(index.hashes, g)
            at[at == len(index.hashes)] = 0
            hit = np.flatnonzero(index.hashes[at] == g)
            rows = []
            for i in np.unique(np.searchsorted(w.ptr, hit, side="right") - 1).tolist():
                rows += [(i, *m) for m in matches(w.hash[w.ptr[i] : w.ptr[i + 1]], index, least)]
            ids = b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([index.names[r[1]] for r in rows], pa.string()), pa.array([round(r[2], 6) for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], ["doc_id", "license", "coverage", "start_word", "end_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, start_word long, end_word long")
