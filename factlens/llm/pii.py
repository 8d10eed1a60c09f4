r"""Personal data: exact base patterns, and a semi-Markov conditional random field.

Base spans are found by pattern, leftmost and non-overlapping within a kind:
email, ip, card (Luhn) and phone.  They always stay.  The field finds what the
patterns miss: disguised addresses (``jane [at] site [dot] org``), spelled-out
or bracketed dots, phones without a plus, and data that runs into its
neighbours.  Its candidates are whole segments (``candidates`` states them):

* email: an at-sign, a bracketed "at", or the word "at" before a spelled-out
  dot; a local part in front, which can begin at any of its parts; two or more
  labels behind, ending at any label of letters;
* ip: four numbers up to 255 with the same dot, plain or disguised, between;
* card: 12 to 19 digits passing Luhn in groups of three or more with the same
  one-character separator between;
* phone: 7 to 15 digits in groups.

Each has features of the whole span (shape, checks, separators, neighbours, cue
words before it).  Dynamic programming over segments of at most ``MAX_PARTS``
groups or labels chooses boundaries and kinds jointly.  Chosen segments that
touch no base span are added.  The weights are fitted by exact likelihood on
generated text (seeded), so that no corpus row is read for training.

Scale: one narrow pass; nothing is shuffled or collected.  Time is linear in the
text, whatever it consists of: a place takes part in a bounded number of
candidates, and those that can't gain are dropped at once.  Memory is that of
the text, and of its found spans.

Defined results: a null text counts as empty and has no spans; offsets are code
points, ends exclusive; no part of a long text is cut off; a null doc_id stays
null; repeated rows each get their result; of equally good segmentations the one
whose segments end first stays; an empty table gives an empty result; other
columns may have any name.  ``n_email`` and its like count base spans.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

KINDS = ("email", "ip", "card", "phone")
#: A segment has at most so many groups of digits, or parts of an address on either side of its at.
MAX_PARTS = 8
#: So many words before a segment can be cue words; they lie within so many characters.
CUE_WORDS, CUE_REACH = 3, 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Equal to the plain patterns, but linear on long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, pos = [], 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > pos and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            pos = m.end()
        else:
            pos = max(pos, at + 1)
        at = text.find("@", max(at + 1, pos))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out, pos = [], 0
    while m := _IP.search(text, pos):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(m.span())
        pos = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), sorted."""
    out = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if _TRIGGER.search(text):
        out += [(s, e, 1) for s, e in _ips(text)]
        for m in _CARD.finditer(text):
            d = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((*m.span(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


# ------------------------------------------------------------- semi-Markov CRF

_CUES = {
    "mail": 0, "email": 0, "contact": 0, "write": 0, "reach": 0, "ip": 1, "host": 1, "server": 1, "address": 1, "addr": 1,
    "card": 2, "visa": 2, "mastercard": 2, "credit": 2, "payment": 2, "tel": 3, "phone": 3, "call": 3, "mobile": 3, "fax": 3, "cell": 3, "telephone": 3,
}
#: Words before numbers that are something else.
_OTHER = frozenset(
    "isbn issn order invoice id ref reference no nr ticket case sku item part serial version ver v build release page pages vol volume issue doi date tracking model lot code total sum lat lon section chapter rev since between years from".split()
)
#: Words that stand before "at" in plain prose.
_PROSE = frozenset("look looked looking meet met meeting is are was were be been here there arrive arrived not good bad it him her them us me you all stay stayed work works start starts point points up down only even just live lives held".split())
_TOPS = frozenset("com org net edu gov io info biz eu uk de fr es it nl ch at us ca jp cn ru br in co".split())

_DOT = r"(?:\.| ?[\[({<] ?(?:\.|(?i:dot|punkt|point|punto)) ?[\])}>] ?| (?i:dot|punkt|point|punto) )"
#: What joins a local part to its domain; a bare word needs a spelled-out dot behind, which is seen to below.
_AT = re.compile(r" ?@ ?| ?[\[({<] ?(?i:at|@) ?[\])}>] ?|(?<=[A-Za-z0-9_%+-]) (?i:at) (?=[A-Za-z0-9])")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_NEXT_LABEL = re.compile(rf"({_DOT})([A-Za-z0-9-]+)")
#: A spelled-out dot that ends where a local part's last piece begins.
_DOT_BEFORE = re.compile(rf"(?<=[A-Za-z0-9_%+-]){_DOT}\Z")
_CHAIN = re.compile(r"[0-9]++(?:(?: ?[./()-]{1,2} ?| )[0-9]++)*+")
_QUADS = re.compile(rf"(?<![0-9])[0-9]++(?:(?: \. |{_DOT})[0-9]++){{3,}}+")
_GROUP = re.compile(r"[0-9]+")
_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]+")
_BLANK = re.compile(r"\s")
_SPOT = re.compile(r"[0-9@]|(?i:\bat\b)")
N_FEATURES = 22

Candidate = tuple[int, int, int, list[float]]


def cue_words(text: str, at: int) -> list[str]:
    return [m[0].lower() for m in _WORD.finditer(text, max(0, at - CUE_REACH), at)][-CUE_WORDS:]


def _open_left(text: str, s: int) -> bool:
    """Whether what stands before goes on into the span."""
    if not s:
        return False
    c = text[s - 1]
    return c.isalnum() or c in "@._%+-#=$€£/" or c == "," and s > 1 and text[s - 2].isdigit()


def _open_right(text: str, e: int) -> bool:
    if e >= len(text):
        return False
    c = text[e]
    return c.isalnum() or c in "@_%#=" or c in ".,:/-" and e + 1 < len(text) and text[e + 1].isalnum()


def _addresses(text: str) -> Iterator[Candidate]:
    if "@" not in text and " at " not in text and not _SPOT.search(text):
        return
    for m in _AT.finditer(text):
        first = _LABEL.match(text, m.end())
        if not first:
            continue
        mark = m[0].strip()
        bare = mark.lower() == "at"
        # Ends: behind each further label of letters.
        ends, pos, spelled, labels = [], first.end(), False, 1
        while labels < MAX_PARTS and (x := _NEXT_LABEL.match(text, pos)):
            spelled = spelled or x[1] != "."
            labels, pos = labels + 1, x.end()
            if x[2].isalpha() and len(x[2]) >= 2 and (spelled or not bare):
                ends.append((pos, spelled, x[2].lower(), _NEXT_LABEL.match(text, pos) is not None))
        if not ends:
            continue
        # Starts: each part of the local part, back over single dots and marks, plain or spelled out.
        starts, s = [], m.start()
        while len(starts) < MAX_PARTS:
            p = s
            while p and text[p - 1] in _LOCAL and text[p - 1] not in "._%+-":
                p -= 1
            if p == s:
                break
            starts.append(p)
            s = p
            if s > 1 and text[s - 1] in "._%+-" and text[s - 2] in _LOCAL:
                s -= 1
            elif d := _DOT_BEFORE.search(text, max(0, s - 12), s):
                s = d.start()
            else:
                break
        for k, s in enumerate(starts):
            local = text[s : m.start()].lower()
            left = _open_left(text, s)
            cue = 0 in (_CUES.get(w) for w in cue_words(text, s))
            for e, spelled, top, further in ends:
                f = [0.0] * N_FEATURES
                f[0] = 1
                f[1], f[2], f[3], f[4] = m[0] == "@", m[0] != "@" and mark == "@", len(mark) > 2, bare
                f[5], f[6], f[7] = spelled, len(top) <= 6, top in _TOPS
                f[8], f[9], f[10], f[11] = local in _PROSE, left, _open_right(text, e), cue
                f[12] = further
                f[13], f[14] = k / MAX_PARTS, not local.isalpha()
                yield s, e, 0, f


def _quads(text: str) -> Iterator[Candidate]:
    for chain in _QUADS.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *chain.span())]
        for k in range(len(groups) - 3):
            four = groups[k : k + 4]
            seps = {text[four[j][1] : four[j + 1][0]] for j in range(3)}
            parts = [text[a:b] for a, b in four]
            if len(seps) > 1 or not all(len(p) <= 3 and int(p) <= 255 for p in parts):
                continue
            sep, s, e = seps.pop(), four[0][0], four[3][1]
            words = cue_words(text, s)
            f = [0.0] * N_FEATURES
            f[0] = 1
            f[1], f[2], f[3], f[4] = sep == ".", sep == " . ", any(c in "[({<" for c in sep), any(c.isalpha() for c in sep)
            f[5], f[6] = _open_left(text, s), _open_right(text, e)
            f[7], f[8] = 1 in map(_CUES.get, words), any(w in _OTHER for w in words)
            f[9], f[10], f[11] = any(len(p) > 1 and p[0] == "0" for p in parts), all(len(p) == 1 for p in parts), int(parts[0]) == 0
            f[12], f[13] = k > 0, k + 4 < len(groups)
            yield s, e, 1, f


def _numbers(text: str) -> Iterator[Candidate]:
    for chain in _CHAIN.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *chain.span())]
        for i in range(len(groups)):
            nd, seps, parts = 0, [], []
            s = groups[i][0]
            plus = s > 0 and text[s - 1] == "+"
            for j in range(i, min(i + MAX_PARTS, len(groups))):
                a, b = groups[j]
                nd += b - a
                if nd > 19 or j > i and b - a == 1 and not (plus and j == i + 1):
                    break
                parts.append(text[a:b])
                if j > i:
                    seps.append(text[groups[j - 1][1] : a])
                if nd >= 7:
                    yield from _shaped(text, s, b, nd, seps, parts, i == 0, j + 1 == len(groups))


def _shaped(text: str, s: int, e: int, nd: int, seps: list[str], parts: list[str], head: bool, last: bool) -> Iterator[Candidate]:
    sizes, digits, kinds = [len(p) for p in parts], "".join(parts), set(seps)
    isbn = nd == 13 and digits[:3] in ("978", "979")
    if 12 <= nd <= 19 and len(kinds) < 2 and all(len(x) == 1 and x in " -." for x in kinds) and (len(sizes) == 1 or min(sizes[:-1]) >= 3) and luhn(digits):
        words = cue_words(text, s)
        f = [0.0] * N_FEATURES
        f[0] = 1
        f[1], f[2], f[3] = 13 <= nd <= 16, sizes in ([4, 4, 4, 4], [4, 6, 5]), len(sizes) == 1
        f[4], f[5], f[6] = digits[0] in "3456", _open_left(text, s), _open_right(text, e)
        f[7], f[8], f[9] = 2 in map(_CUES.get, words), any(w in _OTHER for w in words), isbn
        f[10], f[11], f[12], f[13] = kinds == {"."}, len(set(digits)) < 3, not head, not last
        yield s, e, 2, f
    if nd > 15:
        return
    closed = ")" in text[s:e] and "(" not in text[s:e]
    if closed and s and text[s - 1] == "(":
        s, closed = s - 1, False
    plus = s > 0 and text[s - 1] == "+"
    s -= plus
    words = cue_words(text, s)
    year = lambda p: len(p) == 4 and "1000" <= p <= "2100"
    f = [0.0] * N_FEATURES
    f[0] = 1
    f[1], f[2] = plus, digits[:2] == "00"
    f[3], f[4] = "(" in text[s:e] and ")" in text[s:e], closed or text[s:e].count("(") != text[s:e].count(")")
    f[5], f[6], f[7] = nd <= 8, 9 <= nd <= 11, nd >= 12
    f[8], f[9] = len(sizes) == 1, len(kinds) == 1
    f[10], f[11] = sizes[-3:] == [3, 3, 4] and len(sizes) <= 4, len(sizes) >= 4 and all(n == 2 for n in sizes)
    f[12] = not plus and kinds == {" "}
    f[13], f[14] = _open_left(text, s), _open_right(text, e)
    f[15], f[16] = 3 in map(_CUES.get, words), any(w in _OTHER for w in words)
    f[17] = len(parts) >= 2 and (year(parts[0]) or len(parts) > 2 and year(parts[2])) and max(sizes) <= 4
    f[18], f[19] = isbn, len(digits) in (10, 13) and len(sizes) in (4, 5) and sizes[-1] == 1
    f[20], f[21] = not head, not last
    yield s, e, 3, f


def candidates(text: str) -> Iterator[Candidate]:
    """(start, end, kind, features) of the field's candidates, by kind of chain."""
    if _SPOT.search(text):
        yield from _addresses(text)
        yield from _quads(text)
        yield from _numbers(text)


def _behind(text: str, s: int) -> int:
    """Where what stands before a segment ends, blanks left out."""
    while s and _BLANK.match(text, s - 1):
        s -= 1
    return s


class SemiCRF:
    """A segment scores weights[kind] . features; all else scores 0, and a segment right behind another ``follow`` more."""

    def __init__(self, weights: np.ndarray, follow: float = 0.0):
        self.weights, self.follow = weights, follow

    def gains(self, found: Iterator[Candidate], block: int = 4096) -> Iterator[tuple[int, int, int, float]]:
        """Candidates that score above 0: with ``follow`` at most 0, no other is in a best segmentation."""
        while part := list(itertools.islice(found, block)):
            scores = (np.array([c[3] for c in part]) * self.weights[[c[2] for c in part]]).sum(1)
            yield from ((c[0], c[1], c[2], v) for c, v in zip(part, scores.tolist(), strict=True) if v > 0)

    def best(self, text: str, found: Iterator[Candidate] | None = None) -> list[tuple[int, int, int]]:
        """The best segmentation, (start, end, kind) in order."""
        cands = sorted(self.gains(candidates(text) if found is None else found), key=lambda c: (c[1], c[0], c[2]))
        ends: list[int] = []
        here: list[tuple[float, int]] = []  # of segmentations whose last segment ends at that end: value, that segment
        upto: list[tuple[float, int]] = []  # ends there or before
        back: list[int] = []
        for k, (s, e, _, v) in enumerate(cands):
            b = _behind(text, s)
            at = bisect.bisect_left(ends, b)
            value, before = upto[at - 1] if at else (0.0, -1)
            if at < len(ends) and ends[at] == b and here[at][0] + self.follow > value:
                value, before = here[at][0] + self.follow, here[at][1]
            value += v
            back.append(before)
            if not ends or ends[-1] < e:
                ends.append(e)
                here.append((value, k))
                upto.append(max(upto[-1], (value, k), key=lambda x: x[0]) if upto else (value, k))
            elif value > here[-1][0]:
                here[-1] = (value, k)
                if value > upto[-1][0]:
                    upto[-1] = (value, k)
        out, k = [], upto[-1][1] if upto else -1
        while k >= 0:
            out.append(cands[k][:3])
            k = back[k]
        return out[::-1]

    def gradient(self, text: str, cands: list[Candidate], gold: set[tuple[int, int, int]]) -> np.ndarray:
        """Of the log likelihood, by the forward and backward sums over all segmentations of a short text."""
        cands = sorted(cands, key=lambda c: (c[1], c[0], c[2]))
        n = len(cands)
        phi, kind = np.array([c[3] for c in cands]), np.array([c[2] for c in cands])
        score = np.clip((phi * self.weights[kind]).sum(1), -30, 30)
        behind, end = np.array([_behind(text, c[0]) for c in cands]), np.array([c[1] for c in cands])
        # step[d, c]: what it adds if d comes right before c.
        step = np.where(end[:, None] < behind, 0.0, np.where(end[:, None] == behind, self.follow, -np.inf))
        fwd, bwd = np.zeros(n), np.zeros(n)
        for c in range(n):
            fwd[c] = score[c] + np.logaddexp.reduce([0.0, *(fwd[:c] + step[:c, c])])
        for c in range(n - 1, -1, -1):
            bwd[c] = np.logaddexp.reduce([0.0, *(score[c + 1 :] + bwd[c + 1 :] + step[c, c + 1 :])])
        total = np.logaddexp.reduce([0.0, *fwd])
        p = np.exp(np.minimum(fwd + bwd - total, 0))
        target = np.array([c[:3] in gold for c in cands], float)
        out = np.zeros_like(self.weights)
        np.add.at(out, kind, (target - p)[:, None] * phi)
        return out


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng: np.random.Generator, lo: int = 2, hi: int = 9) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(lo, hi)))


def _phone(rng: np.random.Generator, cued: bool) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"+{rng.integers(20, 99)} {a} {b}{c}", f"({a}) {b} {c}"]
    if cued:  # without a cue these could be any number
        forms += [f"{a} {b} {c}", f"{b}-{c}", f"0{_digits(rng, 9)}", "0" + " ".join([_digits(rng, 1), *(_digits(rng, 2) for _ in range(4))])[0:1] + " ".join([_digits(rng, 1), *(_digits(rng, 2) for _ in range(4))]), f"0{_digits(rng, 2)}/{_digits(rng, 7)}", f"0{_digits(rng, 2)} {_digits(rng, 4)} {c}", f"00{rng.integers(20, 99)} {a} {b}{c}"]
    return forms[rng.integers(len(forms))]


def _plain_number(rng: np.random.Generator) -> str:
    d, n = lambda k: _digits(rng, k), lambda a, b: int(rng.integers(a, b))
    forms = [
        f"{n(1, 13)}/{n(1, 29)}/{n(1990, 2030)}", f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}", f"{n(1, 29)}.{n(1, 13)}.{n(1990, 2030)}", f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)} {n(10, 24)}:{n(10, 60)}",
        f"{n(1500, 2030)}-{n(1500, 2030)}", f"{d(3)}.{d(2)}", d(n(1, 9)), d(n(9, 13)), f"v{d(1)}.{d(2)}.{d(3)}.{n(256, 999)}", f"{d(20)}{d(6)}",
        f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"978{d(10)}", f"{d(1)}-{d(4)}-{d(4)}-{d(1)}", " ".join(f"{n(1, 99)}00" for _ in range(n(3, 7))), " ".join(d(n(2, 6)) for _ in range(n(3, 7))),
        f"{d(4)} {d(4)}", f"{d(2)},{d(3)},{d(3)}", f"${d(3)},{d(3)}.{d(2)}", f"{n(1, 90)}.{d(4)}, {n(1, 90)}.{d(4)}", f"{d(5)}-{d(6)}", f"{d(3)}-{d(7)}-{d(7)}", f"{d(2)}.{d(4)}/{d(5)}.{d(7)}", f"{n(1, 9)}.{n(0, 9)}.{n(0, 9)}.{n(256, 900)}", d(16),
    ]
    return forms[rng.integers(len(forms))]


def _sample(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated line with one or two entities in plain or disguised forms, or with look-alikes."""
    parts: list[str] = []
    gold: list[tuple[int, int, int]] = []
    size = 0

    def put(s: str, kind: int | None = None) -> None:
        nonlocal size
        if kind is not None:
            gold.append((size, size + len(s), kind))
        parts.append(s)
        size += len(s)

    pick = lambda xs: xs[rng.integers(len(xs))]
    bare = False
    for _ in range(rng.integers(1, 4)):
        if bare:  # right behind the last one
            parts[-1], size = " ", size - len(parts[-1]) + 1
        else:
            put(" ".join(_word(rng) for _ in range(rng.integers(1, 4))) + " ")
        kind = int(rng.integers(0, 7))
        cued = kind < 4 and rng.random() < 0.4
        if cued:
            put(pick([w for w, k in _CUES.items() if k == kind]) + pick([" ", ": ", " is ", " number "]))
        if kind == 0:
            local = _word(rng) + pick(["", ".", "_", "-", "."]) + pick(["", _word(rng), _digits(rng, 2)])
            local = local.rstrip("._-")
            at, dot = pick([("@", "."), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", "."), (" @ ", "."), ("[at]", "[dot]"), (" at ", " dot "), ("@", "[.]"), ("(@)", ".")])
            if "dot" in dot and rng.random() < 0.2:
                local = f"{_word(rng)}{dot}{_word(rng)}"
            put(local + at + dot.join([_word(rng), *([_word(rng)] * int(rng.random() < 0.4)), pick(["com", "org", "net", "de", "fr", "es", "io", "edu", "co"]) if rng.random() < 0.9 else _word(rng, 2, 7)]), 0)
        elif kind == 1:
            put(pick([".", ".", " . ", "[.]", "(.)", " dot ", "[dot]"]).join(str(x) for x in rng.integers(0, 256, 4)), 1)
        elif kind == 2:
            body = str(rng.integers(3, 7)) + _digits(rng, pick([12, 14, 14, 14, 14, 17]))
            d = next(body + c for c in "0123456789" if luhn(body + c))
            sep = pick(["", "", " ", "-", "."])
            put(sep.join(d[k : k + 4] for k in range(0, len(d), 4)), 2)
        elif kind == 3:
            put(_phone(rng, cued), 3)
        elif kind == 4:
            if rng.random() < 0.5:
                put(pick(sorted(_OTHER)) + pick([" ", ": ", " "]))
            put(_plain_number(rng))
        elif kind == 5:
            put(_plain_number(rng) + pick(["", " ", ", "]) + pick(["", _plain_number(rng)]))
        else:
            put(pick([f"@{_word(rng)}", f"{pick(sorted(_PROSE))} at {_word(rng)} dot {_word(rng)}", f"{pick(sorted(_PROSE))} at {_word(rng)}. {_word(rng)}", f"{_word(rng)}={_digits(rng, 4)}{_word(rng)}{_digits(rng, 5)}", f"{_word(rng)}@{_word(rng)}", f"{_word(rng)} @ {rng.integers(1, 99)}.{_digits(rng, 2)}", f"AK{_digits(rng, 9)}{_word(rng).upper()}", f"{_word(rng)} (at {_word(rng)}) {_word(rng)}. {_word(rng)}"]))
        put(" " + " ".join(_word(rng) for _ in range(rng.integers(0, 3))) + pick(["", ".", ",", ""]) + " ")
        bare = bool(rng.random() < 0.25)
    return "".join(parts), gold


@functools.lru_cache(maxsize=1)
def trained(n: int = 2500, epochs: int = 6, seed: int = 5) -> SemiCRF:
    """Fitted by AdaGrad on generated lines; a few seconds, the same on every machine."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(n):
        text, gold = _sample(rng)
        cands = list(candidates(text))
        if cands and set(gold) <= {c[:3] for c in cands}:
            data.append((text, cands, set(gold)))
    model = SemiCRF(np.zeros((len(KINDS), N_FEATURES)), follow=-1.0)
    model.weights[:, 0] = -1
    seen = np.full_like(model.weights, 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            g = model.gradient(*data[k]) - 1e-4 * model.weights
            seen += g**2
            model.weights += 0.4 * g / np.sqrt(seen)
    return model


def find(text: str, model: SemiCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) of a text, each (start, end, kind number)."""
    base = base_spans(text)
    ends: list[int] = []  # of base spans by start, the farthest end so far
    for s, e, _ in base:
        ends.append(max(e, ends[-1] if ends else 0))
    starts = [s for s, _, _ in base]
    added = []
    for s, e, kind in model.best(text):
        k = bisect.bisect_left(starts, e)
        if not k or ends[k - 1] <= s:
            added.append((s, e, kind))
    return base, added


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs``."""
    weights, follow = trained().weights, trained().follow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCRF(weights, follow)
        for b in slices(batches, "text"):
            counts: list[list[int]] = [[], [], [], []]
            sha, all_ = [], []
            for text in b.column("text").to_pylist():
                base, added = find(text or "", model)
                for k in range(4):
                    counts[k].append(sum(x[2] == k for x in base))
                sha.append(hashlib.sha256(digest(base).encode()).hexdigest())
                all_.append(digest(base + added))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(all_, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind's mark."""
    out, pos = [], 0
    for s, e, k in sorted(found, key=lambda x: (x[0], x[2])):
        if s >= pos:
            out += [text[pos:s], f"<{KINDS[k].upper()}>"]
        pos = max(pos, e)
    return "".join([*out, text[pos:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; an integer column n_chars follows; a null text stays null."""
    weights, follow = trained().weights, trained().follow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCRF(weights, follow)
        for b in slices(batches, "text"):
            at = b.schema.get_field_index("text")
            texts = []
            for text in b.column(at).to_pylist():
                base, added = find(text or "", model)
                texts.append(masked(text, base + added) if text is not None else None)
            columns = list(b.columns)
            columns[at] = pa.array(texts, columns[at].type)
            n = b.schema.get_field_index("n_chars")
            if n >= 0 and pa.types.is_integer(columns[n].type):
                columns[n] = pa.array([len(t) if t is not None else c for t, c in zip(texts, columns[n].to_pylist(), strict=True)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
