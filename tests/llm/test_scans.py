import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from corpus_helpers import prose
from pyspark.sql import functions as F

from factlens.llm import common, decontaminate, license_scan, pii, queries, token_count
from factlens.llm.license_texts import TEMPLATES


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_hits(rows, items, n=13):
    windows = {}
    for item, t in items:
        w = re.findall(WORD, lower(t))
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item) if item is not None else "null")
    lengths = {len(x) for x in windows}
    out = []
    for d, t in rows:
        w = re.findall(WORD, lower(t))
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        out.append((str(d), len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block_words", [2_000_000, 120])
def test_contamination_equals_brute_force(spark, docs_of, rng, odd, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    items = [(i, prose(rng, rng.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(25)] + [(3, prose(rng, 20)), (90, None), (91, " .. "), (None, prose(rng, 15)), (92, "the the " * 12), (93, "é中 ß")]
    texts = [t for _, t in items if t]
    rows = [((i + 500) if i is not None else None, t) for i, t in odd]
    for i in range(40):
        part = rng.choice(texts).upper().replace(" ", ", ") if i % 2 else " ".join(rng.choice(texts).split()[1:])
        rows.append((i, f"{prose(rng, rng.randint(0, 200))}\n{part} {prose(rng, rng.randint(0, 30))}"))
    rows += [(60, "the " * 100), (61, " ".join(texts))]
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, n_words string")
    got = decontaminate.contamination(docs_of(rows), bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r.items), r.contaminated) for r in got) == brute_hits(rows, items)
    by_doc, by_item = {}, {}
    for i, t in rows:
        by_doc.setdefault(str(i), []).append(re.findall(WORD, lower(t)))
    for i, t in items:
        by_item.setdefault(str(i) if i is not None else "null", []).append(re.findall(WORD, lower(t)))
    for r in got:
        assert r.n_items == len(r.items) and {m.item for m in r.matches} == set(r.items)
        held = set()
        for m in r.matches:
            held.update(range(m.start, m.end))
            ok = [(d, x) for d in by_doc[str(r.doc_id)] for x in by_item[m.item] if d[m.start : m.end] == x[m.item_start : m.item_start + m.end - m.start] and len(d[m.start : m.end]) == m.end - m.start]
            # It can't be longer, and is a window at least.
            assert any(d[m.end : m.end + 1] != x[m.item_start + m.end - m.start :][:1] or m.end == len(d) for d, x in ok) and any(m.end - m.start >= min(13, len(x)) for _, x in ok)
        assert len(held) == r.n_hit


def test_matches_of_items_side_by_side(spark, docs_of, rng):
    a, b = prose(rng, 40), " ".join(f"w{k}" for k in range(30))
    w = a.split()
    bench = spark.createDataFrame([("a", a), ("b", b), ("c", "the " * 40)], "item_id string, text string")
    text = " ".join([*w[5:25], *b.split()[:20], "gap", *w[:15], *["the"] * 60])
    docs = docs_of([(1, text)]).withColumn("n_words", F.lit("x"))
    got = [r for r in decontaminate.contamination(docs, bench).collect()[0].matches if r.item != "c"]
    assert [(m.item, m.item_start, m.start, m.end) for m in got] == [("a", 0, 41, 56), ("a", 5, 0, 20), ("b", 0, 20, 40)]
    the = [(m.item_start, m.start, m.end) for m in decontaminate.contamination(docs, bench).collect()[0].matches if m.item == "c"]
    assert the == [(0, 56, 96), (0, 84, 116)]
    tagged = decontaminate.scan(docs, bench, tag="x_")
    assert tagged.columns == [*docs.columns, "x_n_words", "x_n_hit", "x_items", "x_matches"] and tagged.collect()[0].n_words == "x"


def test_keep_clean(spark, docs_of, rng):
    items = [(1, prose(rng, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(1, items[0][1]), (2, "none of it"), (3, None), (2, "again"), (4, prose(rng, 5000) + " " + " ".join(items[0][1].split()[:13]))])
    out = decontaminate.keep_clean(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 2, 3, 4]
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == 5
    assert decontaminate.keep_clean(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("top", [3, 300, 70_000])
def test_suffix_array_finds_all_places(top):
    g = np.random.default_rng(top)
    seq = g.integers(0, top + 1, 400)
    array = decontaminate.SuffixArray(seq.copy(), top, 13)
    for m in (1, 2, 5, 13):
        want = [g.integers(1, top + 1, m) for _ in range(20)] + [seq[i : i + m] for i in range(0, 380, 7) if (seq[i : i + m] > 0).all()]
        lo, hi = array.find(np.array(want, np.int64))
        for w, a, b in zip(want, lo, hi):
            assert sorted(array.order[a:b].tolist()) == [i for i in range(len(seq) - m + 1) if (seq[i : i + m] == w).all()]


def brute_base(t):
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for k, p in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 2 and 12 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((*m.span(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_equal_the_patterns(rng):
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789.@+- ()ab_%é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_base(t)
    long = "1" * 50_000 + ".2.3 " + "a" * 50_000 + "@b " + "4" * 100_000
    assert pii.base_spans(long) == []


def random_lines(rng, n):
    """Lines of pieces that candidates are made of, in any order."""
    pieces = ["at", " at ", "[at]", " (at) ", "@", " @ ", ".", " dot ", "[dot]", "[.]", "-", " ", " ", "  ", "(", ")", "+", "/", ", ", "jane", "doe", "com", "org", "tel ", "isbn ", "card: ", "212", "555", "0199", "4111", "1111", "10", "7", "1234567", "a1", "_", "\n", "é"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 16))) for _ in range(n)]


DOTS = r"(?:\.| ?[\[({<] ?(?:\.|(?i:dot|punkt|point|punto)) ?[\])}>] ?| (?i:dot|punkt|point|punto) )"
PART = r"[A-Za-z0-9]+"
MARKS = r"(?: ?@ ?| ?[\[({<] ?(?i:at|@) ?[\])}>] ?)"


def brute_candidates(t):
    """The candidates' definition, tried on every span."""
    address = re.compile(rf"(?P<l>{PART}(?:[._%+-]{PART}|{DOTS}{PART})*)(?:{MARKS}(?P<d>[A-Za-z0-9-]+(?:{DOTS}[A-Za-z0-9-]+)+)| (?i:at) (?P<b>[A-Za-z0-9][A-Za-z0-9-]*(?:{DOTS}[A-Za-z0-9-]+)+))")
    quad = re.compile(rf"([0-9]{{1,3}})(?P<x> \. |{DOTS})([0-9]{{1,3}})(?P=x)([0-9]{{1,3}})(?P=x)([0-9]{{1,3}})")
    out = set()
    for s in range(len(t)):
        for e in range(s + 4, len(t) + 1):
            x = t[s:e]
            if t[e - 1 : e + 1].isdigit() and e < len(t) and t[e].isdigit() or x[0].isdigit() and s and t[s - 1].isdigit():
                continue
            m = quad.fullmatch(x)
            if m and all(int(m[k]) <= 255 for k in (1, 3, 4, 5)):
                out.add((s, e, 1))
            d = re.sub("[^0-9]", "", x)
            if 12 <= len(d) <= 19 and pii.luhn(d) and re.fullmatch(r"[0-9]{12,}|([0-9]{3,})([ .-])(?:[0-9]{3,}\2)*[0-9]+", x):
                out.add((s, e, 2))
    return out


def test_card_and_ip_candidates_equal_their_definition(rng):
    seen = 0
    numbers = ["".join(rng.choice(["10", "7", "255", "300"]) + sep * (k < 4) for k in range(5)) for sep in (".", "[.]", " . ", " dot ", "-") for _ in range(12)]
    numbers += [" ".join(rng.choice(["4111", "1111", "378282246310005", "555", "6011 0000"]) for _ in range(4)) for _ in range(60)]
    for t in random_lines(rng, 500) + numbers + ["4111 1111 1111 1111 212", "10.7.10.7.10 x", "10[.]7[.]10[.]7", "7 . 7 . 7 . 7"]:
        want = {c for c in brute_candidates(t) if sum(ch.isdigit() and (i == 0 or not t[c[0] : c[1]][i - 1].isdigit()) for i, ch in enumerate(t[c[0] : c[1]])) <= pii.MAX_PARTS}
        # A card's last group but for its end can be one of several digits only.
        want = {c for c in want if c[2] == 1 or not re.search(r"[ .-][0-9]$", t[c[0] : c[1]])}
        got = {c[:3] for c in pii.candidates(t) if c[2] in (1, 2)}
        assert got == want, t
        seen += len(got)
    assert seen > 20


def brute_best(model, text, cands):
    """The best total over all segmentations, by recursion over what may come next."""
    gain = [float(model.weights[c[2]] @ np.array(c[3])) for c in cands]

    def down(end):
        top = 0.0
        for c, v in zip(cands, gain):
            if c[0] >= end:
                top = max(top, v + (model.follow if end > 0 and not text[end : c[0]].strip() else 0) + down(c[1]))
        return top

    return down(0), gain


def test_segmentation_equals_enumeration(rng):
    g = np.random.default_rng(1)
    some = 0
    for t in random_lines(rng, 400) + [pii._sample(g)[0] for _ in range(60)]:
        model = pii.SemiCRF(g.normal(size=(4, pii.N_FEATURES)), follow=-0.7)
        cands = list(pii.candidates(t))
        if len(cands) > 9:
            continue
        want, gain = brute_best(model, t, cands)
        got = model.best(t)
        value = sum(gain[[c[:3] for c in cands].index(x)] for x in got)
        value += sum(model.follow for a, b in zip(got, got[1:]) if not t[a[1] : b[0]].strip())
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:])) and value == pytest.approx(want), t
        some += len(got)
    assert some > 50


def test_gradient_equals_enumerated_expectations():
    g = np.random.default_rng(3)
    done = 0
    while done < 15:
        text, gold = pii._sample(g)
        cands = list(pii.candidates(text))
        if not 1 < len(cands) < 9 or not set(gold) <= {c[:3] for c in cands}:
            continue
        done += 1
        model = pii.SemiCRF(g.normal(size=(4, pii.N_FEATURES)) / 3, follow=-0.7)
        ways = []

        def walk(end, chosen, score):
            ways.append((chosen, score))
            for c in cands:
                if c[0] >= end:
                    v = float(model.weights[c[2]] @ np.array(c[3])) + (model.follow if chosen and not text[end : c[0]].strip() else 0)
                    walk(c[1], [*chosen, c], score + v)

        walk(0, [], 0.0)
        z = np.logaddexp.reduce([s for _, s in ways])
        want = np.zeros_like(model.weights)
        for chosen, s in ways:
            for c in chosen:
                want[c[2]] -= np.exp(s - z) * np.array(c[3])
        for c in cands:
            if c[:3] in gold:
                want[c[2]] += np.array(c[3])
        assert np.allclose(model.gradient(text, cands, set(gold)), want)


def test_spans_equal_brute_force(rng):
    m = pii.trained()
    g = np.random.default_rng(9)
    for t in random_lines(rng, 300) + [pii._sample(g)[0] for _ in range(100)]:
        base, added = pii.find(t, m)
        assert base == brute_base(t)
        cands = list(pii.candidates(t))
        if len(cands) <= 9:
            want, gain = brute_best(m, t, cands)
            chosen = m.best(t)
            value = sum(gain[[c[:3] for c in cands].index(x)] for x in chosen) + sum(m.follow for a, b in zip(chosen, chosen[1:]) if not t[a[1] : b[0]].strip())
            assert value == pytest.approx(want)
            assert added == [x for x in chosen if not any(x[0] < b[1] and b[0] < x[1] for b in base)]


#: Written by hand, not by the training generator.
HIDDEN = [
    ("please {} now", "john.smith at example dot com", 0), ("please {} now", "john at example dot com", 0), ("write to {} today", "jane.doe [at] research.example [dot] org", 0),
    ("{}", "jane.doe at universityofsomewhere dot edu", 0), ("mail: {}", "alexandra.montgomery-smithson [at] informatics [dot] universityofsomewhere [dot] edu", 0),
    ("see {}, or not", "johnathan.longname.withparts.and.more.parts(at)example.org", 0), ("ask {}.", "x.y(at)z.org", 0), ("mail {} please", "john dot smith at example dot co dot uk", 0), ("at {} only", "a@b[.]com", 0),
    ("the server {} is down", "10[.]0[.]0[.]1", 1), ("we saw {} again", "192 dot 168 dot 1 dot 20", 1), ("pay {} now", "4111.1111.1111.1111", 2),
    ("call {} or come", "555-0199", 3), ("Tel {}", "06 12 34 56 78", 3), ("dial {} now", "1-800-555-0199", 3), ("{} ext", "(212) 555-0100", 3), ("Phone: {}", "020 7946 0958", 3), ("my number: {}", "212-555-0100", 3), ("fax {},", "030/1234567", 3),
]
CLEAN = """meet at 12.30 on 2024-01-02|isbn 978-3-16-148410-0|id 100 200 300 400|look at this. It works|order 123-4567890-1234567|in 1998-2004 and 2005-2010|version 1.2.3.4567
1,234,567.89 in all|100 200 300 400|doi 10.1000/12345.6789012|he is at example dot matrix|see page 12 34 56 78 90|we met at noon dot dot dot|pi is 3.14159265358979|ISSN 1234-5678|lat 48.8584 2.2945
sales of 2019 2020 2021 2022|look at google.com|12 34 56 78 90 11|nothing here, at all, in 1999 or on page 12.|2024-01-02 12:30:45|from 12.5 to 13.75 or 14.25|at 10:30 at the dot|a = b @ c.d|total 12345 67890""".replace("\n", "|").split("|")


@pytest.mark.parametrize(("frame", "value", "kind"), HIDDEN)
def test_hidden_data_is_found_whole(frame, value, kind):
    text = frame.format(value)
    s = text.index(value)
    for before in ("", "Words in front of it, and a " + "long" * 50 + " one. "):
        assert pii.find(before + text, pii.trained())[1] == [(len(before) + s, len(before) + s + len(value), kind)]


@pytest.mark.parametrize("text", CLEAN)
def test_other_numbers_and_words_stay(text):
    assert pii.find(text, pii.trained()) == ([], [])


def test_the_field_on_unseen_generated_lines():
    m, g = pii.trained(), np.random.default_rng(77)
    hits = found = all_ = 0
    for _ in range(400):
        text, gold = pii._sample(g)
        got = set(m.best(text))
        hits, found, all_ = hits + len(got & set(gold)), found + len(got), all_ + len(gold)
    assert hits / found > 0.95 and hits / all_ > 0.95


@pytest.mark.parametrize("text", ["a" * 500_000 + "1" + "b" * 500_000, "中" * 500_000 + " 1 " + "é" * 500_000, "1" * 1_000_000, "a1" * 250_000, "+1" * 250_000, "1" + " " * 1_000_000 + "2", "+1" + "(" * 1_000_000])
def test_long_runs_take_linear_time(text):
    import time

    m = pii.trained()
    took = []
    for n in (len(text) // 4, len(text)):
        t = time.perf_counter()
        pii.find(text[:n], m)
        took.append(time.perf_counter() - t)
    assert took[1] < 5 and took[1] < 12 * took[0] + 0.5


def test_spans_and_redaction(spark, docs_of, odd):
    text = "é mail a.b@c.de or 1.2.3.4, card 4111 1111 1111 1111, call +49 (30) 1234567!"
    docs = docs_of([(20, text), *odd])
    rows = pii.spans(docs).collect()
    assert len(rows) == len(odd) + 1
    r = next(r for r in rows if r.doc_id == 20)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    base = pii.digest(brute_base(text))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(r.spans.split(","))
    for name, s, e in (x.split(":") for x in r.spans.split(",")):
        assert text[int(s) : int(e)].strip() == text[int(s) : int(e)]
    out = pii.redact(docs)
    assert out.schema == docs.schema
    got = next(r for r in out.collect() if r.doc_id == 20)
    assert got.text == "é mail <EMAIL> or <IP>, card <CARD>, call <PHONE>!" and got.n_chars == len(got.text)
    assert sum(r.text is None for r in out.collect()) == 2
    assert pii.spans(docs.limit(0)).count() == 0


def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_count.load_pieces(queries.PIECES)
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return pieces, t


def test_token_counts_equal_the_library(spark, docs_of, rng, odd):
    pieces, t = unigram()
    rows = odd + [(100 + i, x) for i, x in enumerate([" ", "  ", "a", "▁", "▁▁a", "\n", "\n\n a", "中文 字\n", "<s> </s><unk>", "x" * 300])]
    rows += [(200 + i, "".join(rng.choice("abthe in\n\t 中é▁<0x41>ß.,") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    got = token_count.token_counts(docs_of(rows), pieces).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(t.encode(x or "").ids)) for i, x in rows)
    assert token_count.token_counts(docs_of([]), pieces).count() == 0


def test_ties_go_to_the_longer_last_piece():
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), ("aa", -2.0)]
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    c = token_count.Counter(pieces, byte_fallback=False)
    for w in ("abc", "aab", "aaa", "abcabc", "xaxxb", "xx", "aaaaabc"):
        assert c.word(w) == len(t.encode(w).ids), w


def test_token_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 3)
    c = token_count.Counter([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0)])
    assert c.count("a aa aaa aaaa aaaaa") == 5 + 15 and len(c.seen) <= 3
    assert c.counts(pa.array(["", None, "a", "", " ", "\n", "a  a", ""], pa.string())).tolist() == [0, 0, 2, 0, 1, 2, 5, 0]


def lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(max(p[j + 1], q[-1], p[j] + (x == y)))
        p = q
    return p[-1]


def test_alignment_equals_the_longest_common_subsequence():
    g = np.random.default_rng(0)
    for _ in range(300):
        a, b = g.integers(0, 6, g.integers(1, 15)), g.integers(0, 6, g.integers(1, 25))
        got = license_scan.align(a, b, -len(a), len(b))
        assert len(got) == lcs(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def hashed(text):
    return common.words(pa.array([text]), common.ALNUM, lower=True).hash


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [w, prose(rng, 1)] if x < 2 * rate / 3 else [prose(rng, 1)] if x < rate else [w]
    return out


def test_matches_equal_the_longest_common_subsequence(rng):
    """One template, edited at random: the place is found, with the coverage that brute force measures."""
    for name, full in license_scan.TEMPLATES.items():
        if len(full.split()) < 30:
            continue
        index = license_scan.build_index({name: full})
        tpl = re.findall(WORD, lower(full))
        for rate in (0.0, 0.04, 0.08, 0.12):
            body = edited(rng, tpl, rate)
            text = f"{prose(rng, 30)} {' '.join(body)} {prose(rng, 30)}"
            want = lcs(tpl, re.findall(WORD, text))
            got = license_scan.matches(hashed(text), index, 0.8)
            if want >= 0.84 * len(tpl):
                assert len(got) == 1, (name, rate, want / len(tpl))
            for _, cover, s, e in got:
                assert want - 3 <= round(cover * len(tpl)) <= want and 27 <= s <= 36 and abs(e - s - len(body)) <= 6
        assert license_scan.matches(hashed(" ".join(reversed(tpl))), index, 0.8) == []
        half = len(tpl) // 2
        assert license_scan.matches(hashed(" ".join(tpl[half:] + prose(rng, 40).split() + tpl[:half])), index, 0.8) == []


@pytest.mark.parametrize("n", [15, 25, 60])
def test_words_put_in_do_not_part_a_license(rng, n):
    for name in ("MIT", "BSD-3-Clause", "GPL-3.0-header"):
        w = TEMPLATES[name].split()
        text = " ".join([*w[:50], *prose(rng, min(n, len(w) // 2 - 3)).split(), *w[50:]])
        got = license_scan.matches(hashed(text), license_scan.build_index(TEMPLATES), 0.8)
        assert [(license_scan.build_index(TEMPLATES).names[x[0]], x[1]) for x in got] == [(name, 1.0)]


def test_licenses(spark, docs_of, rng, odd):
    mit = TEMPLATES["MIT"]
    changed = mit.replace("Software", "Program", 3).replace("without restriction", "with no restriction at all")
    rows = [*odd, (20, f"{prose(rng, 40)}\n{mit}\n{prose(rng, 10)}"), (21, changed), (22, " ".join(mit.split()[:60])), (24, mit + "\n" + prose(rng, 300) + "\n" + mit), (25, mit + "\n" + mit)]
    rows += [(23, "This is under the MIT License. We share it under CC BY-NC 4.0. And CC BY. And under the Apache License, Version 1.1, or under the terms of no License.")]
    rows += [(30 + k, TEMPLATES[x]) for k, x in enumerate(TEMPLATES)]
    got = [(r.doc_id, r.license, r.coverage, r.start_word, r.end_word) for r in license_scan.scan(docs_of(rows)).orderBy("doc_id", "start_word").collect()]
    assert [x[:2] for x in got if x[0] < 30] == [(20, "MIT"), (21, "MIT"), (23, "MIT-notice"), (23, "CC-BY-NC-4.0-short"), (24, "MIT"), (24, "MIT"), (25, "MIT"), (25, "MIT")]
    assert [x[:3] for x in got if x[0] >= 30] == [(30 + k, x, 1.0) for k, x in enumerate(TEMPLATES)]
    n = len(re.findall(WORD, lower(mit)))
    assert got[0][2:] == (1.0, 40, 40 + n) and 0.8 <= got[1][2] < 1
    assert license_scan.scan(docs_of([])).count() == 0


def test_one_phrase_again_and_again_is_no_license():
    import time

    index = license_scan.build_index(TEMPLATES)
    t = time.perf_counter()
    assert license_scan.matches(hashed("permission is hereby granted free of charge " * 3000), index, 0.8) == []
    assert time.perf_counter() - t < 20


def test_winnowing_hits_every_shared_run():
    g = np.random.default_rng(2)
    index = license_scan.build_index(TEMPLATES)
    for h in index.words:
        n = license_scan.GRAM + license_scan.WINNOW - 1
        for s in range(0, len(h) - n + 1):
            run = common.gram_windows(h[s : s + n], license_scan.GRAM)
            assert np.isin(run, index.hashes).any()
    assert len(license_scan.winnow(g.integers(0, 99, 50).astype(np.uint64), 4)) >= 50 // 4 - 1
    assert pa.types.is_string(pa.array(["x"]).type)


@pytest.mark.parametrize("name", ["op3_decontaminate"])
def test_queries_equal_sql(same, name):
    same(queries.QUERIES[name], queries.SQL[name])
