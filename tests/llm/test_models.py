import sys
import zlib
from collections import defaultdict
from dataclasses import replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from corpus_helpers import ROOT, SMALL, prose
from pyspark.sql import functions as F

from factlens.llm.common import Scratch
from factlens.llm import packing, queries, quality, token_count, toxicity

MEDIUM = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def labelled(spark, docs_of, rng, n=600):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 4 == 0
        w = prose(rng, rng.randint(20, 120)).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "scummy", "vilefully", "wretchy"]))
        text = " ".join(f"{x}!!" for x in w).upper() if bad else " ".join(w)
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def check_shape(got, rows):
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1


def test_quality_separates_and_handles_odd_rows(spark, docs_of, rng, odd):
    rows, labels = labelled(spark, docs_of, rng)
    rows += [((i + 5000) if i is not None else None, t) for i, t in odd]
    got = quality.classify(docs_of(rows), labels).collect()
    check_shape(got, rows)
    y = {r.doc_id: r.quality for r in labels.collect()}
    out = [(r.predicted, y[r.doc_id]) for r in got if r.doc_id in y and r.held_out]
    assert np.mean([a == b for a, b in out]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_do_not_matter(spark, docs_of, rng):
    rows, labels = labelled(spark, docs_of, rng, 200)
    docs = docs_of(rows)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    for f in (quality.classify, toxicity.classify):
        a, b = ({r.doc_id: round(r.score, 9) for r in f(docs, x).collect()} for x in (labels, flipped))
        assert a == b


@pytest.mark.parametrize("f", [quality.classify, toxicity.classify])
def test_classifiers_without_rows_or_labels(spark, docs_of, odd, f):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], none.schema)
    for labels in (none, nulls):
        assert f(docs_of([]), labels).count() == 0
        check_shape(f(docs_of(odd), labels).collect(), odd)
    one = spark.createDataFrame([(4, 1, 1), (6, 1, 1), (7, 1, 1)], none.schema)
    check_shape(f(docs_of(odd), one).collect(), odd)


def test_keep_good_keeps_the_schema(spark, docs_of, rng):
    rows, labels = labelled(spark, docs_of, rng, 300)
    docs = docs_of(rows)
    out = quality.keep_good(docs, labels)
    assert out.schema == docs.schema
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in out.collect()} == good


def test_statistics_do_not_depend_on_neighbours(rng):
    texts = ["", None, "A b.", prose(rng, 200), "x " * 50, "é\n中!", "!!"]
    whole = quality.statistics(pa.array(texts))
    assert whole.shape == (len(texts), quality.N_STATS) and np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array([t], pa.string())), whole[i])


def brute_statistics(t):
    """The statistics of one text in plain Python."""
    import math
    import re
    from collections import Counter

    b = (t or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    size, n, low = len(b), len(w), [x.lower() for x in w]
    one, safe, sizes = max(size, 1), max(n, 1), [len(x) for x in w]
    share = lambda chars: sum(c in chars for c in b) / one
    of = lambda f: sum(map(f, w)) / safe
    mean = sum(sizes) / safe
    punct = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
    upper, lower = share(bytes(range(65, 91))), share(bytes(range(97, 123)))
    lines, distinct = b.count(b"\n") + (size > 0), len(set(low))
    return [
        math.log1p(size), math.log1p(n), min(mean, 40), min(math.sqrt(max(sum(x * x for x in sizes) / safe - mean**2, 0)), 40), upper, lower, upper / max(upper + lower, 1e-9), share(b"0123456789"), share(punct),
        share(b".,"), share(b"!"), share(b"?"), share(b"|"), share(b"%&$#*"), share(b"<>{}[]()=/;_"), share(b"'\"-:"), share(bytes(range(128, 256))), share(b" \t\r\x0b\x0c\n"), math.log1p(lines), math.log1p(one / max(lines, 1)),
        distinct / safe, math.log1p(distinct) / math.log1p(safe + 1), max(Counter(low).values(), default=0) / safe, sum(x == y for x, y in zip(low, low[1:])) / safe,
        of(lambda x: x[-1] in punct), of(lambda x: 65 <= x[0] <= 90), of(lambda x: len(x) <= 3), of(lambda x: len(x) >= 15), of(lambda x: len(x) == 1),
        -sum(c / one * math.log(c / one) for c in Counter(b).values()),
    ]


def test_statistics_equal_brute_force(rng):
    texts = ["", None, "A b. a B", prose(rng, 80).title(), "x " * 50, "é\n中!\n\n", "!! || 12,5 <b>", "a\tb\x0bc" * 9, "w" * 60]
    assert np.allclose(quality.statistics(pa.array(texts, pa.string())), [brute_statistics(t) for t in texts], atol=1e-9)


def test_ridge_and_features_equal_one_direct_solution(spark, docs_of, rng):
    """Partition sums give the weights of one dense solve, and the waves the kernel that they approximate."""
    rows, labels = labelled(spark, docs_of, rng, 300)
    model = quality.fit(quality.features(docs_of(rows)), labels, waves=64)
    y = {r.doc_id: r.quality for r in labels.collect()}
    own = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    x = model.expand(quality.statistics(pa.array([t for _, t in own])))
    d, target = x.shape[1], np.array([y[i] for i, _ in own], float)
    reg = np.eye(d) * 1e-3 * len(x)
    reg[0, 0] = 0
    assert np.allclose(x @ np.linalg.solve(x.T @ x + reg + np.eye(d) * 1e-9, x.T @ target), x @ model.weights, atol=1e-6)
    g = np.random.default_rng(0)
    scale = np.sqrt((model.freq**2).mean())
    wide = replace(model, freq=g.normal(size=(quality.N_STATS, 8192)) * scale, phase=g.uniform(0, 2 * np.pi, 8192))
    assert abs(scale * np.sqrt(quality.N_STATS / 2) - 1) < 0.05
    s = quality.statistics(pa.array([t for _, t in rows[:40]]))
    z = np.clip((s - wide.mean) / wide.scale, -8, 8)
    waves = wide.expand(s)[:, 1 + quality.N_STATS :]
    gap = ((z[:, None] - z[None]) ** 2).sum(-1)
    assert np.abs(waves @ waves.T - np.exp(-gap / quality.N_STATS)).max() < 0.08


def test_isotonic_is_the_least_squares_rising_fit(rng):
    g = np.random.default_rng(0)
    for _ in range(50):
        n = g.integers(1, 20, 8).astype(float)
        pos = np.minimum(g.integers(0, 20, 8), n).astype(float)
        x, v = quality.isotonic(np.arange(8.0), pos, n)
        assert (np.diff(v) >= 0).all() and (np.diff(x) > 0).all()
    x, v = quality.isotonic(np.array([0.0, 1, 2]), np.array([1.0, 0, 2]), np.array([2.0, 2, 2]))
    assert np.allclose(x, [0.5, 2]) and np.allclose(v, [1.5 / 5, 2.5 / 3])


def test_toxicity_separates(spark, docs_of, rng, odd):
    rows, labels = labelled(spark, docs_of, rng)
    rows += [((i + 5000) if i is not None else None, t) for i, t in odd]
    got = toxicity.classify(docs_of(rows), labels).collect()
    check_shape(got, rows)
    y = {r.doc_id: r.toxic for r in labels.collect()}
    out = [(r.predicted, y[r.doc_id]) for r in got if r.doc_id in y and r.held_out]
    assert np.mean([a == b for a, b in out]) > 0.97


def brute_segments(score):
    """Maximal segments by their definition: split at the best subsequence, again and again."""
    out = []

    def split(lo, hi):
        best = None
        for i, j in combinations(range(lo, hi + 1), 2):
            s = sum(score[i:j])
            if s > 1e-9 and (best is None or s > best[0] + 1e-9 or (abs(s - best[0]) <= 1e-9 and j - i < best[2] - best[1])):
                best = (s, i, j)
        if best:
            split(lo, best[1])
            out.append((best[1], best[2]))
            split(best[2], hi)

    split(0, len(score))
    return out


def test_maximal_segments(rng):
    for _ in range(200):
        n = rng.randint(1, 12)
        s = {i: rng.choice([0.37, 0.9, 1.71]) + rng.random() / 100 for i in range(n) if rng.random() < 0.4}
        full = [s.get(i, -0.5) for i in range(n)]
        got = toxicity.maximal_segments(list(s), list(s.values()), cost=0.5)
        assert [(a, b) for a, b, _ in got] == brute_segments(full)
        assert all(abs(x - sum(full[a:b])) < 1e-9 for a, b, x in got)


def test_the_law_holds_on_simulated_sequences():
    g = np.random.default_rng(0)
    for score, p in (([1.0, 2.0, 3.0], [0.03, 0.01, 0.004]), ([2.5], [0.01]), ([0.5, 1.5], [0.1, 0.02])):
        lam, log_k = toxicity.extreme_value(np.array(score), np.array(p))
        x = [*np.array(score), -toxicity.COST]
        assert sum(a * np.exp(lam * b) for a, b in zip([*p, 1 - sum(p)], x)) == pytest.approx(1)
        n, best = 2000, []
        for _ in range(1500):
            k = np.searchsorted(np.cumsum(p), g.random(n))
            at = np.flatnonzero(k < len(p))
            best.append(max((s for _, _, s in toxicity.maximal_segments(at.tolist(), np.array(score)[k[at]].tolist())), default=0.0))
        for x in np.quantile(best, [0.5, 0.8, 0.95]):
            seen, law = np.mean(np.array(best) >= x - 1e-9), 1 - np.exp(-n * np.exp(log_k - lam * x))
            assert abs(seen - law) < 0.12 and 0.6 < law / seen < 1.5
    assert toxicity.extreme_value(np.array([5.0]), np.array([0.5])) == (0.0, 0.0)
    assert toxicity.extreme_value(np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def brute_lexicon(rows, y, strength=20.0, sigmas=1.5, margin=1.0):
    """The token scores in plain Python."""
    import re

    def own(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        return {*((x, "") for x in w), *((x.encode()[:k], k) for x in w for k in toxicity.STEMS if len(x.encode()) > k)}

    freq, bad, good = defaultdict(int), defaultdict(int), defaultdict(int)
    size = [0, 0]
    for i, t in rows:
        for x in own(t):
            freq[x] += 1
        if i in y and zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            size[y[i]] += 1
            for x in own(t):
                (bad if y[i] else good)[x] += 1
    out = []
    for x, b in bad.items():
        prior = 0.5 + strength * freq[x] / len(rows)
        d = np.log((b + prior) / (size[1] + strength - b)) - np.log((good[x] + prior) / (size[0] + strength - good[x]))
        s = d - sigmas * np.sqrt(1 / (b + prior) + 1 / (good[x] + prior)) - margin
        if s >= toxicity.STEP:
            out.append(np.floor(s / toxicity.STEP) * toxicity.STEP)
    return sorted(out)


def test_lexicon_equals_brute_force(spark, docs_of, rng):
    rows, labels = labelled(spark, docs_of, rng, 300)
    docs = docs_of(rows)
    model = toxicity.fit_lexicon(docs, toxicity.labelled_rows(docs, labels, Scratch(spark, "test")))
    want = brute_lexicon(rows, {r.doc_id: r.toxic for r in labels.collect()})
    assert len(want) > 3 and np.allclose(sorted(model.scores), want, atol=1e-6)


def test_ids_of_any_type(spark, docs_of, rng):
    rows, labels = labelled(spark, docs_of, rng, 300)
    docs, named = docs_of(rows), labels.withColumn("doc_id", F.col("doc_id").cast("string"))
    for f in (quality.classify, toxicity.classify):
        a = {str(r.doc_id): round(r.score, 9) for r in f(docs, labels).collect()}
        assert a == {r.doc_id: round(r.score, 9) for r in f(docs.withColumn("doc_id", F.col("doc_id").cast("string")), named).collect()}


def test_toxic_spans(spark, docs_of, rng):
    rows, labels = labelled(spark, docs_of, rng)
    docs = docs_of(rows)
    model = toxicity.fitted(docs, labels)
    text = prose(rng, 50) + " vilest scummy wretchy " + prose(rng, 50)
    got = toxicity.toxic_spans(docs_of([(1, text), (2, None), (3, prose(rng, 80))]), model).collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(1, 50, 53)] and got[0].e_value < 1


def brute_pack(lengths, caps, attention, overhead):
    """The same rule by plain scans."""
    bins, out = [], []
    for k, n in enumerate(lengths):
        open_ = [(size - used, b) for b, (size, used) in enumerate(bins) if size - used >= n]
        if open_:
            b = min(open_)[1]
        else:
            b, cost = len(bins), []
            for c in caps:
                if c >= n:
                    room = c - n
                    for x in lengths[k + 1 :]:
                        room -= x if x <= room else 0
                    cost.append(((c * (1 + c / attention) + overhead) / (c - room), -c))
            bins.append([-min(cost)[1], 0])
        out.append((b, bins[b][1]))
        bins[b][1] += n
    return out, [min(c for c in caps if c >= used) for _, used in bins]


def test_best_fit_equals_plain_scans(rng):
    for _ in range(300):
        caps = sorted(rng.sample([4, 8, 10, 16, 32], rng.randint(1, 4)))
        attention, overhead = rng.choice([10, 40, 1000]), rng.choice([0, 1, 5])
        lengths = sorted((rng.randint(1, caps[-1]) for _ in range(rng.randint(0, 40))), reverse=True)
        bins, offs, final = packing.best_fit(np.array(lengths, np.int64), caps, attention, overhead)
        want, sizes = brute_pack(lengths, caps, attention, overhead)
        assert list(zip(bins.tolist(), offs.tolist())) == want and final.tolist() == sizes


def cheapest(lengths, caps, cost):
    """The least cost over all ways to share chunks out to bins."""
    def down(k, loads):
        if k == len(lengths):
            return sum(cost(min(c for c in caps if c >= x)) for x in loads)
        ways = [down(k + 1, [*loads[:i], x + lengths[k], *loads[i + 1 :]]) for i, x in enumerate(loads) if x + lengths[k] <= caps[-1]]
        return min([*ways, down(k + 1, [*loads, lengths[k]])])

    return down(0, [])


def test_sizes_are_chosen_jointly(rng):
    over = []
    for _ in range(60):
        caps = (8, 16, 32)
        lengths = sorted((rng.randint(1, 32) for _ in range(7)), reverse=True)
        cost = lambda c: packing.bin_cost(c, 48, 1)
        _, _, final = packing.best_fit(np.array(lengths), caps, 48, 1)
        over.append(sum(map(cost, final.tolist())) / cheapest(lengths, caps, cost))
    assert min(over) > 1 - 1e-9 and np.mean(over) < 1.05 and max(over) < 1.35
    g = np.random.default_rng(0)
    lengths = np.sort(np.minimum(np.exp(g.normal(6.5, 1.2, 5000)).astype(int) + 1, 16384))[::-1]
    _, _, final = packing.best_fit(lengths)
    _, _, single = packing.best_fit(lengths, [16384])
    assert set(final.tolist()) == set(packing.LENGTHS) and final.sum() <= 1.002 * single.sum()
    assert sum(map(packing.bin_cost, final.tolist())) < 0.85 * sum(map(packing.bin_cost, single.tolist()))


def test_packing_is_a_round_trip(spark, docs_of, rng, odd, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_CHUNKS", 40)
    pieces = token_count.load_pieces(queries.PIECES)
    counter = token_count.Counter(pieces)
    rows = odd + [(100 + i, prose(rng, rng.choice([3, 30, 900]))) for i in range(120)] + [(7, "again"), (999, "y" * 9_000), (998, " 中文 x" * 300)]
    docs = docs_of(rows).withColumn("row", F.lit("x")).withColumn("piece", F.lit(1)).withColumn("bin_id", F.lit(2))
    caps = (64, 256, 1024)
    out = packing.pack(docs, pieces, caps).collect()
    tokens, ends, bins = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in out:
        tokens[r.doc_id] += r.n_tokens
        ends[r.doc_id].append((r.start, r.end))
        bins[r.bin_id].append(r)
    want = defaultdict(int)
    for i, t in rows:
        want[i] += counter.count(t) + 1
    # The long runs of 8 and 999 are one word each, cut and counted in pieces.
    assert set(tokens) == set(want) and all(tokens[i] == n for i, n in want.items() if i not in (8, 999))
    assert all(abs(tokens[i] - want[i]) <= 60 for i in (8, 999))
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert [r.offset for r in b] == np.concatenate(([0], np.cumsum([r.n_tokens for r in b])[:-1])).tolist()
        used, cap = sum(r.n_tokens for r in b), b[0].capacity
        assert used <= cap and cap == min(c for c in caps if c >= used)
    assert len({b[0].capacity for b in bins.values()}) > 1
    packs = packing.sequences(docs, pieces, caps).collect()
    assert sorted((r.capacity, r.n_tokens) for r in packs) == sorted((b[0].capacity, sum(r.n_tokens for r in b)) for b in bins.values())
    back = defaultdict(list)
    for r in packs:
        assert sum(r.lengths) == r.n_tokens <= r.capacity
        for d, c, t in zip(r.doc_ids, r.chunks, r.texts, strict=True):
            back[d].append((c, t))
    once = {i for i, _ in rows if i is not None and sum(j == i for j, _ in rows) == 1}
    assert {i: "".join(t for _, t in sorted(back[i])) for i in once} == {i: t or "" for i, t in rows if i in once}
    assert sum(len(v) for v in back.values()) == len(out)
    assert packing.pack(docs_of([]), pieces).count() == 0 and packing.sequences(docs_of([]), pieces).count() == 0
    assert packing.pack(docs_of([(1, None), (2, "")]), pieces, end_mark=False).count() == 0


def test_held_out_accuracy_on_the_test_tables(spark):
    y = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    got = queries.op10_quality(spark, MEDIUM).where("held_out").collect()
    assert np.mean([r.predicted == y[r.doc_id].quality for r in got if r.doc_id in y]) >= 0.95
    got = queries.op2_toxicity(spark, MEDIUM).where("held_out").collect()
    assert np.mean([r.predicted == y[r.doc_id].toxic for r in got if r.doc_id in y]) >= 0.9


def test_pipeline_equals_its_stages_by_brute_force(spark, rng):
    sys.path.insert(0, ROOT)
    import corpus_pipeline as p
    from test_dedup import brute_near
    from test_scans import brute_hits

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(p.STAGES)
    good = stages["quality_filter"](spark, docs, SMALL)
    assert good.columns == docs.columns
    want = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 1").collect()}
    rows = good.select("doc_id", "text").collect()
    assert {r.doc_id for r in rows} == want
    kept = stages["near_dedup"](spark, good, SMALL)
    first = {int(c) for _, _, c in brute_near([(r.doc_id, r.text) for r in rows], 5)}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == first
    clean = stages["decontamination"](spark, kept, SMALL)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {int(d) for d, *_, bad in brute_hits([(r.doc_id, r.text) for r in rows if r.doc_id in first], items) if not bad}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == left
    masked = stages["mask_personal_data"](spark, clean, SMALL)
    assert masked.columns == docs.columns and {r.doc_id for r in masked.collect()} == left
    counter = token_count.Counter(token_count.load_pieces(queries.PIECES))
    packed = p.run(spark, SMALL).collect()
    tokens, texts = defaultdict(int), defaultdict(list)
    for r in packed:
        for d, c, n, t in zip(r.doc_ids, r.chunks, r.lengths, r.texts, strict=True):
            tokens[d] += n
            texts[d].append((c, t))
    assert tokens == {r.doc_id: counter.count(r.text) + 1 for r in masked.collect()}
    assert {d: "".join(t for _, t in sorted(x)) for d, x in texts.items()} == {r.doc_id: r.text for r in masked.collect()}


def test_pipeline_stages_on_odd_rows(spark, docs_of, odd, tmp_path):
    sys.path.insert(0, ROOT)
    import corpus_pipeline as p

    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").limit(0).write.parquet(f"{sf}/benchmark.parquet")
    for rows in (odd, []):
        docs = docs_of(rows)
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.schema == docs.schema
            # Equal sets of words in 6 and 7 are near duplicates, and so are the rows of 4 and 5.
            gone = {5, 7} if name == "near_dedup" else set()
            assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(i), str(t)) for i, t in rows if i not in gone)
        packs = p.STAGES[-1][1](spark, docs, sf).collect()
        assert sorted(str(d) for r in packs for d in r.doc_ids) == sorted(str(i) for i, _ in rows)
