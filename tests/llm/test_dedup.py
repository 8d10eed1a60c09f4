import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from corpus_helpers import prose

from factlens.llm import embedding_dedup, minhash_dedup, queries, substring_dedup


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def union_find(n, pairs):
    p = list(range(n))

    def top(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        p[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


def brute_near(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = []
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            same_id = rows[i][0] == rows[j][0]
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and (same_id or 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter)):
                links.append((j, i))
    top = union_find(len(rows), links)
    low = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top[i]] = d if low[top[i]] is None else min(low[top[i]], d)
    return sorted(((str(d), len(s), str(low[top[i]] if d is not None else None)) for i, ((d, _), s) in enumerate(zip(rows, sets))))


def near_rows(rng):
    rows, n = [], 0
    for g in range(12):
        base = prose(rng, rng.randint(30, 90)).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((n, " ".join(w).title() if n % 3 else " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, docs_of, rng, odd, k, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PART", 2)
    rows = near_rows(rng) + [((i + 1000) if i is not None else None, t) for i, t in odd]
    got = minhash_dedup.near_duplicates(docs_of(rows), k).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_near(rows, k)
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got)


def test_many_near_copies_stay_linked_through_chains(spark, docs_of, rng):
    # A chain: each text differs a little from the one before, the ends a lot.
    w, rows = prose(rng, 120).split(), []
    for i in range(60):
        rows.append((i, " ".join(w)))
        w = list(w)
        w[(i * 7) % 120] = f"c{i}"
    got = minhash_dedup.near_duplicates(docs_of(rows), 4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_near(rows, 4)


def test_keep_first_keeps_columns_and_one_of_each(spark, docs_of, rng):
    rows = near_rows(rng)
    docs = docs_of(rows)
    kept = minhash_dedup.keep_first(docs, 5)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute_near(rows, 5)}
    assert {str(r.doc_id) for r in kept.collect()} == want


def test_pairs_just_above_the_threshold_are_found(spark, docs_of, rng):
    """Recall of bands and sketch together, on planted pairs of similarity 0.80 to 0.82."""
    rows, want = [], []
    while len(want) < 150:
        w = [f"u{rng.random()}" for _ in range(rng.randint(60, 200))]
        v = list(w)
        for at in sorted(rng.sample(range(len(w)), max(1, round(len(w) * 0.026)))):
            v[at] = f"v{rng.random()}"
        a, b = ({tuple(x[i : i + 4]) for i in range(len(x) - 3)} for x in (w, v))
        if 0.8 <= len(a & b) / len(a | b) < 0.82:
            want.append(len(rows))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs_of(rows), 4).collect()}
    assert all(got[i + 1] == i for i in want)


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert minhash_dedup.keep_first(none).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(vec).count() == 0


def brute_passages(rows, n=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - n + 1):
                key = tuple(w[i : i + n])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        if d is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i : i + n])] < d:
                    gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [5, 50])
def test_passages_equal_brute_force(spark, docs_of, rng, odd, window):
    shared = [prose(rng, rng.choice([window - 1, window, window + 1, 3 * window])) for _ in range(6)]
    rows = [((i + 500) if i is not None else None, t) for i, t in odd]
    for i in range(40):
        rows.append((i, "\n".join([prose(rng, rng.randint(0, 40)), *(rng.choice(shared) for _ in range(rng.randint(0, 3))), prose(rng, rng.randint(0, 40))])))
    rows += [(90, "a " * 300), (91, "a " * 60), (92, "a " * (window - 1)), (93, rows[20][1]), (93, rows[20][1]), (93, rows[25][1]), (None, rows[20][1])]
    got = substring_dedup.repeated_passages(docs_of(rows), window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_passages(rows, window)


def test_removal_intervals_are_maximal(spark, docs_of, rng):
    shared = prose(rng, 80)
    rows = [(1, shared), (2, "own words here " + shared + " and after"), (3, prose(rng, 100))]
    got = substring_dedup.removal_intervals(docs_of(rows)).collect()
    assert [(r.doc_id, [(x.start, x.end) for x in r.removed], r.kept_text) for r in got] == [(2, [(3, 83)], "own words here and after")]


def brute_vectors(rows, cosine=0.9):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and rows[i][0] is not None:
            x = np.array(v, float)
            good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine]
    top = union_find(len(rows), links)
    return sorted((str(r[0]), sum(a == i for a, _ in links), str(rows[top[i]][0])) for i, r in enumerate(rows))


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    g = np.random.default_rng(3)
    rows = []
    for c in range(30):
        base = g.normal(size=12)
        for _ in range(int(g.integers(1, 12))):
            rows.append((len(rows), (base + g.normal(size=12) * g.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist()))
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 12), (n + 3, [1.0, None] * 6), (n + 4, [float("nan")] * 12), (n + 5, [float("inf")] * 12), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [1e30] * 12), (n + 9, [2e30] * 12)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, raw string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == brute_vectors(rows)


def test_repeated_and_null_vector_ids(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, v), (1, v), (2, v), (3, w), (3, v), (None, v)], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [("1", 2, "1", True)] * 2 + [("2", 2, "1", False)] + [("3", 2, "1", False)] * 2 + [("None", 0, "None", True)]


def test_blocks_of_other_clusters_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "TILE", 4)
    g = np.random.default_rng(8)
    base = g.normal(size=(24, 10))
    rows = [(k, (base[k % 24] + g.normal(size=10) * 0.05).astype(np.float32).tolist()) for k in range(24 * 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    r = embedding_dedup.skipped(df).collect()[0]
    assert r.dim == 10 and r.pairs == r.blocks * (r.blocks + 1) // 2 and r.compared < 0.5 * r.pairs
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == brute_vectors(rows)


def test_ids_of_any_type(spark, docs_of, rng):
    v, w = [1.0, 2.0], [2.0, -1.0]
    df = spark.createDataFrame([("a", v), ("b", v), ("c", w), (None, v)], "vec_id string, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [("None", 0, "None"), ("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]
    text = prose(rng, 80)
    docs = docs_of([(1, text), (2, "x " + text), (3, "y"), (None, text)])
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    for f in (substring_dedup.repeated_passages, minhash_dedup.near_duplicates):
        a, b = ([tuple(map(str, r)) for r in f(x).orderBy("doc_id").collect()] for x in (docs, named))
        assert a == b


@pytest.mark.parametrize("name", ["op1_minhash", "op5_substring", "op6_embeddings"])
def test_queries_equal_sql(same, name):
    same(queries.QUERIES[name], queries.SQL[name])
