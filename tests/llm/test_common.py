import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factlens.llm import bitmap, common

TEXT = st.text(alphabet="aAbZ09 .\t\n\x0b\x0c\r\x1f@é中`{[/:  ", max_size=40)


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for kind, pattern in ((common.SPACED, r"[^\x20\x09-\x0D]+"), (common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = common.words(pa.array(texts, pa.string()), kind, lower=True)
        for i, t in enumerate(texts):
            want = re.findall(pattern, lower(t))
            got = [lower(w.data[s:e].tobytes().decode()) for s, e in zip(w.start[w.ptr[i] : w.ptr[i + 1]], w.end[w.ptr[i] : w.ptr[i + 1]])]
            assert got == want
    seen = {}
    w = common.words(pa.array(texts, pa.string()), common.SPACED)
    for s, e, h in zip(w.start, w.end, w.hash):
        assert seen.setdefault(w.data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_slices():
    a, b = "x" * 1000, "x" * 999 + "y"
    w = common.words(pa.array([a, b, a]))
    assert w.hash[0] == w.hash[2] != w.hash[1]
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 5, 100, 1, 1, 1)] + [None]})
    parts = list(common.slices(iter([batch]), "text", 10))
    assert sum(p.num_rows for p in parts) == 7 and [p.num_rows for p in parts][:2] == [2, 1]
    # A slice has the same words as the whole.
    whole = common.words(batch.column("text"))
    assert np.array_equal(np.concatenate([common.words(p.column("text")).hash for p in parts]), whole.hash)


def test_grams():
    w = common.words(pa.array(["a b c d e", "a b", "", "a b c d", None, "b c d e"]))
    g, ptr = common.grams(w.hash, w.ptr, 4)
    assert np.diff(ptr).tolist() == [2, 1, 0, 1, 0, 1]
    assert g[0] == g[3] and g[1] == g[4] and len(set(g.tolist())) == 3
    assert np.array_equal(common.gram_windows(w.hash[:5], 4)[0], common.gram_windows(w.hash[7:11], 4)[0])


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [(5, 5)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()}
    assert got == {x: top(x) for x in parent}
    assert common.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark, "t")).count() == 0


def test_bitmap_has_no_false_negatives(spark):
    keys = spark.range(0, 5000).selectExpr("id * 7919 AS k")
    m = bitmap.build(keys, "k", bits=22).value
    inside = np.arange(5000, dtype=np.int64) * 7919
    assert bitmap.maybe(m, inside.view(np.uint64)).all()
    assert bitmap.maybe(m, (inside + 1).view(np.uint64)).mean() < 0.02
    assert not bitmap.maybe(bitmap.build(keys.limit(0), "k", bits=20).value, inside.view(np.uint64)).any()


def test_no_shared_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        class _jsc:
            class _Sc:
                @staticmethod
                def getCheckpointDir():
                    class Option:
                        isDefined = staticmethod(lambda: False)

                    return Option()

            sc = staticmethod(lambda: Context._jsc._Sc())

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
