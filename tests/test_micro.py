"""Small fact bases with answers worked out by hand."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens import schema
from factlens.facts import FactBase
from factlens.operators import graph, hygiene, integrity, metrics, relations, runtime, snapshot


@pytest.fixture
def base(spark):
    """A fact base from (kind, dict) pairs; ``ord`` is the position."""

    def make(*facts):
        rows = [{"kind": k, "ord": i, **f} for i, (k, f) in enumerate(facts)]
        struct = T.StructType([*schema.FACT.fields, T.StructField("ord", T.LongType())])
        return FactBase.of(spark.createDataFrame([tuple(r.get(f.name) for f in struct.fields) for r in rows], struct))

    return make


def decl(i, t="function", file="a.ts", **kw):
    return "declaration", {"entityId": i, "entityType": t, "name": kw.get("name", i), "file": file, "exported": True}


def call(a, b, **kw):
    return "calls", {"callerId": a, "calleeId": b, "calleeName": kw.get("name", b or "?"), "confidence": 0.9 if b else 0.3, "reason": "resolved" if b else "unresolved", "callerKind": kw.get("kind", "function"), "file": kw.get("file", "a.ts"), "line": kw.get("line", 1)}


def contains(m, e):
    return "contains", {"containerId": f"module:{m}", "entityId": e}


def imp(a, b, name="x", form="named"):
    return "import", {"importerFile": a, "exportedBy": b, "importedName": name, "importType": form}


def reexp(a, b, name=None):
    return "reexport", {"barrel": a, "source": b, "reexportedName": name}


def ref(caller, target, ctx, file):
    return "references", {"callerId": caller, "targetId": target, "name": target, "ctx": ctx, "confidence": 0.9, "reason": "resolved", "callerKind": "function", "file": file, "line": 3}


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def seeds(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "seed string")


def test_closure_on_a_cycle_leaves_the_seed_out(spark, base):
    fb = base(call("a", "b"), call("b", "c"), call("c", "a"), call("d", "c"), call("e", "e"), call("a", None))
    e = relations.entity_calls(fb)
    got = pairs(graph.closure(e, seeds(spark, "a", "e", "zz"), reverse=True).select("seed", "id"))
    assert got == [("a", "b"), ("a", "c"), ("a", "d")]
    assert pairs(graph.closure(e, seeds(spark, "d")).select("seed", "id")) == [("d", "a"), ("d", "b"), ("d", "c")]


def test_deep_chain(spark):
    e = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(25)], "src string, dst string")
    assert graph.closure(e, seeds(spark, "000")).count() == 25
    assert graph.all_pairs_closure(e, reflexive=False).count() == 25 * 26 // 2
    p = graph.shortest_path(e, spark.createDataFrame([("000", "004"), ("004", "000"), ("003", "003")], "src string, dst string"))
    assert pairs(p) == [("000", "004", 4, "000>001>002>003>004"), ("003", "003", 0, "003"), ("004", "000", None, None)]


def test_shortest_path_breaks_ties_by_the_smallest_parent(spark):
    e = spark.createDataFrame([("s", "b"), ("s", "a"), ("b", "t"), ("a", "t"), ("t", "u"), ("s", "s")], "src string, dst string")
    p = graph.shortest_path(e, spark.createDataFrame([("s", "u")], "src string, dst string")).first()
    assert (p.hops, p.path) == (3, "s>a>t>u")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=14))
def test_closure_laws(spark, edges):
    df = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    s = seeds(spark, *map(str, range(7)))
    got = set(pairs(graph.closure(df, s).select("seed", "id")))
    want = set()
    for x in range(7):
        todo, seen = [x], set()
        while todo:
            v = todo.pop()
            for a, b in edges:
                if a == v and b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(str(x), str(y)) for y in seen if y != x}
    assert got == want


def test_merged_symbol_is_no_violation_and_does_not_fan_out(base):
    fb = base(decl("m", "interface"), decl("m", "variable"), decl("k", "class"), decl("k", "variable"), decl("c", "variable"), decl("c", "parameter"), call("k", "m"))
    got = {r.entityId: r.violation for r in integrity.ambiguous_ids(fb).collect()}
    assert got == {"m": False, "k": False, "c": True}
    assert relations.last_declaration(fb).count() == 3
    assert hygiene.dead_end_calls(fb).count() == 0  # the last row of m is a variable
    with pytest.raises(integrity.IntegrityError):
        integrity.assert_invariants(fb)


def test_dangling_ends(base):
    fb = base(decl("a"), decl("b"), call("a", "gone"), call("ghost", "b"), call("a", "b"), call("a", None))
    assert pairs(integrity.closure_violations(fb)) == [("calls", "dst", "gone", 1), ("calls", "src", "ghost", 1)]
    assert pairs(integrity.closed_edges(fb)) == [("calls", 1)]
    integrity.assert_invariants(base(decl("a"), decl("b"), call("a", "b"), call("a", None)))


def test_deleting_a_declaration_gives_exactly_its_ends(base):
    facts = [decl(x) for x in "abc"] + [call("a", "b", line=1), call("a", "b", line=2), call("b", "c"), call("c", "a")]
    assert integrity.closure_violations(base(*facts)).count() == 0
    assert {(r.endpoint, r.n) for r in integrity.closure_violations(base(*facts[:1], *facts[2:])).collect()} == {("dst", 2), ("src", 1)}


def tree_facts():
    return [
        decl("a1", file="a.ts"), decl("b1", file="b.ts"), decl("c1", file="c.ts"), decl("module:a.ts", "module", "a.ts"), decl("module:b.ts", "module", "b.ts"), decl("module:c.ts", "module", "c.ts"), decl("module:i.ts", "module", "i.ts"),
        contains("a.ts", "a1"), contains("b.ts", "b1"), contains("c.ts", "c1"), reexp("i.ts", "b.ts"), reexp("i.ts", "c.ts", "c1"),
    ]


def test_a_barrel_is_cleared_only_through_its_closure(base):
    fb = base(*tree_facts(), imp("a.ts", "i.ts"), call("a1", "b1", file="a.ts"), imp("a.ts", "c.ts", form="type-named"), imp("a.ts", "external:p"))
    assert hygiene.dead_imports(fb).count() == 1  # file-scoped, without the closure
    assert [tuple(r)[:3] for r in hygiene.evidence_tiers(fb).orderBy("tier").collect()] == [(k, 1, 0) for k in range(4)]
    assert pairs(metrics.pure_barrels(fb)) == [("i.ts",)]


def test_type_evidence_clears_at_the_last_tier(base):
    fb = base(*tree_facts(), imp("a.ts", "b.ts"), ref("a1", "b1", "type", "a.ts"), imp("a.ts", "c.ts"), ref("a1", "c1", "typeof", "a.ts"), imp("b.ts", "c.ts"))
    assert [r.flagged for r in hygiene.evidence_tiers(fb).orderBy("tier").collect()] == [3, 3, 2, 1]
    assert pairs(hygiene.type_only_signatures(fb)) == [("function", 1)]


def test_a_pass_through_is_not_considered(base):
    fb = base(*tree_facts(), imp("i.ts", "b.ts"), imp("i.ts", "a.ts"))
    assert pairs(hygiene.dead_imports(fb).select("importerFile", "exportedBy")) == [("i.ts", "a.ts")]


def test_a_cycle_of_barrels_has_the_true_closure(base):
    fb = base(reexp("A", "B"), reexp("A", "C"), reexp("B", "A"))
    got = pairs(hygiene.reexport_closure(fb))
    assert ("B", "C") in got and ("A", "A") in got and len(got) == 6


def test_module_callers_and_targets_out_of_scope(base):
    fb = base(*tree_facts(), call("module:a.ts", "b1", file="a.ts"), call("a1", "x:out", file="a.ts"))
    assert pairs(relations.module_calls(fb)) == [("a.ts", "b.ts")]


def test_first_and_last_wins(base):
    fb = base(*tree_facts(), reexp("i.ts", "a.ts"), contains("c.ts", "a1"), imp("a.ts", "i.ts", "zz"))
    assert dict(pairs(relations.entity_module(fb)))["a1"] == "c.ts"
    assert pairs(relations.module_imports_one_hop(fb)) == [("a.ts", "b.ts")]  # the file's last declaration is its module; the first star is b.ts


def joined_rows(spark, df):
    """(rows of df, the most rows that one of its joins gives)."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = pairs(df)
        todo, most = [df._jdf.queryExecution().executedPlan()], 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            most = max(most, node.metrics().get("numOutputRows").get().value())
        todo.extend(node.children().apply(k) for k in range(node.children().size()))
    return rows, most


def test_the_first_match_of_a_hop(base):
    modules = [decl(f"module:{f}", "module", f) for f in ("a.ts", "b.ts", "c.ts", "d.ts", "i.ts", "j.ts")]
    one = lambda *facts: pairs(relations.module_imports_one_hop(base(*modules, *facts)))
    name, star = reexp("i.ts", "b.ts", "x"), reexp("i.ts", "c.ts")
    assert one(imp("a.ts", "i.ts"), name, star) == [("a.ts", "b.ts")]
    assert one(imp("a.ts", "i.ts"), star, name) == [("a.ts", "c.ts")]
    assert one(imp("a.ts", "i.ts", "y"), name, star) == [("a.ts", "c.ts")]
    assert one(imp("a.ts", "i.ts", "y"), name) == [("a.ts", "i.ts")]  # no match: the barrel stays
    assert one(imp("a.ts", "i.ts"), reexp("i.ts", "d.ts", "x"), name) == [("a.ts", "d.ts")]
    assert one(imp("a.ts", "i.ts"), reexp("i.ts", "gone.ts"), name) == []
    assert one(imp("a.ts", "i.ts", None), name, star) == [("a.ts", "c.ts")]  # a star needs no name
    assert one(imp("a.ts", "i.ts"), imp("a.ts", "j.ts"), imp("d.ts", "i.ts", "y"), name, reexp("j.ts", "i.ts")) == [("a.ts", "b.ts"), ("a.ts", "i.ts"), ("d.ts", "i.ts")]


def test_a_busy_barrel_does_not_pair_its_imports_with_its_reexports(spark, base):
    n = 60
    modules = [decl(f"module:{f}", "module", f) for f in ("a.ts", "b.ts", "i.ts")]
    fb = base(*modules, *(imp("a.ts", "i.ts", f"x{k}") for k in range(n)), *(reexp("i.ts", "b.ts") for _ in range(n)), *(reexp("i.ts", "b.ts", f"x{k}") for k in range(n)))
    found = relations.module_imports_one_hop(fb)
    rows, most = joined_rows(spark, found)
    assert rows == [("a.ts", "b.ts")] and most <= 2 * n
    assert " OR " not in found._jdf.queryExecution().optimizedPlan().toString()  # joined by names, not filtered


def test_accidental_deps_do_not_pair_children_or_barrels_row_by_row(spark, base):
    n = 40
    inherits = lambda c: ("extends", {"childId": c, "parentName": "Base", "parentId": None})
    facts = [decl(f"module:{f}", "module", f) for f in ("a.ts", "b.ts", "i.ts", "z.ts")]
    for k in range(n):
        facts += [decl(f"m{k}.Base", "class", f"m{k}.ts", name="Base"), contains(f"m{k}.ts", f"m{k}.Base"), decl(f"child{k}"), contains("a.ts", f"child{k}"), inherits(f"child{k}")]
        facts += [imp("a.ts", "i.ts", f"x{k}"), reexp("i.ts", "b.ts"), imp("a.ts", f"m{k}.ts", "Base")]
    facts += [decl("use", file="a.ts"), contains("a.ts", "use"), decl("used", file="z.ts"), contains("z.ts", "used"), call("use", "used"), imp("a.ts", "z.ts", "used")]
    rows, most = joined_rows(spark, hygiene.accidental_deps_v1(base(*facts)))
    assert rows == [("a.ts", "b.ts")]  # the Base modules are inherited from, z.ts is called
    assert most < n * n // 4


def test_dedup_is_null_safe_and_idempotent(base, spark):
    rows = [("calls", "a", None, 1, 0), ("calls", "a", None, 1, 5), ("calls", "a", None, 2, 2), ("calls", "a", "b", 1, 3)]
    df = spark.createDataFrame(rows, "kind string, callerId string, calleeId string, line int, ord long")
    once = relations.dedup(df)
    assert sorted((r.line, r.calleeId or "", r.ord) for r in once.collect()) == [(1, "", 0), (1, "b", 3), (2, "", 2)]
    assert relations.dedup(once).count() == 3


def test_coupling_counts_import_facts(base):
    fb = base(imp("a", "b", "x"), imp("a", "b", "y"), imp("a", "b", "z"), imp("b", "a"), imp("a", "a"))
    assert pairs(metrics.coupling(fb)) == [("a", "b", 3)]
    assert pairs(metrics.mutual_imports(fb)) == [("a", "b", 2)]


def test_three_levels_of_heritage(spark, base):
    h = lambda k, c, p: (k, {"childId": c, "parentName": p or "?", "parentId": p})
    fb = base(h("extends", "i2", "i1"), h("implements", "c", "i2"), h("extends", "d", None))
    e = fb.heritage().where("parentId is not null").select(F.col("parentId").alias("src"), F.col("childId").alias("dst"))
    assert pairs(graph.closure(e, seeds(spark, "i1")).select("id")) == [("c",), ("i2",)]
    assert dict(pairs(integrity.question_verdicts(fb)))["what implements this interface"] is False


SNAP = "file string, name string, type string, fp string, n int, ord long, entityId string, structureId string"


def snap(spark, *rows):
    return spark.createDataFrame([(f, n, t, fp, size, i, f"{f}:{n}", fp) for i, (f, n, t, fp, size) in enumerate(rows)], SNAP)


def test_nine_categories(spark):
    a = snap(spark, ("f", "same", "t", "1", 20), ("f", "edit", "t", "2", 20), ("f", "old", "t", "3", 20), ("f", "p.x", "t", "4", 20), ("f", "mv", "t", "5", 20), ("f", "both", "t", "6", 20), ("f", "u", "t", "7", 20), ("f", "v", "t", "7", 20), ("f", "gone", "t", "8", 20), ("f", "small", "t", "9", 3), ("f", "dup", "t", "a", 20), ("f", "dup", "t", "b", 20))
    b = snap(spark, ("f", "same", "t", "1", 20), ("f", "edit", "t", "2x", 20), ("f", "new", "t", "3", 20), ("f", "q.x", "t", "4", 20), ("g", "mv", "t", "5", 20), ("g", "other", "t", "6", 20), ("f", "w", "t", "7", 20), ("f", "small2", "t", "9", 3), ("f", "fresh", "t", "z", 20), ("f", "dup", "t", "a", 20))
    got = pairs(snapshot.diff(a, b).select("cat", "a", "b").fillna(-1))
    assert got == sorted([("unchanged", 0, 0), ("body_edit", 1, 1), ("rename", 2, 2), ("rename_owner", 3, 3), ("move", 4, 4), ("rename_move", 5, 5), ("ambiguous", 6, -1), ("removed", 8, -1), ("removed", 9, -1), ("added", -1, 7), ("added", -1, 8)])
    assert {r[0] for r in got} == set(schema.CATEGORIES)


def test_each_record_is_classified_once(spark):
    import random

    rng = random.Random(3)
    make = lambda: [(rng.choice("fg"), rng.choice(["x", "y", "o.x", "z"]), rng.choice("ts"), rng.choice("123"), rng.choice([5, 20])) for _ in range(25)]
    for _ in range(3):
        a, b = snap(spark, *make()), snap(spark, *make())
        d = snapshot.diff(a, b)
        for side, t in (("a", a), ("b", b)):
            used = [r[0] for r in d.where(f"{side} is not null and cat <> 'ambiguous'").select(side).collect()]
            assert len(used) == len(set(used)) and set(used) <= {r.ord for r in snapshot.records(t).collect()}


def test_scheme_outcomes(spark):
    a = snap(spark, ("f", "x", "t", "1", 20), ("f", "y", "t", "2", 20), ("f", "z", "t", "3", 20))
    b = snap(spark, ("f", "x", "t", "1", 20), ("f", "y", "t", "3", 20), ("f", "n", "t", "2", 3))
    scores = snapshot.scheme_scores(snapshot.diff(a, b), a, b, ["entityId", "structureId"])
    got = {(r.cat, r.scheme, r.outcome): r.n for r in scores.collect()}
    assert got[("unchanged", "entityId", "survive")] == 1 and got[("body_edit", "entityId", "survive")] == 1
    assert got[("body_edit", "structureId", "alias")] == 1 and got[("removed", "structureId", "reappear")] == 1
    assert got[("removed", "entityId", "none")] == 1 and got[("added", "structureId", "reappear")] == 1
    snapshot.check_unchanged(scores)


RUN = "run long, ord long, callerId string, calleeId string, samples long, viaNative boolean, callerResolved boolean, calleeResolved boolean, callerTier string, calleeTier string, callerFrame string, calleeFrame string"


def edge(i, a, b, tier="exact", run=0, n=1):
    return (run, i, a, b, n, False, tier != "none", True, tier, "exact", f"F{a}", f"F{b}")


def test_runtime_against_static(spark, base):
    r = spark.createDataFrame([edge(0, "A", "X"), edge(1, "X", "B"), edge(2, "A", "B"), edge(3, "S", "S"), edge(4, "A", "module:m"), edge(5, "W", "A", "external"), edge(6, "A", "X", run=1, n=4)], RUN)
    calls = base(call("A", "X"), call("X", None))["calls"]
    assert pairs(runtime.shortcuts(runtime.pairs(r))) == [("A", "B")]
    assert {k: n for k, n, *_ in pairs(runtime.novelty(r, calls))} == {"static": 1, "self_loop": 1, "module_callee": 1, "function_to_function": 2}
    m = {(x.callerId, x.calleeId): (x.samples, x.runs) for x in runtime.merge(r).collect()}
    assert m[("A", "X")] == (5, 2) and m[("A", "B")] == (1, 1)
    g = runtime.closure_gain(r, calls, seeds(spark, "B")).first()
    assert (g.static_n, g.exact_n, g.joined_n, g.added) == (0, 2, 2, 2)


def test_profile_tree(spark):
    rows = [(1, 0, None, True, "r", 1), (1, 1, 0, False, "n", 2), (1, 2, 1, True, "a", 3), (1, 3, 2, True, "b", 4), (1, 4, 0, True, "b", 5), (2, 0, None, False, "x", 7)]
    t = spark.createDataFrame(rows, "p int, node int, parent int, corpus boolean, frame string, hits long")
    assert pairs(graph.tree_inclusive(t, ["p"], "hits")) == [(1, 0, 15), (1, 1, 9), (1, 2, 7), (1, 3, 4), (1, 4, 5), (2, 0, 7)]
    assert [tuple(r) for r in graph.collapse_tree(t, ["p"]).orderBy("node").collect()] == [(1, 0, None, False), (1, 2, 0, True), (1, 3, 2, False), (1, 4, 0, False)]
    assert pairs(runtime.frame_edges(t, ["p"])) == [("<workload>", "r", False, 15), ("a", "b", False, 4), ("r", "a", True, 7), ("r", "b", False, 5)]


def test_many_pairs_are_matched_each_by_itself(spark):
    s = "child string, file string, name string, type string, fp string, n int, ord long, entityId string"
    rows = lambda *x: spark.createDataFrame([(c, "f", n, "class", fp, 20, k, f"{c}{n}") for k, (c, n, fp) in enumerate(x)], s)
    a = rows(("p", "x", "1"), ("q", "x", "1"), ("q", "y", "2"))
    b = rows(("p", "z", "1"), ("q", "x", "1"), ("q", "w", "9"))
    d = snapshot.diff(a, b, by=("child",))
    assert sorted((r.child, r.cat) for r in d.collect()) == [("p", "rename"), ("q", "added"), ("q", "removed"), ("q", "unchanged")]


def test_event_clusters_by_hand(spark):
    e = spark.createDataFrame([("c1", "removed", "s", "reappear", i, n) for i, n in (("a", 5), ("b", 1))] + [("c2", "removed", "s", "reappear", "a", 2)], "child string, cat string, scheme string, outcome string, id string, size long")
    r = snapshot.event_clusters(e).first()
    assert (r.raw, r.events, r.distinct_ids, r.commits, r.without_top, r.top_sizes, r.top_commits) == (8, 3, 2, 2, 1, "5,2,1", "c1:6 c2:2")
