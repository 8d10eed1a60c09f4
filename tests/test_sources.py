import base64
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from factlens import schema
from factlens.facts import FactBase
from factlens.functions import ids
from factlens.operators import integrity
from factlens.sources import facts_io, profiles, tree
from factlens.streaming import incremental


def one(spark, expr, **cols):
    return spark.createDataFrame([(*cols.values(), 1)], [*cols, "dummy"]).select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    ("path", "want"),
    [("src/a b.ts", "src/a_b.ts"), ("src\\x\\y.ts", "src/x/y.ts"), ("@s/p-1/i.d.ts", "@s/p-1/i.d.ts"), ("é(1).ts", "__1_.ts"), ("$a/_b.ts", "$a/_b.ts")],
)
def test_slug(spark, path, want):
    assert one(spark, ids.slug("p"), p=path) == want
    assert one(spark, ids.module_id("p"), p=path) == f"module:{want}"


def test_path_rules(spark):
    cases = [("node_modules/@s/p/i.d.ts", True, "@s/p"), ("x/node_modules/a/node_modules/b/c.ts", True, "b"), ("../x.ts", True, "unknown"), ("src/x.ts", False, "unknown"), ("node_modules/typescript/lib/lib.es5.d.ts", True, "typescript-lib")]
    for p, outside, origin in cases:
        assert one(spark, ids.is_external("p"), p=p) == outside
        assert one(spark, ids.external_origin("p"), p=p) == origin
    assert one(spark, ids.entity_id("p", F.lit("A.b")), p="src/x.ts") == "ts:src/x.ts:A.b"
    assert one(spark, ids.entity_id("p", F.lit("A")), p="node_modules/@s/p/i.ts") == "external:@s/p:A"
    assert one(spark, ids.relative("p", "/r/"), p="/r/a/b.ts") == "a/b.ts"
    assert one(spark, ids.resolve_path(F.lit("a/b"), "p"), p="./../c//d/../e.ts") == "a/c/e.ts"
    assert one(spark, ids.resolve_path(F.lit("a"), "p"), p="../../e.ts") == "../e.ts"
    assert one(spark, ids.directory("p"), p="a/b/c.ts") == "a/b" and one(spark, ids.directory("p"), p="c.ts") == ""
    assert one(spark, ids.import_candidates("p"), p="./x.js") == ["./x.ts", "./x.js.ts", "./x/index.ts", "./x.js/index.ts", "./x.d.ts", "./x/index.ts"]


def test_scalar_functions(spark):
    assert one(spark, ids.last_segment("n"), n="a.b.c") == "c" and one(spark, ids.last_segment("n"), n="c") == "c"
    assert one(spark, ids.name_roots("n"), n="u.f") == ["u.f", "u"] and one(spark, ids.name_roots("n"), n="f") == ["f"]
    assert one(spark, ids.as_file("n"), n="module:a/module:b") == "a/module:b"
    assert [one(spark, ids.space("t"), t=t) for t in ("interface", "class", "module", "variable", "?")] == ["type", "both", "ns", "value", "value"]
    assert one(spark, ids.percent(F.lit(1), F.lit(3))) == 33.3 and one(spark, ids.percent(F.lit(1), F.lit(0))) is None
    assert one(spark, ids.structure_id("s"), s="x") == "struct:sha256:2d711642b726b044"
    import hashlib

    want = hashlib.sha256((json.dumps('a"b') + "\0x").encode()).hexdigest()[:16]
    assert one(spark, ids.content_id(F.lit('a"b'), "s"), s="x") == f"content:sha256:{want}"


FACTS = [
    {"kind": "declaration", "entityId": "a", "entityType": "function", "name": "a", "file": "f.ts", "exported": True},
    {"kind": "declaration", "entityId": "a", "entityType": "function", "name": "a", "file": "f.ts", "exported": True},
    {"kind": "calls", "callerId": "a", "calleeName": "b", "confidence": 0.3, "reason": "unresolved", "callerKind": "function", "file": "f.ts", "line": 3},
    {"kind": "calls", "callerId": "a", "calleeName": "b", "confidence": 0.3, "reason": "unresolved", "callerKind": "function", "file": "f.ts", "line": 4},
    {"kind": "reexport", "barrel": "f.ts", "source": "g.ts"},
]


def test_json_to_parquet_and_back(spark, tmp_path):
    (tmp_path / "facts.json").write_text(json.dumps(FACTS, indent=2))
    raw = facts_io.read_json(spark, str(tmp_path / "facts.json"))
    assert [r.ord for r in raw.orderBy("ord").collect()] == [0, 1, 2, 3, 4]
    facts_io.write(raw, str(tmp_path / "base"), check=True)
    fb = FactBase.read(spark, str(tmp_path / "base"))
    assert fb["declaration"].count() == 1 and fb["calls"].count() == 2 and fb["contains"].count() == 0
    assert fb["calls"].where("calleeId is null").count() == 2 and fb["reexport"].first().reexportedName is None
    assert fb["calls"].columns == [f.name for f in schema.CALLS.fields] + ["ord"]
    facts_io.write_json(spark.read.parquet(str(tmp_path / "base")), str(tmp_path / "out"))
    back = [{k: v for k, v in r.asDict().items() if v is not None and k != "ord"} for r in facts_io.read_lines(spark, str(tmp_path / "out")).orderBy("ord").collect()]
    assert sorted(map(json.dumps, (dict(sorted(x.items())) for x in back))) == sorted({json.dumps(dict(sorted(x.items()))) for x in FACTS})
    fb.register("t_")
    assert spark.sql("SELECT count(*) FROM t_calls").first()[0] == 2


def test_facts_are_written_before_the_check_fails(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"kind": "calls", "callerId": "x", "calleeId": "y", "confidence": 0.9}]))
    with pytest.raises(integrity.IntegrityError):
        facts_io.write(facts_io.read_json(spark, str(tmp_path / "f.json")), str(tmp_path / "base"), check=True)
    assert spark.read.parquet(str(tmp_path / "base")).count() == 1
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        facts_io.read_json(spark, str(tmp_path / "bad.json")).count()


def test_runtime_upsert(spark, tmp_path):
    s = "callerFrame string, calleeFrame string, samples long, viaNative boolean, callerId string, ord long"
    first = spark.createDataFrame([("a", "b", 2, False, "A", 0), ("c", "d", 1, True, "C", 1)], s)
    first.drop("ord").withColumn("runs", F.lit(1).cast("long")).write.parquet(str(tmp_path / "m0"))
    new = spark.createDataFrame([("a", "b", 5, True, "other", 0), ("e", "f", 1, False, "E", 1)], s)
    facts_io.upsert_runtime(spark, new, str(tmp_path / "m0"), str(tmp_path / "m1"))
    got = {(r.callerFrame, r.calleeFrame): (r.samples, r.runs, r.viaNative, r.callerId) for r in spark.read.parquet(str(tmp_path / "m1")).collect()}
    assert got == {("a", "b"): (7, 2, True, "A"), ("c", "d"): (1, 1, True, "C"), ("e", "f"): (1, 1, False, "E")}


def test_first_runtime_upsert_needs_no_target(spark, tmp_path):
    new = spark.createDataFrame([("a", "b", 5, True, "A", 0)], "callerFrame string, calleeFrame string, samples long, viaNative boolean, callerId string, ord long")
    facts_io.upsert_runtime(spark, new, str(tmp_path / "none"), str(tmp_path / "m1"))
    facts_io.upsert_runtime(spark, new, str(tmp_path / "m1"), str(tmp_path / "m2"))
    assert [(r.samples, r.runs) for r in spark.read.parquet(str(tmp_path / "m2")).collect()] == [(10, 2)]


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    for name, n in (("a", 2), ("b", 50), ("c", 7)):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({"kind": "calls", "name": f"{name}{k}"}) + "\n" for k in range(n)))
    names = [f"{name}{k}" for name, n in (("a", 2), ("b", 50), ("c", 7)) for k in range(n)]
    for size in ("128m", "200"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert [r.name for r in facts_io.read_lines(spark, str(tmp_path)).orderBy("ord").collect()] == names
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_test_folders_are_path_segments(spark, tmp_path):
    for d in ("latests", "tests", "a b+c%"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.ts").write_text("x")
    assert sorted(r.path for r in tree.source_files(spark, str(tmp_path)).collect()) == ["a b+c%/x.ts", "latests/x.ts"]


def test_snapshots_are_replaced_by_commit(spark, tmp_path):
    p = str(tmp_path / "snaps")
    for sha, n in (("s1", 1), ("s2", 2), ("s1", 3)):
        facts_io.write_snapshot(spark.createDataFrame([(sha, f"f{i}") for i in range(n)], "sha string, file string"), p)
    assert facts_io.read_snapshot(spark, p, "s1").count() == 3 and facts_io.read_snapshot(spark, p, "s2").count() == 2
    assert facts_io.schemes(["file", "entityId", "contentId", "ids"]) == ["entityId", "contentId"]


def test_source_tree_and_history(spark, tmp_path):
    repo = tmp_path / "r"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    (repo / "src" / "tests").mkdir(parents=True)
    git("init", "-q")
    for k in range(4):
        (repo / "src" / "a.ts").write_text(f"export const a = {k};")
        (repo / "src" / "a.test.ts").write_text("x")
        (repo / "src" / "tests" / "b.ts").write_text("x")
        git("add", "-A")
        git("commit", "-q", "-m", f"c{k}", "--allow-empty")
    files = tree.source_files(spark, str(repo))
    assert [(r.path, r.text) for r in files.collect()] == [("src/a.ts", "export const a = 3;")]
    tree.register(spark)
    log = spark.read.format("commit_log").option("repository", str(repo)).load().orderBy("pair_ord").collect()
    assert [r.pair_ord for r in log] == [0, 1, 2] and log[0].child == log[1].parent
    df = spark.createDataFrame(log)
    assert tree.sampled_pairs(df, most=2).count() == 2 and tree.sampled_pairs(df).count() == 3
    assert tree.sampled_pairs(df, prefixes=[log[1].child[:9]]).first().child == log[1].child
    snaps = spark.read.format("snapshot_files").option("repository", str(repo)).option("shas", f"{log[0].parent},{log[2].child}").load()
    assert sorted((r.sha == log[0].parent, r.path, r.text) for r in snaps.collect()) == [(False, "src/a.ts", "export const a = 3;"), (True, "src/a.ts", "export const a = 0;")]


def test_history_of_a_repository(spark, tmp_path, capsys):
    from factlens.__main__ import main
    from factlens.plans import history

    repo, out = tmp_path / "r", str(tmp_path / "out")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    repo.mkdir()
    git("init", "-q")
    body = "(a: number) { const x = a + 1; const y = x * 2; return [x, y, a].map(String).join('-') }"
    versions = [f"export function f{body}\nexport function keep{body.replace('2', '3')}", f"export function g{body}\nexport function keep{body.replace('2', '3')}", f"export function g{body}\nexport function keep{body.replace('x * 2', 'x * 3 + a')}"]
    for v in versions:
        (repo / "a.ts").write_text(v)
        git("add", "-A")
        git("commit", "-q", "-m", "c")
    pairs = history.commit_pairs(spark, str(repo))
    assert len(history.collect(spark, str(repo), out, pairs)) == 3 and history.collect(spark, str(repo), out, pairs) == []
    got = history.compare(spark, out, pairs, least_files=1)
    # f's rename in one commit; keep's body, and the variable in it, in another.
    counts = {r.cat: (r.entities, r.commits) for r in got["categories"].collect()}
    assert counts["rename"] == (1, 1) and counts["body_edit"] == (2, 1) and counts["unchanged"][1] == 2
    assert [tuple(r) for r in got["commits"].collect()] == [(3, 3)] and got["rates"].first().least == 100.0
    one = {(r.cat, r.scheme, r.outcome): r.n for r in got["scores"].collect()}
    assert one["rename", "entityId", "vanish"] == 1 and one["rename", "structureId", "survive"] == 1
    assert main(["history", "--repository", str(repo), "--out", out, "--least-files", "1"], spark) == 0
    assert "0 commits read" in capsys.readouterr().out


def test_profiles(spark, tmp_path):
    frame = lambda f, u, ln: {"functionName": f, "scriptId": "1", "url": u, "lineNumber": ln, "columnNumber": 2}
    p = {"nodes": [{"id": 1, "callFrame": frame("(root)", "", -1), "children": [2]}, {"id": 2, "callFrame": frame("f", "file:///c/a%20b.ts", 4), "children": []}], "samples": [2, 2, 1]}
    (tmp_path / "x.cpuprofile").write_text(json.dumps(p))
    rows = {r.node: r for r in profiles.read_profile(spark, str(tmp_path / "x.cpuprofile")).collect()}
    assert (rows[2].parent, rows[2].hits, rows[2].line, rows[1].parent, rows[1].hits) == (1, 2, 5, None, 1)
    assert one(spark, profiles.in_corpus(F.col("u"), "/c"), u="file:///c/a%20b.ts") and not one(spark, profiles.in_corpus(F.col("u"), "/d"), u="file:///c/a.ts")


def test_source_maps(spark):
    assert profiles.decode_mappings("AAAA,IAAI;;AACA") == [(0, 0, 0, 0, 0), (0, 4, 0, 0, 4), (2, 0, 0, 1, 4)]
    m = base64.b64encode(json.dumps({"version": 3, "sources": ["a.ts"], "mappings": "AAAA,IAAI;;AACA"}).encode()).decode()
    scripts = spark.createDataFrame([("1", f"code\n//# sourceMappingURL=data:application/json;base64,{m}\n"), ("2", "no map"), ("3", "//# sourceMappingURL=data:application/json;base64,!!"), ("4", None)], "scriptId string, text string")
    seg = profiles.source_map_segments(scripts)
    assert {r.scriptId for r in seg.collect()} == {"1"}
    frames = spark.createDataFrame([("1", 0, 3), ("1", 0, 9), ("1", 1, 0), ("1", 2, 5), ("2", 0, 0)], "scriptId string, gline int, gcol int")
    got = {(r.gline, r.gcol): (r.source, r.line, r.col) for r in profiles.original_positions(frames, seg).collect()}
    assert got == {(0, 3): ("a.ts", 0, 0), (0, 9): ("a.ts", 0, 4), (2, 5): ("a.ts", 1, 4)}


def test_incremental_facts(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    seen = []

    def deliver(name, *rows):
        (src / name).write_text("\n".join(json.dumps({"kind": "calls", "callerId": c, "calleeId": "x", "source_file": f, "version": v, "arrived": "2024-01-01T00:00:00Z"}) for f, v, c in rows))
        stream = incremental.new_facts(incremental.read_stream(spark, str(src)))
        q = incremental.maintain(stream, table, str(tmp_path / "ck"), lambda now, kinds: seen.append((now.count(), kinds)))
        q.awaitTermination(120)
        assert q.exception() is None

    deliver("1.json", ("a.ts", 1, "p"), ("a.ts", 1, "q"), ("b.ts", 1, "r"))
    deliver("2.json", ("a.ts", 2, "p"))
    assert [s[0] for s in seen if s[1]] == [3, 2] and seen[0][1] == {"calls"}
