import subprocess
import sys

import pytest

from factlens import __main__ as cli
from factlens.config import Config
from factlens.operators import lenses, snapshot
from factlens.plans import reports
from factlens.sources import extract


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_pointers_are_followed_to_their_ends(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), *((f"n{i:02}", f"n{i + 1:02}") for i in range(20))], "id string, to string")
    got = dict(pairs(lenses.follow(p)))
    assert got == {"a": "c", "b": "c", "d": "c", **{f"n{i:02}": "n20" for i in range(20)}}
    assert lenses.follow(p.limit(0)).count() == 0


def test_clusters(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), *((f"p{i:02}", f"p{i + 1:02}") for i in range(30)), ("q", "q")], "src string, dst string")
    got = dict(pairs(lenses.clusters(e)))
    assert {k: v for k, v in got.items() if not k.startswith("p")} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {v for k, v in got.items() if k.startswith("p")} == {"p00"}


SOURCE = {
    "a.ts": "import {P} from './p'; export class K extends P { run() { helper() } } function helper() {} function lonely() {}",
    "p.ts": "export class P { run() {} } export function start() { new P().run(); }",
}


@pytest.fixture
def fb(spark):
    return extract.extract(spark.createDataFrame(list(SOURCE.items()), "path string, text string"))


def test_overrides_and_dead_code(spark, fb):
    assert pairs(lenses.override_edges(fb)) == [("ts:a.ts:K.run", "ts:p.ts:P.run"), ("ts:p.ts:P.run", "ts:a.ts:K.run")]
    got = pairs(lenses.override_blast_radius(fb, spark.createDataFrame([("ts:a.ts:helper",)], "seed string")).select("id"))
    assert got == [("ts:a.ts:K.run",), ("ts:p.ts:P.run",)]
    assert "ts:a.ts:lonely" in {r.entityId for r in lenses.dead_code(fb).collect()}
    assert pairs(lenses.definitions(fb, "run").select("entityId")) == [("ts:a.ts:K.run",), ("ts:p.ts:P.run",)]


def test_questions(fb):
    answers = reports.questions(fb)
    assert len(answers) == 6 and {a.question for a in answers if not a.answered} == {"what does a runtime-installed method dispatch to"}
    assert all(a.rows.count() >= 0 for a in answers)
    assert set(reports.statistics(fb)) >= {"facts", "resolution", "collisions"}


def test_preview(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "g string, o int")
    assert pairs(reports.preview(df, "g", "o", 2)) == [("a", 0), ("a", 1), ("b", 1)]


def test_versions_of_a_source_are_matched(spark):
    old = "export function f(a: number) { const x = a + 1; return x * f(a) }\nclass K { m(p: string) { return p.length + p.length } }\nfunction gone() { return [1, 2, 3].map(String).join('-') }"
    new = "export function g(a: number) { const x = a + 1; return x * g(a) }\nclass L { m(p: string) { return p.length + p.length } }\nfunction added() { return { a: 1, b: 2, c: 3, d: [4, 5, 6] } }"
    files = spark.createDataFrame([("s1", "a.ts", old), ("s2", "a.ts", new)], "sha string, path string, text string")
    r = extract.snapshot_records(extract.snapshot_raw(files))
    a, b = (r.where(f"sha = '{s}'") for s in ("s1", "s2"))
    d = snapshot.diff(a, b)
    names = {x.ord: x.name for x in a.collect()}, {x.ord: x.name for x in b.collect()}
    got = {(x.cat, names[0].get(x.a), names[1].get(x.b)) for x in d.collect()}
    assert {("rename", "f", "g"), ("rename_owner", "K.m", "L.m"), ("removed", "gone", None), ("added", None, "added")} <= got
    assert {x.entityId for x in a.collect()} >= {"ts:a.ts:K.m"}
    assert {r["cat"] for r in snapshot.examples(d, 1).collect()} == {c for c, *_ in got}
    scores = snapshot.scheme_scores(d, a, b, ["entityId", "structureId"])
    snapshot.check_unchanged(scores)


def test_commit_gate_and_rates(spark):
    meta = spark.createDataFrame([("s1", 120, None, 90, 100), ("s2", 50, None, 50, 50), ("s3", 200, "boom", 0, 0)], "sha string, files int, error string, joined int, declKeys int")
    assert pairs(snapshot.quality_gate(meta)) == [("s1",)]
    assert tuple(snapshot.rates(meta).first()) == (2, 90.0, 100.0, 95.0)
    rows = spark.createDataFrame([("c1", "rename"), ("c1", "rename"), ("c2", "rename")], "child string, cat string")
    assert pairs(snapshot.changing_commits(rows)) == [("rename", 3, 2)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "src").mkdir()
    for name, text in SOURCE.items():
        (tmp_path / "src" / name).write_text(text)
    out = str(tmp_path / "facts")
    assert cli.main(["extract", "--target", str(tmp_path / "src"), "--out", out], spark) == 0
    assert cli.main(["ask", "--out", out], spark) == 0
    assert "CANNOT ANSWER" in capsys.readouterr().out
    (tmp_path / "src" / "b.ts").write_text("function q(x, x) {} const z = 1; function z2(p) { const p = 2 }")
    assert cli.main(["extract", "--target", str(tmp_path / "src"), "--out", out], spark) == 1
    monkeypatch.setenv("FACTLENS_MIN_NODES", "7")
    monkeypatch.setenv("FACTLENS_LOCAL_REFERENCES", "true")
    assert (Config.from_env().min_nodes, Config.from_env().local_references) == (7, True)


def test_functions_run_where_the_package_is_not_installed(tmp_path):
    """Executors get functions by value."""
    root = __file__.rsplit("/tests/", 1)[0]
    code = f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()\nfrom factlens.sources import extract\nprint('ROWS', extract.raw_facts(s.createDataFrame([('a.ts', 'f()')], 'path string, text string')).where(\"kind = 'calls'\").count())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]
