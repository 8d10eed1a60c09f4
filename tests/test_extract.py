import pytest

from factlens.facts import FactBase
from factlens.operators import hygiene, integrity, relations
from factlens.sources import extract, facts_io
from factlens.sources.typescript import parse, tokenize

A = """
import { B, type C, make as mk } from "./b.js";
import * as u from './lib';
import D, { E } from 'pkg/sub';
import { gone } from "./missing";
import './side';
export class A extends B<string> implements C, u.T {
  private x = 1; static count: number = 0;
  constructor(readonly q: string, public r?: u.T) { super(); this.go(); }
  go(): u.T { u.help(this.x); mk(); return new D(E.now()); }
  get size() { return this.x }
  static s = () => B.make();
}
export const f = (n: number) => {
  const g = function inner() { return f(n); };
  [1].map((v) => v + n).map(w => g());
  if (n > 1) { const z = { k: 1, f, h() { return g() } }; } else { const z = 2; }
};
function over(a: string): void;
function over<T extends A>(a: T | undefined) { try { gone(a); } catch (e) { throw e; } }
export { over as o };
export default { a: 1, m() { return over("x"); } };
const { p, q: [r], ...rest } = f as any, t = `x${over(`y${p}`)}z` as const;
for (const i of [1, 2]) console.log(i / 2, /re[/]x/g.test("s"));
let k: Array<Map<string, number[]>> = new Map<string, number>(), l = a < b && c > d;
"""
B = """
export abstract class B<T> { static make() { return helper(); } abstract no(a: T): void }
export interface C { run(a: number): void; readonly v?: string; get w(): number }
export function make() {}
function helper() { return new B(); }
export type U = { x: { y: C } } | (typeof make)[];
export enum Color { Red = 1, Green }
declare module "m" { export const z: number }
"""
INDEX = 'export * from "../u";\nexport { make as remake } from "../b";\nexport * as bb from "../b";\n'
U = "export function help(x: number) {}\nexport interface T {}\nexport default function () { help(1) }\n"
FILES = {"src/a.ts": A, "src/b.ts": B, "src/lib/index.ts": INDEX, "src/u.ts": U, "src/bad.ts": "const = ;\nexport const ok = 1;\nfunction {{{ ", "src/empty.ts": ""}


@pytest.fixture(scope="module")
def fb(spark):
    return extract.extract(spark.createDataFrame(list(FILES.items()), "path string, text string"))


def ts(f, n):
    return f"ts:src/{f}.ts:{n}"


def test_declarations(fb):
    d = {r.entityId: r for r in fb["declaration"].collect()}
    kinds = {k.removeprefix("ts:src/a.ts:"): v.entityType for k, v in d.items() if k.startswith("ts:src/a.ts:")}
    assert kinds == {
        "A": "class", "A.x": "property", "A.count": "property", "A.constructor": "constructor", "A.constructor.q": "parameter", "A.constructor.r": "parameter", "A.go": "method", "A.size": "accessor", "A.s": "property",
        "f": "function", "f.n": "parameter", "f.g": "function", "f.@arrowfunction1.v": "parameter", "f.@arrowfunction2.w": "parameter", "f.@block2.z": "variable", "f.@block2.z.k": "property", "f.@block2.z.h": "method", "f.@block4.z": "variable",
        "over": "function", "over.a": "parameter", "over.@catchclause0.e": "variable", "default": "objectliteral", "@objectliteral1.a": "property", "@objectliteral1.m": "method",
        "p": "binding", "r": "binding", "rest": "binding", "t": "variable", "i": "variable", "k": "variable", "l": "variable",
    }
    assert d[ts("a", "A")].exported and d[ts("a", "over")].exported and not d[ts("a", "A.go")].exported and not d[ts("a", "k")].exported
    assert d["module:src/empty.ts"].entityType == "module" and d[ts("b", "C.run")].entityType == "type-method" and d[ts("b", "C.v")].entityType == "type-property"
    assert ts("b", "C.run.a") not in d and ts("b", "B.no.a") not in d  # parameters of bodyless signatures
    assert {i: r.entityType for i, r in d.items() if i.startswith("external:")} == {"external:pkg:default": "external", "external:pkg:E": "external", "external:pkg:E.now": "external"}


def test_calls(fb):
    c = {(r.callerId, r.calleeName): (r.calleeId, r.confidence, r.reason) for r in fb["calls"].collect()}
    assert c[(ts("a", "A.constructor"), "this.go")] == (ts("a", "A.go"), 0.8, "resolved_method")
    assert c[(ts("a", "A.go"), "u.help")] == (ts("u", "help"), 0.8, "resolved_method")  # through the barrel
    assert c[(ts("a", "A.go"), "mk")] == (ts("b", "make"), 0.9, "resolved")
    assert c[(ts("a", "A.s"), "B.make")] == (ts("b", "B.make"), 0.8, "resolved_method")
    assert c[(ts("a", "f.g"), "f")] == (ts("a", "f"), 0.9, "resolved")
    assert c[(ts("a", "f"), "g")] == (ts("a", "f.g"), 0.9, "resolved")
    assert c[(ts("a", "over"), "gone")] == (None, 0.3, "unresolved")
    assert c[(ts("a", "t"), "over")] == (ts("a", "over"), 0.9, "resolved")
    assert c[("module:src/a.ts", "console.log")] == (None, 0.3, "unresolved")
    assert (ts("a", "A.constructor"), "super") not in c
    i = {(r.callerId, r.className): r.classId for r in fb["instantiates"].collect()}
    assert i[(ts("a", "A.go"), "D")] == "external:pkg:default" and i[(ts("b", "helper"), "B")] == ts("b", "B") and i[(ts("a", "k"), "Map")] is None


def test_heritage_imports_and_reexports(fb):
    assert sorted((r.childId, r.parentName, r.parentId) for r in fb["extends"].collect()) == [(ts("a", "A"), "B<string>", ts("b", "B"))]
    assert sorted((r.parentName, r.parentId) for r in fb["implements"].collect()) == [("C", ts("b", "C")), ("u.T", ts("u", "T"))]
    assert sorted((r.exportedBy, r.importedName, r.importType) for r in fb["import"].collect()) == [
        ("external:./missing", "gone", "named"), ("external:pkg/sub", "D", "default"), ("external:pkg/sub", "E", "named"),
        ("src/b.ts", "B", "named"), ("src/b.ts", "C", "type-named"), ("src/b.ts", "make", "named"), ("src/lib/index.ts", "u", "namespace"),
    ]
    assert sorted((r.source, r.reexportedName or "*") for r in fb["reexport"].collect()) == [("src/b.ts", "*"), ("src/b.ts", "make"), ("src/u.ts", "*")]


def test_references(fb):
    r = {(x.callerId, x.name, x.ctx): x.targetId for x in fb["references"].collect()}
    assert r[(ts("a", "A.go"), "u.T", "type")] == ts("u", "T")
    assert r[(ts("a", "f.@block2.z"), "f", "shorthand")] == ts("a", "f") if (ts("a", "f.@block2.z"), "f", "shorthand") in r else r[(ts("a", "f"), "f", "shorthand")] == ts("a", "f")
    assert r[("module:src/a.ts", "over", "export")] == ts("a", "over")
    assert r[("module:src/b.ts", "make", "typeof")] == ts("b", "make")
    skips = {x.reason: x.n for x in fb.skips.collect()}
    assert {"callee", "import-binding", "member-access", "function-local", "type-parameter"} <= set(skips)


def test_closure_holds_and_errors_stay_in_their_file(fb):
    assert integrity.closure_violations(fb).count() == 0
    assert {r.file for r in fb.errors.collect()} == {"src/bad.ts"}
    assert fb["declaration"].where("entityId = 'ts:src/bad.ts:ok'").count() == 1
    assert hygiene.reexport_closure(fb).where("src = 'src/lib/index.ts'").count() == 3
    assert relations.module_calls(fb).where("src = 'src/a.ts' and dst = 'src/u.ts'").count() == 1


def test_bodies_have_the_same_id_whatever_their_name(spark):
    files = spark.createDataFrame([("a.ts", "function x(a) { return a + 1 }\nfunction y(a) { return a + 1 }\nfunction z(a) { return a + 2 }")], "path string, text string")
    d = {r.name: r for r in extract.extract(files)["declaration"].collect()}
    assert d["x"].structureId == d["y"].structureId != d["z"].structureId and d["x"].contentId != d["y"].contentId


def test_options(spark):
    files = spark.createDataFrame([("a.ts", "import {t} from './t'; class K { only() {} } function g(k, loc) { k.only(); t(); return loc }")], "path string, text string")
    other = spark.createDataFrame([("t.ts",)], "path string")
    fb = extract.extract(files, local_references=True, unique_members=True, other_files=other)
    c = {r.calleeName: r.calleeId for r in fb["calls"].collect()}
    assert c == {"k.only": "ts:a.ts:K.only", "t": "ts:t.ts:t"}
    assert fb["declaration"].where("entityId = 'ts:t.ts:t'").first().entityType == "out_of_scope"
    assert fb["references"].where("name = 'loc'").first().targetId == "ts:a.ts:g.loc"


def test_facts_can_be_written_and_read(spark, fb, tmp_path):
    facts_io.write(extract.wide(fb), str(tmp_path / "base"), check=True)
    back = FactBase.read(spark, str(tmp_path / "base"))
    assert {k: back[k].count() for k in back.kinds} == {k: fb[k].count() for k in fb.kinds}


@pytest.mark.parametrize(
    "text",
    [
        "a = b / c / d; x = y;\n/re/.test(z)", "const f = async <T,>(x: T): Promise<T> => x;", "type M<T> = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };", "function f(this: A, ...a: [x: number, y?: string]): asserts a is B {}",
        "label: for (;;) { break label }", "class A { static { x() } #p = 1; [Symbol.iterator]() {} declare y: string; async *g() {} }", "let x = a ? (b) : (c) => d;", "export = foo;", "import x = require('y');", "abstract class Q { abstract get z(): number; }",
        "const t = `a${ `b${c}` }d`;", "x = a!.b![0]?.c?.(d) ?? e as unknown as F;", "enum E { A = 1 << 2, 'b-c' }", "if (a < b && c > (d)) { f<T>(x) }", "switch (x) { case 1: y(); default: z() }", "var fn = function* () { yield* g() }, o = { get a() { return 1 }, async b() {}, 'c': 1, [d]: 2, ...e };",
        "namespace N.M { export const x = 1 }", "declare global { interface Window { a: string } }", "@dec() class D { @p() x = 1; constructor(@inj a: B) {} }", "type F = new (...a: any[]) => object; type G = (a: string) => a is string; type T = `${A}-b`;",
    ],
)
def test_grammar(text):
    assert not [n.text for n in parse(text).walk() if n.kind == "error"]


def test_jsx():
    n = list(parse("const v = <Box a={f(1)} {...p}>text {g(2)} <b/></Box>;", "x.tsx").walk())
    assert not [k for k in n if k.kind == "error"] and sum(k.kind == "call" for k in n) == 2


def test_tokens_have_lines():
    toks, *_ = tokenize("a\n/* x\n */ b `p\n${c}`\nd")
    assert [(t.text.split("\n")[0], t.line) for t in toks if t.kind == "word"] == [("a", 1), ("b", 3), ("d", 5)]
