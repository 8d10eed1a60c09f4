"""A small fixed project, its facts, and what they must be (worked out by hand from the sources)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.facts import FactBase
from factlens.functions import ids
from factlens.sources import extract

SOURCES: dict[str, str] = {
    "src/shapes.ts": """export interface Shape { area(): number }
export class Base implements Shape {
  area(): number { return this.side() }
  side(): number { return 1 }
}
export class Square extends Base { side(): number { return 2 } }
export default function make(): Square { return new Square() }
""",
    "src/util.ts": """import { Square } from "./shapes"
import type { Shape } from "./shapes"
import path from "path"
export const helper = (s: Shape) => s
export function twice() { return helper(new Square()) }
twice()
""",
    "src/index.ts": """export * from "./shapes"
export { helper as aid } from "./util"
""",
    "src/app.ts": """import make, { Base } from "./index"
import * as all from "./index"
class Local extends Base {}
export const made = make()
all.aid(made)
""",
}


@functools.lru_cache(maxsize=1)
def facts(spark: SparkSession) -> FactBase:
    """Extracted once a session."""
    files = spark.createDataFrame(sorted(SOURCES.items()), "path string, text string")
    return extract.extract(files)


#: Relation to its columns; what a row must be follows from the sources above, read by hand.
COLUMNS: dict[str, str] = {
    "declaration": "entityId entityType name file exported",
    "contains": "containerId entityId",
    "import": "importerFile exportedBy importedName importType",
    "reexport": "barrel source reexportedName",
    "calls": "callerId calleeName calleeId confidence reason callerKind line",
    "instantiates": "callerId className classId",
    "references": "callerId name targetId ctx line",
    "extends": "childId parentName parentId",
    "implements": "childId parentName parentId",
}

_SHAPES, _UTIL, _APP = "ts:src/shapes.ts:", "ts:src/util.ts:", "ts:src/app.ts:"

EXPECTED: dict[str, list[tuple]] = {
    "declaration": [
        *((f"module:src/{f}.ts", "module", f"src/{f}.ts", f"src/{f}.ts", True) for f in ("app", "index", "shapes", "util")),
        (_SHAPES + "Shape", "interface", "Shape", "src/shapes.ts", True),
        (_SHAPES + "Shape.area", "type-method", "Shape.area", "src/shapes.ts", False),
        (_SHAPES + "Base", "class", "Base", "src/shapes.ts", True),
        (_SHAPES + "Base.area", "method", "Base.area", "src/shapes.ts", False),
        (_SHAPES + "Base.side", "method", "Base.side", "src/shapes.ts", False),
        (_SHAPES + "Square", "class", "Square", "src/shapes.ts", True),
        (_SHAPES + "Square.side", "method", "Square.side", "src/shapes.ts", False),
        (_SHAPES + "make", "function", "make", "src/shapes.ts", True),
        (_UTIL + "helper", "function", "helper", "src/util.ts", True),
        (_UTIL + "helper.s", "parameter", "helper.s", "src/util.ts", False),
        (_UTIL + "twice", "function", "twice", "src/util.ts", True),
        (_APP + "Local", "class", "Local", "src/app.ts", False),
        (_APP + "made", "variable", "made", "src/app.ts", True),
    ],
    "contains": [
        *(("module:src/shapes.ts", _SHAPES + x) for x in ("Shape", "Shape.area", "Base", "Base.area", "Base.side", "Square", "Square.side", "make")),
        *(("module:src/util.ts", _UTIL + x) for x in ("helper", "helper.s", "twice")),
        *(("module:src/app.ts", _APP + x) for x in ("Local", "made")),
    ],
    "import": [
        ("src/util.ts", "src/shapes.ts", "Square", "named"), ("src/util.ts", "src/shapes.ts", "Shape", "type-named"), ("src/util.ts", "external:path", "path", "default"),
        ("src/app.ts", "src/index.ts", "make", "default"), ("src/app.ts", "src/index.ts", "Base", "named"), ("src/app.ts", "src/index.ts", "all", "namespace"),
    ],
    "reexport": [("src/index.ts", "src/shapes.ts", None), ("src/index.ts", "src/util.ts", "helper")],
    # A star passes no default on, so make() stays open; all.aid goes through the renamed re-export.
    "calls": [
        (_SHAPES + "Base.area", "this.side", _SHAPES + "Base.side", 0.8, "resolved_method", "method", 3),
        (_UTIL + "twice", "helper", _UTIL + "helper", 0.9, "resolved", "function", 5),
        ("module:src/util.ts", "twice", _UTIL + "twice", 0.9, "resolved", "module", 6),
        (_APP + "made", "make", None, 0.3, "unresolved", "variable", 4),
        ("module:src/app.ts", "all.aid", _UTIL + "helper", 0.8, "resolved_method", "module", 5),
    ],
    "instantiates": [(_SHAPES + "make", "Square", _SHAPES + "Square"), (_UTIL + "twice", "Square", _SHAPES + "Square")],
    # Callees and import bindings are no references; heritage is one, to a value or a type.
    "references": [
        ("module:src/shapes.ts", "Shape", _SHAPES + "Shape", "type", 2), ("module:src/shapes.ts", "Base", _SHAPES + "Base", "value", 6), (_SHAPES + "make", "Square", _SHAPES + "Square", "type", 7),
        (_UTIL + "helper", "Shape", _SHAPES + "Shape", "type", 4), ("module:src/app.ts", "Base", _SHAPES + "Base", "value", 3), ("module:src/app.ts", "made", _APP + "made", "value", 5),
    ],
    "extends": [(_SHAPES + "Square", "Base", _SHAPES + "Base"), (_APP + "Local", "Base", _SHAPES + "Base")],
    "implements": [(_SHAPES + "Base", "Shape", _SHAPES + "Shape")],
}


def extracted(kind: str):
    return lambda spark, sf_dir: facts(spark)[kind].select(*COLUMNS[kind].split())


def _literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def expected(kind: str) -> str:
    rows = ", ".join(f"({', '.join(map(_literal, r))})" for r in EXPECTED[kind])
    return f"SELECT * FROM (VALUES {rows}) t({COLUMNS[kind].replace(' ', ', ')})"


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path and name functions over paths made of page addresses."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.element_at(F.array(F.lit("src/"), F.lit("node_modules/@a/b/"), F.lit("../"), F.lit("x\\y/")), (F.col("page_id") % 4 + 1).cast("int")), F.regexp_replace("url", "^https?://", "")).alias("path"))
    name = F.concat(F.lit("A."), F.element_at(F.split("path", "/"), -1))
    return p.select(
        "page_id", ids.slug("path").alias("slug"), ids.module_id("path").alias("module"), ids.as_file(ids.module_id("path")).alias("file"), ids.is_external("path").alias("is_external"),
        ids.external_origin("path").alias("origin"), ids.entity_id("path", F.lit("A.b")).alias("entity"), ids.last_segment(name).alias("segment"), F.array_join(ids.name_roots(name), "|").alias("roots"),
        ids.directory("path").alias("directory"), ids.resolve_path(F.lit("a/b"), F.lit("../c/./d.ts")).alias("resolved"), ids.body_fingerprint("path").alias("fp"), ids.structure_id("path").alias("structure"),
    )


PATH_SQL = r"""
WITH p AS (SELECT page_id, (['src/', 'node_modules/@a/b/', '../', 'x\y/'])[(page_id % 4 + 1)::INT] || regexp_replace(url, '^https?://', '') AS path FROM pages),
n AS (SELECT page_id, path, replace(path, chr(92), '/') AS np, 'A.' || split_part(path, '/', -1) AS name FROM p),
s AS (SELECT *, regexp_replace(np, '[^a-zA-Z0-9_$/@.\-]', '_', 'g') AS slug, page_id % 4 IN (1, 2) AS ext FROM n)
SELECT page_id, slug, 'module:' || slug AS module, slug AS file, ext AS is_external, CASE WHEN page_id % 4 = 1 THEN '@a/b' ELSE 'unknown' END AS origin,
 CASE WHEN page_id % 4 = 1 THEN 'external:@a/b:A.b' WHEN ext THEN 'external:unknown:A.b' ELSE 'ts:' || slug || ':A.b' END AS entity, split_part(name, '.', -1) AS segment, CASE WHEN split_part(name, '.', 1) = name THEN name ELSE name || '|' || split_part(name, '.', 1) END AS roots,
 regexp_replace(path, '/?[^/]*$', '') AS directory, 'a/c/d.ts' AS resolved, substr(sha1(path), 1, 16) AS fp, 'struct:sha256:' || substr(sha256(path), 1, 16) AS structure FROM s
"""

QUERIES = {**{f"extracted_{k}": extracted(k) for k in EXPECTED}, "path_functions": path_functions}
SQL = {**{f"extracted_{k}": expected(k) for k in EXPECTED}, "path_functions": PATH_SQL}
