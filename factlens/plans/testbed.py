"""A deterministic projection of the star-schema test tables onto facts.

The texts are in the common subset of Spark SQL and DuckDB, so that one
definition feeds the operators and the comparison SQL.  ``{t}`` stands for a
table or an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factlens.facts import FactBase

_FILE = "'src/m' || CAST({u} % 40 AS STRING) || '.ts'"


def _file(u: str) -> str:
    return _FILE.format(u=u).replace("{", "{{").replace("}", "}}")


def _who(u: str) -> str:
    """A top-level statement belongs to its module."""
    return f"CASE WHEN {u} % 37 = 0 THEN 'module:' || {_file(u)} ELSE 'user:' || CAST({u} AS STRING) END"


def _target(u: str) -> str:
    """Some targets are not declared anywhere."""
    return f"CASE WHEN {u} % 41 = 40 THEN 'ghost:' || CAST({u} AS STRING) ELSE 'user:' || CAST({u} AS STRING) END"


_NAME = "'C' || CAST({u} % 7 AS STRING) || '.f' || CAST({u} AS STRING)"
_kind_of = "CASE u % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'variable' ELSE 'parameter' END"
_body = "'struct:' || substr(md5(CAST(u % 9 AS STRING)), 1, 8)"
_content = "'content:' || substr(md5(CAST(u % 50 AS STRING)), 1, 8)"

#: View name to text; each may use the tables and the views before it.
VIEWS: dict[str, str] = {
    "steps": "SELECT e.event_id AS ord, e.user_id AS src, n.user_id AS dst, e.event_type AS kind, e.value AS v, CAST(e.event_id % 50 + 1 AS INT) AS line, CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INT) AS k FROM {events} e JOIN {events} n ON n.event_id = e.event_id + 1",
    "users": "SELECT DISTINCT user_id AS u FROM {events}",
    "declaration": f"""
SELECT 'user:' || CAST(u AS STRING) AS entityId, {_kind_of} AS entityType, {_NAME.format(u="u")} AS name, {_file("u")} AS file, u % 2 = 0 AS exported, {_body} AS structureId, {_content} AS contentId, u AS ord FROM {{users}}
UNION ALL SELECT 'user:' || CAST(u AS STRING), 'interface', {_NAME.format(u="u")}, {_file("u")}, true, {_body}, {_content}, u + 1000000 FROM {{users}} WHERE u % 23 = 0
UNION ALL SELECT 'user:' || CAST(u AS STRING), 'parameter', {_NAME.format(u="u")}, {_file("u")}, false, {_body}, {_content}, u + 2000000 FROM {{users}} WHERE u % 31 = 0
UNION ALL SELECT 'user:' || CAST(u AS STRING), 'class', {_NAME.format(u="u")}, {_file("u")}, true, {_body}, {_content}, u + 3000000 FROM {{users}} WHERE u % 19 = 0
UNION ALL SELECT DISTINCT 'module:' || {_file("u")}, 'module', {_file("u")}, {_file("u")}, true, CAST(NULL AS STRING), CAST(NULL AS STRING), 4000000 + u % 40 FROM {{users}}""",
    "contains": f"SELECT 'module:' || {_file('u')} AS containerId, 'user:' || CAST(u AS STRING) AS entityId, u AS ord FROM {{users}} WHERE u % 29 <> 0",
    "calls": f"""
SELECT {_who("src")} AS callerId, {_NAME.format(u="dst")} AS calleeName, CASE WHEN kind = 'signup' THEN NULL ELSE {_target("dst")} END AS calleeId,
 CAST(CASE WHEN kind = 'signup' THEN 0.3 WHEN v > 200 THEN 0.9 ELSE 0.8 END AS DOUBLE) AS confidence, CASE WHEN kind = 'signup' THEN 'unresolved' WHEN v > 200 THEN 'resolved' ELSE 'resolved_method' END AS reason,
 CASE WHEN src % 37 = 0 THEN 'module' WHEN src % 4 = 2 THEN 'variable' ELSE 'function' END AS callerKind, {_file("src")} AS file, line, ord FROM {{steps}} WHERE kind IN ('error', 'signup')""",
    "instantiates": f"""
SELECT {_who("src")} AS callerId, {_NAME.format(u="dst")} AS className, {_target("dst")} AS classId, CAST(0.9 AS DOUBLE) AS confidence, 'resolved' AS reason,
 'function' AS callerKind, {_file("src")} AS file, line, ord FROM {{steps}} WHERE kind = 'purchase'""",
    "refs": f"""
SELECT {_who("src")} AS callerId, {_NAME.format(u="dst")} AS name, CASE WHEN k % 10 = 9 THEN NULL ELSE {_target("dst")} END AS targetId,
 CASE k % 6 WHEN 0 THEN 'value' WHEN 1 THEN 'type' WHEN 2 THEN 'typeof' WHEN 3 THEN 'shorthand' WHEN 4 THEN 'export' ELSE 'jsx' END AS ctx,
 CAST(CASE WHEN k % 10 = 9 AND ord % 3 = 0 THEN 0.5 WHEN k % 10 = 9 THEN 0.3 ELSE 0.95 END AS DOUBLE) AS confidence, CASE WHEN k % 10 = 9 THEN 'unresolved' ELSE 'resolved' END AS reason,
 'function' AS callerKind, {_file("src")} AS file, line, ord FROM {{steps}} WHERE kind = 'view'""",
    "heritage": """
SELECT 'implements' AS kind, 'supplier:' || CAST(s_suppkey AS STRING) AS childId, 'nation' AS parentName, 'nation:' || CAST(s_nationkey AS STRING) AS parentId, s_suppkey AS ord FROM {supplier}
UNION ALL SELECT 'extends', 'customer:' || CAST(c_custkey AS STRING), 'nation', CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 'nation:' || CAST(c_nationkey AS STRING) END, c_custkey FROM {customer}
UNION ALL SELECT 'extends', 'nation:' || CAST(n_nationkey AS STRING), 'region', 'region:' || CAST(n_regionkey AS STRING), CAST(n_nationkey AS BIGINT) FROM {nation}
UNION ALL SELECT 'extends', 'user:' || CAST(u AS STRING), 'C' || CAST((u + 3) % 7 AS STRING) || '.f' || CAST(u + 3 AS STRING), 'user:' || CAST(u + 3 AS STRING), u FROM {users} WHERE u % 5 = 0""",
    "imports": f"""
SELECT {_file("src")} AS importerFile, CASE WHEN ord % 11 = 0 THEN 'external:pkg' || CAST(ord % 5 AS STRING) WHEN ord % 7 = 0 THEN 'src/index' || CAST(dst % 5 AS STRING) || '.ts' ELSE {_file("dst")} END AS exportedBy,
 {_NAME.format(u="dst")} AS importedName, CASE ord % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'namespace' WHEN 3 THEN 'type-named' ELSE 'named' END AS importType, ord FROM {{steps}} WHERE kind = 'click'""",
    "reexport": f"""
SELECT CASE WHEN ord % 4 < 2 THEN 'src/index' || CAST(src % 5 AS STRING) || '.ts' ELSE {_file("src")} END AS barrel, {_file("dst")} AS source,
 CASE WHEN ord % 2 = 0 THEN NULL ELSE {_NAME.format(u="dst")} END AS reexportedName, ord FROM {{steps}} WHERE kind = 'click'""",
    "runtime": f"""
SELECT ord % 4 AS run, ord, CASE WHEN k % 12 = 11 THEN 'external:workload' ELSE {_who("src")} END AS callerId, {_target("dst")} AS calleeId, CAST(floor(v) AS BIGINT) + 1 AS samples, ord % 6 = 0 AS viaNative,
 k % 9 < 8 AND k % 12 <> 11 AS callerResolved, k % 8 < 7 AS calleeResolved,
 CASE WHEN k % 12 = 11 THEN 'external' WHEN k % 9 = 8 THEN 'none' WHEN src % 37 = 0 THEN 'module' WHEN k % 3 < 2 THEN 'exact' ELSE 'enclosing' END AS callerTier,
 CASE WHEN k % 8 = 7 THEN 'none' WHEN k % 5 < 3 THEN 'exact' WHEN k % 5 = 3 THEN 'line' ELSE 'enclosing' END AS calleeTier,
 'f' || CAST(src % 30 AS STRING) AS callerFrame, 'f' || CAST(dst % 30 AS STRING) AS calleeFrame FROM {{steps}} WHERE kind IN ('error', 'purchase', 'view')""",
    "snap_a": "SELECT lang AS file, 'o.d' || CAST(doc_id AS STRING) AS name, CASE WHEN doc_id % 3 = 0 THEN 'function' ELSE 'class' END AS type, md5(text) AS fp, n_chars AS n, doc_id AS ord, lang || ':d' || CAST(doc_id AS STRING) AS entityId, md5(text) AS structureId, md5(lang || text) AS contentId FROM {documents}",
    "snap_b": """
SELECT file, name, type, fp, n, ord, file || ':' || name AS entityId, fp AS structureId, CASE WHEN ord % 17 = 0 THEN NULL ELSE md5(file || fp) END AS contentId FROM (
 SELECT CASE WHEN doc_id % 10 IN (3, 4) THEN lang || '_m' ELSE lang END AS file,
  CASE WHEN doc_id % 10 IN (2, 4) THEN 'o.d' || CAST(doc_id AS STRING) || 'r' WHEN doc_id % 10 = 6 THEN 'p@fn' || CAST(doc_id % 3 AS STRING) || '.d' || CAST(doc_id AS STRING) WHEN doc_id % 10 = 8 AND doc_id % 4 = 0 THEN 'q.d' || CAST(doc_id AS STRING) ELSE 'o.d' || CAST(doc_id AS STRING) END AS name,
  CASE WHEN doc_id % 3 = 0 THEN 'function' ELSE 'class' END AS type, CASE WHEN doc_id % 10 = 1 THEN md5('x' || text) ELSE md5(text) END AS fp, n_chars AS n, doc_id AS ord FROM {documents} WHERE doc_id % 10 <> 5
 UNION ALL SELECT lang, 'n.d' || CAST(doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN 'function' ELSE 'class' END, md5('n' || text), n_chars, doc_id + 100000000 FROM {documents} WHERE doc_id % 10 = 7
) x""",
    "profile": "SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL ELSE turn - 1 END AS parent, role = 'user' AS corpus, role || CAST(conv_id % 4 AS STRING) || ':' || CAST(turn AS STRING) AS frame, CAST(length(text) AS BIGINT) AS hits FROM {conversations}",
    "source_files": """
SELECT DISTINCT CASE u % 3 WHEN 0 THEN 'src/a' || CAST(u % 60 AS STRING) || '.ts' WHEN 1 THEN 'src/a' || CAST(u % 60 AS STRING) || '/index.ts' ELSE 'src/a' || CAST(u % 60 AS STRING) || '.d.ts' END AS path FROM {users}""",
    "specifiers": """
SELECT ord, 'src/b' || CAST(src % 9 AS STRING) || '.ts' AS importer, CASE ord % 4 WHEN 0 THEN 'pkg' || CAST(dst % 6 AS STRING) WHEN 1 THEN './a' || CAST(dst % 75 AS STRING) WHEN 2 THEN './a' || CAST(dst % 75 AS STRING) || '.js' ELSE '../src/a' || CAST(dst % 75 AS STRING) END AS specifier FROM {steps} WHERE kind = 'click'""",
}

_TABLES = ("region", "nation", "customer", "supplier", "events", "documents", "conversations")


def names_in(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


class Testbed:
    """The views as DataFrames, each made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in _TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.spark.sql(VIEWS[name], **{n: self[n] for n in dict.fromkeys(names_in(VIEWS[name]))})
        return self._made[name]

    def facts(self) -> FactBase:
        heritage = lambda kind: lambda: self["heritage"].where(f"kind = '{kind}'").drop("kind")
        return FactBase(
            {
                "declaration": lambda: self["declaration"],
                "contains": lambda: self["contains"],
                "import": lambda: self["imports"],
                "reexport": lambda: self["reexport"],
                "calls": lambda: self["calls"],
                "instantiates": lambda: self["instantiates"],
                "references": lambda: self["refs"],
                "extends": heritage("extends"),
                "implements": heritage("implements"),
            }
        )


def with_views(query: str, views: dict[str, str] | None = None) -> str:
    """DuckDB SQL: the views that ``query`` names in braces, directly or through others, and then the query."""
    views = VIEWS if views is None else views
    need: list[str] = []

    def add(text: str, inside: tuple[str, ...] = ()) -> None:
        for n in names_in(text):
            if n in views and n not in need and n not in inside:
                add(views[n], (*inside, n))
                need.append(n)

    own = re.match(r"\s*WITH RECURSIVE\s", query)
    add(query)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    heads = ",\n".join(f"{n} AS ({plain(views[n])})" for n in need)
    body = plain(query)[own.end() :] if own else plain(query)
    if not heads:
        return f"WITH RECURSIVE {body}" if own else body
    return f"WITH RECURSIVE {heads}{',' if own else ''}\n{body}"
