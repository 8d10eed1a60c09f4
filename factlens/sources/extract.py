"""Facts from TypeScript source: each file is parsed by itself, names across files are resolved by joins.

There is no type checker.  A name resolves to its innermost declaration in the
file, or through imports and re-exports; ``this.x`` and members of a named
class, enum or object resolve by their qualified names, and with
``unique_members`` a method name that one entity in the whole corpus has.
Calls on values whose type only a checker would know stay unresolved (0.3).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens import schema
from factlens.facts import FactBase
from factlens.functions import ids
from factlens.operators import relations
from factlens.shared import save

from .typescript import Node, parse

RAW = (
    "kind string, file string, ord long, id string, name string, entityType string, exported boolean, structureId string, contentId string, "
    "callerId string, callerKind string, ctx string, line int, local string, spec string, imported string, member string, reason string, fp string, n int"
)
_COLUMNS = [c.split()[0] for c in RAW.split(", ")]

# The node kinds that make declarations, id segments and entity types.
_CALLABLE = {"function", "method", "constructor", "getaccessor", "setaccessor", "arrowfunction", "functionexpression"}
_HOLDERS = {"variable", "propertyassignment", "property", "propertysignature"}
_DECLARED = {"class", "interface", "function", "typealias", "enum", "method", "methodsignature", "constructor", "getaccessor", "setaccessor", "property", "propertysignature", "variable", "parameter", "propertyassignment", "bindingelement"}
_SEGMENTS = {"class", "interface", "classexpression", "function", "method", "methodsignature", "getaccessor", "setaccessor", "typealias", "enum", "variable", "propertyassignment", "property", "propertysignature", "moduledeclaration"}
_ANONYMOUS = {"arrowfunction": "arrowfunction", "functionexpression": "function", "objectliteral": "objectliteral", "typeliteral": "typeliteral", "block": "block", "catchclause": "catchclause"}
_TYPES = {"typealias": "type", "methodsignature": "type-method", "getaccessor": "accessor", "setaccessor": "accessor", "propertysignature": "type-property", "propertyassignment": "property", "bindingelement": "binding"}
_SCOPES = {"file", "block", "body", "moduleblock", "catchclause", "forstatement", "switchstatement", "class", "classexpression", "interface", "typealias", "functiontype", "callsignature", "methodsignature", "mappedtype", "type"} | _CALLABLE
#: Names that a statement puts into the scope around it.
_HOISTED = {"function", "class", "interface", "typealias", "enum", "moduledeclaration"}


def slug(path: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_$/@.\-]", "_", path.replace("\\", "/"))


class FileFacts:
    """Raw rows of one parsed file."""

    def __init__(self, path: str, text: str, local_references: bool = False):
        self.path, self.text, self.local_references = path, text, local_references
        self.root = parse(text, path)
        self.module = f"module:{slug(path)}"
        self.rows: list[dict] = []
        self._index: dict[tuple[int, str], dict[int, int]] = {}
        self._scope: dict[int, dict[str, tuple]] = {}
        self.ids: set[str] = set()

    def put(self, kind: str, **kw) -> None:
        self.rows.append({"kind": kind, "file": self.path, "ord": len(self.rows), **kw})

    # --------------------------------------------------------------- identity

    def segment_name(self, n: Node) -> str | None:
        return "constructor" if n.kind == "constructor" else n.name if n.kind in _SEGMENTS else None

    def holder(self, n: Node) -> Node | None:
        """What binds a function or literal: the parent, past a lone type wrapper."""
        p = n.parent
        while p is not None and p.kind == "type" and len(p.kids) == 1:
            p = p.parent
        return p

    def anonymous(self, n: Node) -> str:
        anchor = n.parent
        while anchor.kind != "file" and not self.segment_name(anchor):
            anchor = anchor.parent
        group = "block" if n.kind in ("block", "body") else n.kind
        key = (id(anchor), group)
        if key not in self._index:
            same = (k for k in anchor.walk() if k is not anchor and (k.kind in ("block", "body") if group == "block" else k.kind == group))
            self._index[key] = {id(k): i for i, k in enumerate(same)}
        return f"@{_ANONYMOUS[n.kind]}{self._index[key][id(n)]}"

    def segment(self, n: Node) -> str | None:
        if name := self.segment_name(n):
            return name
        if n.kind not in _ANONYMOUS:
            return None
        if n.kind in ("block", "catchclause"):
            return self.anonymous(n)
        h = self.holder(n)
        return None if h is not None and h.kind in _HOLDERS | {"typealias"} else self.anonymous(n)

    def scope_path(self, n: Node) -> list[str]:
        out = []
        p = n.parent
        while p is not None and p.kind != "file":
            if s := self.segment(p):
                out.append(s)
            p = p.parent
        return out[::-1]

    def qualified(self, n: Node) -> str | None:
        if n.kind in ("arrowfunction", "functionexpression"):
            p = n.parent
            if p is not None and p.kind in ("variable", "propertyassignment", "property") and p.extra.get("init") is n:
                return self.qualified(p)
            if p is not None and p.kind == "exportassignment":
                return "default"
            return None
        own = "constructor" if n.kind == "constructor" else n.name or ("default" if "default" in n.flags else None)
        return ".".join([*self.scope_path(n), own]) if own else None

    def entity(self, n: Node) -> str | None:
        q = self.qualified(n)
        return f"ts:{slug(self.path)}:{q}" if q else None

    def type_of(self, n: Node) -> str:
        if n.kind == "variable":
            init = n.extra.get("init")
            return "function" if init is not None and init.kind in ("arrowfunction", "functionexpression") else "variable"
        return _TYPES.get(n.kind, n.kind)

    def fingerprint(self, n: Node, name: str) -> dict[str, str]:
        """Ids of the body: kinds and literal text in order, the own name masked."""
        parts: list[str] = []

        def walk(k: Node, top: bool = False) -> None:
            parts.append(k.kind)
            parts.append("$name" if top else json.dumps(k.name) if k.name is not None else "")
            if k.text is not None:
                parts.append(json.dumps(k.text))
            for c in k.kids:
                walk(c)
            parts.append(")")

        walk(n, True)
        body = " ".join(parts)
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
        return {"structureId": f"struct:sha256:{h(body)}", "contentId": f"content:sha256:{h(json.dumps(name) + chr(0) + body)}"}

    def body(self, n: Node) -> dict:
        """For matching versions: a hash of the body in which the own name is masked wherever it stands, and its nodes."""
        own, parts, count = (n.name or "default").rpartition(".")[2], [], 0
        for k in n.walk():
            count += 1
            parts.append(k.kind)
            if k.name is not None:
                parts.append("$SELF" if k.name == own else k.name)
            if k.text is not None:
                parts.append(k.text)
            parts.append(str(len(k.kids)))
        return {"fp": hashlib.sha1(" ".join(parts).encode()).hexdigest()[:16], "n": count}

    # ------------------------------------------------------------------ scopes

    def bind(self) -> None:
        """Names of each scope: (form, value, node, inside a callable)."""

        def scope_of(n: Node) -> Node:
            p = n.parent
            while p.kind not in _SCOPES:
                p = p.parent
            return p

        def add(scope: Node, name: str, entry: tuple) -> None:
            self._scope.setdefault(id(scope), {}).setdefault(name, entry)

        for n in self.root.walk():
            for t in n.extra.get("types", ()):
                add(n, t, ("typeparameter", None, n))
            if n.kind == "import":
                for local, imported, form in n.extra["names"]:
                    add(scope_of(n), local, ("import", (n.text, imported, form), n))
            elif n.name and (n.kind in _HOISTED or n.kind in ("variable", "parameter", "bindingelement")):
                add(scope_of(n), n.name, ("declared", self.entity(n), n))
            elif n.name and n.kind in ("functionexpression", "classexpression"):
                add(n, n.name, ("declared", self.entity(n), n))

    def lookup(self, n: Node, name: str) -> tuple | None:
        p: Node | None = n
        while p is not None:
            if e := self._scope.get(id(p), {}).get(name):
                return e
            p = p.parent
        return None

    def call_site(self, n: Node) -> tuple[str, str]:
        fallback, p = None, n.parent
        while p is not None:
            if p.kind in _CALLABLE or p.kind in _HOLDERS:
                if e := self.entity(p):
                    hit = (e, self.type_of(p))
                    if p.kind in _CALLABLE:
                        return hit
                    fallback = fallback or hit
            p = p.parent
        return fallback or (self.module, "module")

    # ------------------------------------------------------------------- facts

    def run(self) -> list[dict]:
        nodes = list(self.root.walk())
        self.bind()
        exported: dict[str, set[str]] = {}
        for n in nodes:
            if n.kind == "export" and n.text is None:
                for local, name, _ in n.extra.get("names", ()):
                    exported.setdefault(name, set()).add(local)
            elif n.kind == "exportassignment" and n.kids and n.kids[0].kind == "identifier":
                exported.setdefault(n.kids[0].name, set()).add("default")
            elif n.kind == "error":
                self.put("error", name=n.text, line=n.line)
        self.put("declaration", id=self.module, entityType="module", name=self.path, exported=True)
        for n in nodes:
            if n.kind in _DECLARED:
                self.declare(n, exported)
        for n in nodes:
            if n.kind == "exportassignment" and n.kids and n.kids[0].kind != "identifier":
                e = f"ts:{slug(self.path)}:default"
                self.put("declaration", id=e, entityType=n.kids[0].kind, name="default", exported=True, **self.fingerprint(n.kids[0], "default"))
                self.put("contains", id=e)
                self.put("exports", name="default", local=e)
        for n in nodes:
            if n.kind in ("class", "interface", "classexpression"):
                self.inherit(n)
            elif n.kind in ("call", "new"):
                self.use(n)
            elif n.kind == "import":
                for local, imported, form in n.extra["names"]:
                    self.put("import", spec=n.text, name=imported if form.endswith("named") else local, ctx=form)
            elif n.kind == "export":
                self.reexport(n, exported)
        for n in nodes:
            self.reference(n)
        return self.rows

    def declare(self, n: Node, exported: dict[str, set[str]]) -> None:
        if n.kind == "parameter" and (n.parent.kind in ("methodsignature", "callsignature", "functiontype") or n.parent.extra.get("body") is None):
            return
        q = self.qualified(n)
        if not q:
            return
        e = f"ts:{slug(self.path)}:{q}"
        self.ids.add(e)
        top = n.parent.kind == "file" or (n.parent.kind == "variablestatement" and n.parent.parent.kind == "file")
        names = {"default"} if "default" in n.flags else {n.name} if "export" in n.flags else set()
        if top:
            names |= exported.get(n.name or "", set())
        self.put("declaration", id=e, entityType=self.type_of(n), name=q, exported=bool(names) and (top or "export" in n.flags), **self.fingerprint(n, q), **self.body(n))
        self.put("contains", id=e)
        if top:
            for name in names:
                self.put("exports", name=name, local=e)

    def reexport(self, n: Node, exported: dict[str, set[str]]) -> None:
        if n.text is None:
            for local, name, _ in n.extra.get("names", ()):  # an imported name may be exported on
                b = self.lookup(n, name)
                if b and b[0] == "import":
                    self.put("passes", name=local, spec=b[1][0], imported=b[1][1])
            return
        names = n.extra.get("names")
        if names:
            for local, name, _ in names:
                self.put("reexport", spec=n.text, name=name)
                self.put("passes", name=local, spec=n.text, imported=name)
        else:
            self.put("reexport", spec=n.text)
            self.put("passes", name=n.name or "*", spec=n.text, imported="*")

    def target(self, n: Node, name_node: Node) -> dict:
        """How a name is to be resolved: a local id, or a specifier, imported name and member."""
        path: list[str] = []
        k = name_node
        while k.kind in ("propertyaccess", "qualifiedname"):
            path.append(k.name)
            k = k.kids[0]
        path.reverse()
        if k.kind == "keyword" and k.text == "this" and len(path) == 1:
            p = n.parent
            while p is not None and p.kind not in ("class", "classexpression"):
                p = p.parent
            e = self.entity(p) if p is not None and p.name else None
            return {"local": f"{e}.{path[0]}"} if e and f"{e}.{path[0]}" in self.ids else {"member": path[-1]}
        if k.kind != "identifier":
            return {"member": path[-1]} if path else {}
        b = self.lookup(n, k.name)
        if b is None:
            return {"member": path[-1]} if path else {}
        form, value, node = b
        if form == "import":
            spec, imported, _ = value
            if imported == "*":
                if not path:
                    return {"spec": spec, "imported": "*"}
                imported, path = path[0], path[1:]
            return {"spec": spec, "imported": imported, "member": ".".join(path) if path else None}
        if form == "declared" and value:
            if not path:
                return {"local": value}
            full = f"{value}.{'.'.join(path)}"
            return {"local": full} if full in self.ids else {"member": path[-1]}
        return {"member": path[-1]} if path else {}

    def use(self, n: Node) -> None:
        c = n.extra["callee"]
        if c.kind not in ("identifier", "propertyaccess"):
            return
        caller, kind = self.call_site(n)
        self.put("calls" if n.kind == "call" else "instantiates", callerId=caller, callerKind=kind, name=self.text[c.pos : c.end], line=n.line, reason="resolved" if c.kind == "identifier" else "resolved_method", **self.target(n, c))

    def inherit(self, n: Node) -> None:
        e = self.entity(n)
        if not e or n.kind == "classexpression":
            return
        for h in n.kids:
            if h.kind == "heritage":
                node = h.kids[0]
                node = node.kids[0] if node.kind == "typereference" else node
                self.put("implements" if h.text == "implements" else "extends", id=e, name=h.name, **self.target(n, node))

    def skip(self, reason: str) -> None:
        self.put("skip", reason=reason)

    def reference(self, n: Node) -> None:
        p = n.parent
        if n.kind == "shorthand":
            return self.refer(n, n.name, "shorthand", {"node": Node("identifier", n.pos, n.line, name=n.name)})
        if n.kind == "export" and n.text is None:
            for _, name, _ in n.extra.get("names", ()):
                self.refer(n, name, "export", {"node": Node("identifier", n.pos, n.line, name=name)})
            return None
        if n.kind == "labeledstatement":
            return self.skip("label")
        if n.kind == "typepredicate":
            return self.skip("type-predicate")
        if n.kind == "import":
            for _ in n.extra["names"]:
                self.skip("import-binding")
            return None
        if n.kind == "export" and n.extra.get("names"):
            for _ in n.extra["names"]:
                self.skip("reexport-specifier")
            return None
        if n.kind in ("propertyaccess", "qualifiedname"):
            root = n
            while root.kind in ("propertyaccess", "qualifiedname"):
                root = root.kids[0]
            b = self.lookup(n, root.name) if root.kind == "identifier" else None
            spaced = b is not None and b[0] == "import" and b[1][1] == "*" and n.kids[0] is root
            if p.kind in ("call", "new") and p.extra.get("callee") is n:
                return self.skip("callee")
            return self.refer(n, self.text[n.pos : n.end], self.space(n), {"node": n}) if spaced else self.skip("member-access")
        if n.kind != "identifier":
            return None
        if n.name == "undefined":
            return self.skip("undefined-literal")
        if p.kind in ("call", "new") and p.extra.get("callee") is n:
            return self.skip("callee")
        b = self.lookup(n, n.name)
        if p.kind in ("propertyaccess", "qualifiedname") and b is not None and b[0] == "import" and b[1][1] == "*":
            return self.skip("namespace-receiver")
        return self.refer(n, n.name, "jsx" if n.extra.get("jsx") else self.space(n), {"node": n})

    def space(self, n: Node) -> str:
        p = n.parent
        while p is not None and p.kind in ("propertyaccess", "qualifiedname"):
            p = p.parent
        if p is None:
            return "value"
        return {"typereference": "type", "typequery": "typeof"}.get(p.kind) or (p.extra.get("space", "value") if p.kind == "heritage" else "value")

    def refer(self, n: Node, name: str, ctx: str, how: dict) -> None:
        root = how["node"]
        while root.kind in ("propertyaccess", "qualifiedname"):
            root = root.kids[0]
        b = self.lookup(n, root.name)
        if b is not None and b[0] == "typeparameter":
            return self.skip("type-parameter")
        if b is not None and b[0] == "declared" and not self.local_references:
            p = b[2].parent
            while p is not None:
                if p.kind in _CALLABLE:
                    return self.skip("function-local")
                p = p.parent
        t = self.target(n, how["node"])
        t = t if "local" in t or "spec" in t else {}
        caller, kind = self.call_site(n)
        self.put("references", callerId=caller, callerKind=kind, name=name, ctx=ctx, line=n.line, reason="namespace" if t.get("imported") == "*" else "resolved", **t)
        return None


def raw_facts(files: DataFrame, local_references: bool = False) -> DataFrame:
    """Raw rows of (path, text) files.  A file that can't be read as a whole gives one error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, names = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}, [c.split() for c in RAW.split(", ")]
        struct = pa.schema([(n, text.get(k, pa.string())) for n, k in names])
        for b in batches:
            for path, source in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    rows = FileFacts(path, source or "", local_references).run()
                except Exception as e:  # one bad file must not fail the others
                    rows = [{"kind": "error", "file": path, "ord": 0, "name": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, struct)

    return files.select("path", "text").mapInArrow(run, RAW)


def _origin(spec: F.Column) -> F.Column:
    return F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def extract(files: DataFrame, local_references: bool = False, unique_members: bool = False, other_files: DataFrame | None = None) -> FactBase:
    """A fact base of (path, text) files.

    ``other_files`` (path) exist but aren't analysed: what is imported from
    them is declared as ``out_of_scope``; packages are ``external``.
    """
    raw = save(raw_facts(files, local_references), "raw")
    inside = files.select("path").distinct().withColumn("analysed", F.lit(True))
    known = inside if other_files is None else inside.unionByName(other_files.select("path").distinct().join(inside.select("path"), "path", "left_anti").withColumn("analysed", F.lit(False)))
    # Specifiers to files, once for each (file, specifier).
    pairs = raw.where("spec is not null").select("file", "spec").distinct().withColumn("ord", F.xxhash64("file", "spec"))
    where = relations.import_resolution(pairs.select("ord", F.col("file").alias("importer"), F.col("spec").alias("specifier")), known)
    where = save(where.select(F.col("importer").alias("file"), F.col("specifier").alias("spec"), "resolved").join(known.withColumnRenamed("path", "resolved"), "resolved", "left"), "where")
    declared = raw.where("kind = 'declaration'")
    # What each file exports, through any number of re-exports; a file's own names come before those of a star.
    exports = raw.where("kind = 'exports'").select("file", "name", F.col("local").alias("id"))
    passes = save(raw.where("kind = 'passes'").select("file", "name", "spec", "imported").join(where.where("analysed"), ["file", "spec"]).select("file", "name", "imported", F.col("resolved").alias("source")).distinct(), "passes")
    spaces = passes.where("imported = '*' and name <> '*'").select("file", "name", ids.module_id("source").alias("id"))
    found = save(exports.unionByName(spaces).groupBy("file", "name").agg(F.min("id").alias("id")), "exports")
    while True:
        by_name = passes.where("imported <> '*'").join(found.select(F.col("file").alias("source"), F.col("name").alias("imported"), "id"), ["source", "imported"]).select("file", "name", "id")
        by_star = passes.where("imported = '*' and name = '*'").select("file", "source").join(found.where("name <> 'default'").select(F.col("file").alias("source"), "name", "id"), "source").select("file", "name", "id")
        new = by_name.unionByName(by_star).groupBy("file", "name").agg(F.min("id").alias("id")).join(found.select("file", "name"), ["file", "name"], "left_anti")
        new = save(new, "more")
        if new.isEmpty():
            break
        found = save(found.unionByName(new), "exports")
    uses = raw.where("kind in ('calls', 'instantiates', 'references', 'extends', 'implements')").join(where, ["file", "spec"], "left")
    uses = uses.join(found.select(F.col("file").alias("resolved"), F.col("name").alias("imported"), F.col("id").alias("exported_id")), ["resolved", "imported"], "left")
    name = F.when(F.col("imported") == "default", "default").otherwise(F.col("imported"))
    away = (
        F.when(F.col("spec").isNull(), None)
        .when((F.col("imported") == "*") & F.col("analysed"), ids.module_id("resolved"))
        .when(F.col("analysed"), F.col("exported_id"))
        .when(F.col("analysed").isNotNull() & (F.col("imported") != "*"), F.concat(F.lit("ts:"), ids.slug("resolved"), F.lit(":"), name))
        .when(~F.col("spec").startswith(".") & (F.col("imported") != "*"), F.concat(F.lit("external:"), ids.slug(_origin(F.col("spec"))), F.lit(":"), name))
    )
    uses = uses.withColumn("whole", F.when(F.col("member").isNotNull() & F.col("spec").isNotNull(), F.concat(away, F.lit("."), "member")).otherwise(F.coalesce("local", away)))
    have = declared.select(F.col("id").alias("whole")).distinct().withColumn("declared", F.lit(True))
    uses = uses.join(have, "whole", "left")
    elsewhere = F.col("whole").startswith("external:") | (F.col("analysed") == F.lit(False))
    target = F.when(F.col("declared") | elsewhere, F.col("whole"))
    if unique_members:
        one = declared.where("entityType in ('method', 'accessor')").select("id", ids.last_segment("name").alias("member")).distinct().groupBy("member").agg(F.min("id").alias("only"), F.count("*").alias("k")).where("k = 1").drop("k")
        uses = uses.join(one, "member", "left")
        target = F.coalesce(target, F.when(F.col("spec").isNull() & F.col("local").isNull() & F.col("kind").isin("calls"), F.col("only")))
    uses = save(uses.withColumn("target", target).withColumn("stub", F.when(elsewhere & F.col("target").isNotNull(), F.when(F.col("whole").startswith("external:"), "external").otherwise("out_of_scope"))).select(*_COLUMNS, "target", "stub", "resolved"), "uses")

    own = declared.select(F.col("id").alias("entityId"), "entityType", "name", "file", "exported", "structureId", "contentId", "ord")
    stubs = uses.where("stub is not null").select(F.col("target").alias("entityId"), F.col("stub").alias("entityType"), F.regexp_extract("target", r"^[^:]*:[^:]*:(.*)$", 1).alias("name"), F.coalesce("resolved", F.regexp_extract("target", r"^[^:]*:([^:]*):", 1)).alias("file")).distinct()
    stubs = stubs.join(own.select("entityId"), "entityId", "left_anti").select("entityId", "entityType", "name", "file", F.lit(True).alias("exported"), *(F.lit(None).cast("string").alias(c) for c in ("structureId", "contentId")), F.lit(0).cast("long").alias("ord"))

    def edges(kind: str, text: str, goal: str, sure: F.Column) -> DataFrame:
        u = uses.where(F.col("kind") == kind)
        hit = F.col("target").isNotNull()
        return u.select("callerId", F.col("name").alias(text), F.col("target").alias(goal), *(["ctx"] if kind == "references" else []), F.when(hit, sure).otherwise(0.3).alias("confidence"), F.when(hit, F.col("reason")).otherwise("unresolved").alias("reason"), "callerKind", "file", "line", "ord")

    def heritage(kind: str) -> DataFrame:
        return uses.where(F.col("kind") == kind).select(F.col("id").alias("childId"), F.col("name").alias("parentName"), F.col("target").alias("parentId"), "ord")

    found_spec = where.select("file", "spec", "resolved")
    imports = raw.where("kind = 'import'").join(found_spec, ["file", "spec"]).select(F.col("file").alias("importerFile"), F.col("resolved").alias("exportedBy"), F.col("name").alias("importedName"), F.col("ctx").alias("importType"), "ord")
    re_ = raw.where("kind = 'reexport'").join(found_spec, ["file", "spec"]).select(F.col("file").alias("barrel"), F.col("resolved").alias("source"), F.col("name").alias("reexportedName"), "ord")
    views = {
        "declaration": own.unionByName(stubs),
        "contains": raw.where("kind = 'contains'").select(ids.module_id("file").alias("containerId"), F.col("id").alias("entityId"), "ord"),
        "import": imports,
        "reexport": re_,
        "calls": edges("calls", "calleeName", "calleeId", F.when(F.col("reason") == "resolved", 0.9).otherwise(0.8)),
        "instantiates": edges("instantiates", "className", "classId", F.lit(0.9)).withColumn("reason", F.when(F.col("classId").isNotNull(), "resolved").otherwise("unresolved")),
        "references": edges("references", "name", "targetId", F.lit(0.9)),
        "extends": heritage("extends"),
        "implements": heritage("implements"),
    }
    fb = FactBase({k: relations.dedup(v) for k, v in views.items()})
    fb.errors = raw.where("kind = 'error'").select("file", "line", "name")
    fb.skips = raw.where("kind = 'skip'").groupBy("reason").agg(F.count("*").alias("n"))
    return fb


#: Entity types whose versions are matched.
MATCHED = ("class", "interface", "type", "enum", "function", "constructor", "method", "accessor", "property", "variable")


def snapshot_raw(files: DataFrame) -> DataFrame:
    """Raw rows of (sha, path, text) files of many commits; ``file`` is sha, line feed, path."""
    return raw_facts(files.select(F.concat("sha", F.lit("\n"), "path").alias("path"), "text"))


def snapshot_records(raw: DataFrame, types: tuple[str, ...] = MATCHED) -> DataFrame:
    """Records for ``operators.snapshot`` of ``snapshot_raw`` rows: file, name, type, fp, n, ord and the id columns, by sha."""
    d = raw.where("kind = 'declaration' and fp is not null").where(F.col("entityType").isin(*types))
    at = F.split("file", "\n", 2)
    clean = F.regexp_replace("id", "^ts:[^:]*:", "")
    return d.select(at[0].alias("sha"), at[1].alias("file"), "name", F.col("entityType").alias("type"), "fp", "n", "ord", F.concat(F.lit("ts:"), ids.slug(at[1]), F.lit(":"), clean).alias("entityId"), "structureId", "contentId")


def wide(fb: FactBase) -> DataFrame:
    """All relations as one wide table with ``kind`` and ``ord``, ready to be written."""
    out = None
    for k, s in schema.KINDS.items():
        v = fb[k]
        have = {f.name for f in s.fields}
        part = v.select(*(F.lit(k).alias("kind") if f.name == "kind" else F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.FACT.fields), F.col("ord"))
        out = part if out is None else out.unionByName(part)
    return out
