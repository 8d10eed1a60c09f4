"""Fact schemas and closed value sets."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _d, _i, _l, _b = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


# The field names of facts, in the order of fact files.
DECLARATION = _struct(entityId=_s, entityType=_s, name=_s, file=_s, exported=_b, structureId=_s, contentId=_s)
CONTAINS = _struct(containerId=_s, entityId=_s)
IMPORT = _struct(importerFile=_s, exportedBy=_s, importedName=_s, importType=_s)
REEXPORT = _struct(barrel=_s, source=_s, reexportedName=_s)
CALLS = _struct(callerId=_s, calleeName=_s, calleeId=_s, confidence=_d, reason=_s, callerKind=_s, file=_s, line=_i)
INSTANTIATES = _struct(callerId=_s, className=_s, classId=_s, confidence=_d, reason=_s, callerKind=_s, file=_s, line=_i)
REFERENCES = _struct(callerId=_s, name=_s, targetId=_s, ctx=_s, confidence=_d, reason=_s, callerKind=_s, file=_s, line=_i)
HERITAGE = _struct(childId=_s, parentName=_s, parentId=_s)
RUNTIME = T.StructType(
    [*CALLS.fields, *_struct(samples=_l, viaNative=_b, callerResolved=_b, calleeResolved=_b, callerTier=_s, calleeTier=_s, callerFrame=_s, calleeFrame=_s, runs=_i).fields]
)

#: Typed view of each stored kind tag.
KINDS: dict[str, T.StructType] = {
    "declaration": DECLARATION,
    "contains": CONTAINS,
    "import": IMPORT,
    "reexport": REEXPORT,
    "calls": CALLS,
    "instantiates": INSTANTIATES,
    "references": REFERENCES,
    "extends": HERITAGE,
    "implements": HERITAGE,
}


def wide() -> T.StructType:
    """All kinds in one nullable row: the kind tag, every field once, and the runtime fields."""
    seen: dict[str, T.StructField] = {"kind": T.StructField("kind", _s, True)}
    for struct in [*KINDS.values(), RUNTIME]:
        for f in struct.fields:
            seen.setdefault(f.name, f)
    return T.StructType(list(seen.values()))


FACT = wide()

SNAPSHOT = T.StructType([*_struct(sha=_s, file=_s, name=_s, type=_s, fp=_s, n=_i, dup=_b).fields, T.StructField("ids", T.MapType(_s, _s), True)])

PROFILE = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("id", _i), T.StructField("callFrame", _struct(functionName=_s, scriptId=_s, url=_s, lineNumber=_i, columnNumber=_i)), T.StructField("children", T.ArrayType(_i))]))),
        T.StructField("samples", T.ArrayType(_i)),
    ]
)

# Closed sets that results must spell alike.
ENTITY_TYPES = ("class", "interface", "type", "enum", "function", "constructor", "type-method", "method", "accessor", "type-property", "property", "parameter", "binding", "variable", "module", "external", "out_of_scope")
#: Declaration space by entity type; any other type is a value.
SPACES = {"interface": "type", "type": "type", "type-method": "type", "type-property": "type", "class": "both", "enum": "both", "module": "ns", "sourcefile": "ns"}
IMPORT_TYPES = ("default", "namespace", "named", "type-default", "type-namespace", "type-named")
REFERENCE_CONTEXTS = ("value", "type", "typeof", "shorthand", "export", "jsx")
#: Evidence tiers of reference contexts, weakest condition first.
TIERS = {"value": "value", "shorthand": "value", "export": "value", "jsx": "value", "typeof": "typeof", "type": "type"}
#: Entity types that can't have a body.
NO_BODY = ("parameter", "binding", "type-method", "type-property", "type", "interface", "module")
CATEGORIES = ("unchanged", "body_edit", "rename", "rename_owner", "move", "rename_move", "ambiguous", "added", "removed")
OUTCOMES = ("survive", "vanish", "alias", "reappear", "none", "missing")
