"""Derived relations (projections) of a fact base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.facts import FactBase
from factlens.functions import ids
from factlens.schema import TIERS


def last_declaration(fb: FactBase) -> DataFrame:
    """One row an id: the last declaration wins."""
    return fb["declaration"].groupBy("entityId").agg(*(F.max_by(c, "ord").alias(c) for c in ("entityType", "name", "file", "exported")))


def entity_module(fb: FactBase) -> DataFrame:
    """(entityId, module): containment, and modules as their own; the last row wins.  Keys of modules are bare paths."""
    own = fb["declaration"].where("entityType = 'module'").select("entityId", F.col("entityId").alias("containerId"), (F.col("ord") - (1 << 40)).alias("ord"))
    rows = fb["contains"].select("entityId", "containerId", "ord").unionByName(own)
    return rows.groupBy("entityId").agg(ids.as_file(F.max_by("containerId", "ord")).alias("module"))


def file_module(fb: FactBase) -> DataFrame:
    """(file, module): of the file's declarations that have a module, the last."""
    d = fb["declaration"].select("entityId", "file", "ord").join(entity_module(fb), "entityId")
    return d.groupBy("file").agg(F.max_by("module", "ord").alias("module"))


def module_entities(fb: FactBase) -> DataFrame:
    return fb["contains"].select(ids.as_file("containerId").alias("module"), "entityId").distinct()


def uses(fb: FactBase, *kinds: str) -> DataFrame:
    """(caller, target, file, ctx, line, ord) of calls, instantiations and references, unresolved ones too."""
    columns = {"calls": "calleeId", "instantiates": "classId", "references": "targetId"}
    out = None
    for k in kinds or tuple(columns):
        f = fb[k]
        ctx = F.col("ctx") if k == "references" else F.lit(k)
        part = f.select(F.col("callerId").alias("caller"), F.col(columns[k]).alias("target"), "file", ctx.alias("ctx"), "line", "ord")
        out = part if out is None else out.unionByName(part)
    return out


def entity_calls(fb: FactBase, *kinds: str) -> DataFrame:
    """Distinct resolved (src, dst) pairs."""
    return uses(fb, *(kinds or ("calls",))).where("target is not null").select(F.col("caller").alias("src"), F.col("target").alias("dst")).distinct()


def _by_module(edges: DataFrame, fb: FactBase, *keep: str) -> DataFrame:
    em = entity_module(fb)
    a, b = em.select(F.col("entityId").alias("caller"), F.col("module").alias("src")), em.select(F.col("entityId").alias("target"), F.col("module").alias("dst"))
    return edges.where("target is not null").join(a, "caller").join(b, "target").where("src <> dst").select("src", "dst", *keep).distinct()


def module_calls(fb: FactBase, instantiations: bool = True) -> DataFrame:
    """Distinct cross-module (src, dst) of calls, and of instantiations too."""
    return _by_module(uses(fb, "calls", *(("instantiates",) if instantiations else ())), fb)


def tier(ctx: str = "ctx") -> F.Column:
    table = F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))
    return F.try_element_at(table, F.col(ctx))


def module_refs_by_tier(fb: FactBase) -> DataFrame:
    return _by_module(uses(fb, "references").withColumn("tier", tier()), fb, "tier")


def internal_imports(fb: FactBase, values_only: bool = False) -> DataFrame:
    i = fb["import"].where(~F.col("exportedBy").startswith("external:"))
    return i.where(~F.col("importType").startswith("type-")) if values_only else i


def module_imports(fb: FactBase, values_only: bool = False) -> DataFrame:
    """Distinct (src, dst) files, internal, without self-imports."""
    return internal_imports(fb, values_only).where("importerFile <> exportedBy").select(F.col("importerFile").alias("src"), F.col("exportedBy").alias("dst")).distinct()


def module_imports_one_hop(fb: FactBase) -> DataFrame:
    """Imports through one barrel: the first re-export that is a star or has the name replaces the target; unknown files drop out."""
    i = internal_imports(fb).select("importerFile", "exportedBy", "importedName").distinct()
    # The first of each barrel and name, so that no barrel's imports meet all of its re-exports; the earlier of star and name is the first match.
    least = fb["reexport"].groupBy(F.col("barrel").alias("exportedBy"), F.col("reexportedName").alias("importedName")).agg(F.min(F.struct("ord", "source")).alias("hop"))
    named = least.where("importedName is not null").withColumnRenamed("hop", "named")
    star = least.where("importedName is null").select("exportedBy", F.col("hop").alias("star"))
    found = i.join(named, ["exportedBy", "importedName"], "left").join(star, "exportedBy", "left")
    hop = found.select("importerFile", F.coalesce(F.least("named", "star")["source"], "exportedBy").alias("target"))
    fm = file_module(fb)
    out = hop.distinct().join(fm.select(F.col("file").alias("importerFile"), F.col("module").alias("src")), "importerFile").join(fm.select(F.col("file").alias("target"), F.col("module").alias("dst")), "target")
    return out.where("src <> dst").select("src", "dst").distinct()


def import_resolution(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """(ord, importer, specifier, resolved): the first existing candidate of a relative specifier, else external:<specifier>."""
    s = specifiers.select("ord", "importer", "specifier")
    cand = s.where(F.col("specifier").startswith(".")).select("ord", F.posexplode(ids.import_candidates("specifier")).alias("rank", "candidate"), "importer")
    cand = cand.select("ord", "rank", ids.resolve_path(ids.directory("importer"), "candidate").alias("path"))
    hit = cand.join(files.select("path").distinct(), "path").groupBy("ord").agg(F.min_by("path", "rank").alias("path"))
    return s.join(hit, "ord", "left").select("ord", "importer", "specifier", F.coalesce("path", F.concat(F.lit("external:"), "specifier")).alias("resolved"))


def edge_union(fb: FactBase) -> DataFrame:
    """(kind, src, dst): calls, instantiations, heritage and references with nullable ends."""
    out = fb["calls"].select(F.lit("calls").alias("kind"), F.col("callerId").alias("src"), F.col("calleeId").alias("dst"))
    out = out.unionByName(fb["instantiates"].select(F.lit("instantiates").alias("kind"), F.col("callerId").alias("src"), F.col("classId").alias("dst")))
    out = out.unionByName(fb["references"].select(F.lit("references").alias("kind"), F.col("callerId").alias("src"), F.col("targetId").alias("dst")))
    for k in ("extends", "implements"):
        out = out.unionByName(fb[k].select(F.lit(k).alias("kind"), F.col("childId").alias("src"), F.col("parentId").alias("dst")))
    return out


def dedup(facts: DataFrame) -> DataFrame:
    """Exact duplicates once, null-safe; the first keeps its place."""
    cols = [c for c in facts.columns if c != "ord"]
    return facts.groupBy(*cols).agg(F.min("ord").alias("ord")) if "ord" in facts.columns else facts.dropDuplicates()
