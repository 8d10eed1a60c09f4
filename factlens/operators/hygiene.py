"""Imports without evidence, in the variants that differ in what counts as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.facts import FactBase
from factlens.functions import ids
from factlens.schema import NO_BODY
from factlens.shared import save

from . import graph
from . import relations as rel


def _considered(fb: FactBase) -> DataFrame:
    """Internal value imports that aren't a barrel's pass-through."""
    through = fb["reexport"].select(F.col("barrel").alias("importerFile"), F.col("source").alias("exportedBy")).distinct()
    return rel.internal_imports(fb, values_only=True).join(through, ["importerFile", "exportedBy"], "left_anti")


def used_modules(fb: FactBase) -> DataFrame:
    """(importerFile, exportedBy): modules whose entities a file calls, instantiates or references, itself included."""
    em = rel.entity_module(fb).withColumnRenamed("entityId", "target")
    return rel.uses(fb).where("target is not null").join(em, "target").select(F.col("file").alias("importerFile"), F.col("module").alias("exportedBy")).distinct()


def dead_imports(fb: FactBase) -> DataFrame:
    """Import facts (not pairs) without file-scoped evidence; barrels aren't followed."""
    return _considered(fb).join(used_modules(fb), ["importerFile", "exportedBy"], "left_anti").select("importerFile", "exportedBy", "importedName", "importType")


def reexport_closure(fb: FactBase) -> DataFrame:
    """(src, dst): files that a barrel re-exports, through any number of barrels, and itself."""
    return graph.all_pairs_closure(fb["reexport"].select(F.col("barrel").alias("src"), F.col("source").alias("dst")))


def _evidence(fb: FactBase) -> DataFrame:
    """(src, target, tier): module-of-caller evidence; tier 0 calls and instantiations, 1 value, 2 typeof, 3 type."""
    order = F.create_map(F.lit("value"), F.lit(1), F.lit("typeof"), F.lit(2), F.lit("type"), F.lit(3))
    refs = rel.module_refs_by_tier(fb).where("tier is not null").select("src", F.col("dst").alias("target"), order[F.col("tier")].alias("tier"))
    return rel.module_calls(fb).select("src", F.col("dst").alias("target"), F.lit(0).alias("tier")).unionByName(refs)


def _pairs(fb: FactBase) -> tuple[DataFrame, DataFrame]:
    """((src, dst) considered import pairs, (src, dst, target) with all that dst is or re-exports); walked from imported barrels only."""
    pairs = save(_considered(fb).where("importerFile <> exportedBy").select(F.col("importerFile").alias("src"), F.col("exportedBy").alias("dst")).distinct(), "imports")
    edges = fb["reexport"].select(F.col("barrel").alias("src"), F.col("source").alias("dst")).distinct()
    barrels = pairs.select(F.col("dst").alias("src")).distinct().join(edges, "src", "left_semi").select(F.col("src").alias("seed"))
    reach = graph.closure(edges, barrels).select(F.col("seed").alias("dst"), F.col("id").alias("target"))
    return pairs, save(pairs.join(reach, "dst").select("src", "dst", "target").unionByName(pairs.withColumn("target", F.col("dst"))), "wide")


def _first(pairs: DataFrame, wide: DataFrame, fb: FactBase) -> DataFrame:
    found = wide.join(_evidence(fb), ["src", "target"]).groupBy("src", "dst").agg(F.min("tier").alias("tier"))
    return pairs.join(found, ["src", "dst"], "left")


def first_tier(fb: FactBase) -> DataFrame:
    """(src, dst, tier): considered import pairs and the lowest tier that clears them through re-exports; null if none."""
    return _first(*_pairs(fb), fb)


def evidence_tiers(fb: FactBase) -> DataFrame:
    """(tier, considered, flagged, flagged_pct): pairs that evidence up to the tier does not clear."""
    one = first_tier(fb).groupBy("tier").agg(F.count("*").alias("n"))
    # Each count goes to the levels where it is considered: all four; a row of ``one`` is a tier.
    out = one.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3)))).groupBy("level").agg(F.sum("n").alias("considered"), F.sum(F.when(F.col("tier").isNull() | (F.col("tier") > F.col("level")), F.col("n")).otherwise(0)).alias("flagged"))
    return out.select(F.col("level").alias("tier"), "considered", "flagged", ids.percent("flagged", "considered").alias("flagged_pct"))


def type_only_signatures(fb: FactBase) -> DataFrame:
    """(signature, n): pairs that only type references clear, by the sorted entity types these point at."""
    pairs, wide = _pairs(fb)
    wide = wide.join(_first(pairs, wide, fb).where("tier = 3").select("src", "dst"), ["src", "dst"], "left_semi")
    em = rel.entity_module(fb)
    refs = fb["references"].where("ctx = 'type' and targetId is not null").select(F.col("callerId"), "targetId").distinct()
    refs = refs.join(em.select(F.col("entityId").alias("callerId"), F.col("module").alias("src")), "callerId").join(em.select(F.col("entityId").alias("targetId"), F.col("module").alias("target")), "targetId")
    kinds = rel.last_declaration(fb).select(F.col("entityId").alias("targetId"), "entityType")
    hit = wide.join(refs, ["src", "target"]).join(kinds, "targetId", "left").select("src", "dst", F.coalesce("entityType", F.lit("?")).alias("kind"))
    sig = hit.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("signature"))
    return sig.groupBy("signature").agg(F.count("*").alias("n"))


def explain_evidence(fb: FactBase) -> DataFrame:
    """(src, dst, line, name): for each cleared pair the file's first reference into what the import reaches."""
    pairs, wide = _pairs(fb)
    wide = wide.join(_first(pairs, wide, fb).where("tier is not null").select("src", "dst"), ["src", "dst"], "left_semi")
    em = rel.entity_module(fb).select(F.col("entityId").alias("targetId"), F.col("module").alias("target"))
    refs = fb["references"].join(em, "targetId").select(F.col("file").alias("src"), "target", "line", "name", "ord")
    return wide.join(refs, ["src", "target"]).groupBy("src", "dst").agg(F.min_by("line", "ord").alias("line"), F.min_by("name", "ord").alias("name"))


def used_names(fb: FactBase) -> DataFrame:
    """(file, name): called, instantiated and inherited names, and their first segments."""
    files = rel.last_declaration(fb).select(F.col("entityId").alias("childId"), "file")
    rows = fb["calls"].select("file", F.col("calleeName").alias("name")).unionByName(fb["instantiates"].select("file", F.col("className").alias("name")))
    rows = rows.unionByName(fb.heritage().select("childId", F.col("parentName").alias("name")).join(files, "childId").select("file", "name"))
    return rows.where("file is not null and name is not null").distinct().select("file", F.explode(ids.name_roots("name")).alias("name")).distinct()


def unused_imports(fb: FactBase) -> DataFrame:
    i = fb["import"].where(F.col("importType").isin("default", "named")).select(F.col("importerFile").alias("file"), F.col("importedName").alias("name")).distinct()
    return i.join(used_names(fb), ["file", "name"], "left_anti")


def accidental_deps_v1(fb: FactBase) -> DataFrame:
    """One-hop imports without call evidence, nor an entity that inherits a name declared there."""
    em = rel.entity_module(fb)
    named = fb["declaration"].select("entityId", "name").distinct().join(em, "entityId").select(F.col("name").alias("parentName"), F.col("module").alias("dst")).distinct()
    # A module and a name once, however many of its entities inherit it.
    inherited = fb.heritage().select("childId", "parentName").distinct().join(rel.module_entities(fb).select(F.col("entityId").alias("childId"), F.col("module").alias("src")), "childId").select("src", "parentName").distinct()
    inherits = inherited.join(named, "parentName").select("src", "dst").distinct()
    return rel.module_imports_one_hop(fb).join(rel.module_calls(fb, instantiations=False), ["src", "dst"], "left_anti").join(inherits, ["src", "dst"], "left_anti")


def dead_end_calls(fb: FactBase) -> DataFrame:
    """(entityType, n, confident): resolved calls that end at something without a body; an upper bound."""
    d = rel.last_declaration(fb).select(F.col("entityId").alias("calleeId"), "entityType").where(F.col("entityType").isin(*NO_BODY))
    return fb["calls"].join(d, "calleeId").groupBy("entityType").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("confident"))


def link_exists(fb: FactBase, pairs: DataFrame) -> DataFrame:
    """(src, dst, linked): whether any call or reference joins the two ids."""
    e = rel.uses(fb, "calls", "references").select(F.col("caller").alias("src"), F.col("target").alias("dst")).distinct().withColumn("yes", F.lit(True))
    return pairs.join(e, ["src", "dst"], "left").select("src", "dst", F.coalesce("yes", F.lit(False)).alias("linked"))
