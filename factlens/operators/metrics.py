"""Censuses, fan-in and fan-out, coupling, barrels, layers.  Ties break by key, ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.facts import FactBase
from factlens.functions import ids

from . import relations as rel


def facts_by_kind(fb: FactBase) -> DataFrame:
    out = None
    for k in fb.kinds:
        n = fb[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out.where("n > 0")


def decls_by_type(fb: FactBase) -> DataFrame:
    return fb["declaration"].groupBy("entityType").agg(F.count("*").alias("n"))


def confidence_hist(fb: FactBase) -> DataFrame:
    rows = None
    for k in ("calls", "instantiates", "references"):
        part = fb[k].select(F.lit(k).alias("kind"), ids.confidence_bucket("confidence").alias("confidence"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("kind", "confidence").agg(F.count("*").alias("n"))


def resolution_rates(fb: FactBase) -> DataFrame:
    """Per kind: edges, those with a target, those with both ends declared, and percentages."""
    e = rel.edge_union(fb)
    known = fb["declaration"].select(F.col("entityId").alias("id")).distinct()
    e = e.join(known.select(F.col("id").alias("src"), F.lit(1).alias("s")), "src", "left").join(known.select(F.col("id").alias("dst"), F.lit(1).alias("d")), "dst", "left")
    out = e.groupBy("kind").agg(F.count("*").alias("total"), F.count("dst").alias("resolved"), F.count_if(F.col("s").isNotNull() & F.col("d").isNotNull()).alias("closed"))
    return out.withColumns({"resolved_pct": ids.percent("resolved", "total"), "closed_pct": ids.percent("closed", "total")})


def refs_by_ctx(fb: FactBase) -> DataFrame:
    return fb["references"].groupBy("ctx").agg(F.count("*").alias("n"), F.count("targetId").alias("resolved"))


def call_reasons(fb: FactBase) -> DataFrame:
    return fb["calls"].groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("calleeId").isNull()).alias("unresolved"))


def method_calls(fb: FactBase) -> DataFrame:
    m = F.col("calleeName").contains(".")
    return fb["calls"].agg(F.count("*").alias("calls"), F.count_if(m).alias("method_calls"), F.count_if(m & F.col("calleeId").isNull()).alias("method_calls_unresolved"))


def low_confidence(fb: FactBase, kind: str = "calls", below: float = 0.7) -> DataFrame:
    return fb[kind].where(F.col("confidence") < below).drop("ord")


def external_imports(fb: FactBase) -> DataFrame:
    i = fb["import"].where(F.col("exportedBy").startswith("external:"))
    return i.groupBy(F.regexp_replace("exportedBy", "^external:", "").alias("package")).agg(F.count("*").alias("n"), F.count_distinct("importerFile").alias("files"))


def fan(edges: DataFrame, key: str, other: str, top: int | None = None) -> DataFrame:
    """Distinct ``other`` ends per ``key``; the ``top`` largest if asked for."""
    out = edges.groupBy(F.col(key).alias("module")).agg(F.count_distinct(other).alias("n"))
    return out.orderBy(F.desc("n"), "module").limit(top) if top else out


def inbound_calls(fb: FactBase) -> DataFrame:
    """Call facts into each entity, multiplicity kept."""
    return fb["calls"].where("calleeId is not null").groupBy(F.col("calleeId").alias("entityId")).agg(F.count("*").alias("n"))


def top_seeds(fb: FactBase, named: Column | None = None, top: int = 5) -> DataFrame:
    """The busiest entities whose last name segment satisfies ``named``."""
    d = rel.last_declaration(fb).select("entityId", "name", ids.last_segment("name").alias("segment"))
    d = d.where(named) if named is not None else d
    return d.join(inbound_calls(fb), "entityId").select("entityId", "name", "n").orderBy(F.desc("n"), "entityId").limit(top)


def first_seeds(fb: FactBase, named: Column | None = None, top: int = 3) -> DataFrame:
    """The first entities, by ``ord``, whose last name segment satisfies ``named``."""
    d = fb["declaration"].groupBy("entityId").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name")).withColumn("segment", ids.last_segment("name"))
    d = d.where(named) if named is not None else d
    return d.orderBy("ord", "entityId").limit(top).select("entityId", "name")


def coupling(fb: FactBase, least: int = 3) -> DataFrame:
    """Import facts per module pair, where there are at least ``least``."""
    i = rel.internal_imports(fb).where("importerFile <> exportedBy")
    return i.groupBy(F.col("importerFile").alias("src"), F.col("exportedBy").alias("dst")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def importers_of(fb: FactBase, module: Column) -> DataFrame:
    """Files that import a module which satisfies ``module`` (a predicate on column dst)."""
    return rel.module_imports(fb).where(module).select("src").distinct()


def mutual_imports(fb: FactBase) -> DataFrame:
    """Pairs that import each other: one row a pair, with the number of ordered pairs it stands for."""
    e = rel.module_imports(fb)
    both = e.intersect(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src < dst").select("src", "dst", F.lit(2).cast("long").alias("ordered"))


def own_files(fb: FactBase) -> DataFrame:
    return fb["declaration"].where("entityType <> 'module'").select("file").distinct()


def pure_barrels(fb: FactBase) -> DataFrame:
    """Re-exporting files without declarations but their module's."""
    return fb["reexport"].select(F.col("barrel").alias("file")).distinct().join(own_files(fb), "file", "left_anti")


def barrel_counts(fb: FactBase, locale: str = r"(^|/)locales/") -> DataFrame:
    """(barrels, pure, files, locale_files): re-exporting files, those without own declarations, module files, and those whose path is a locale's."""
    barrels = fb["reexport"].select(F.col("barrel").alias("file")).distinct().withColumn("barrel", F.lit(True))
    own = own_files(fb).withColumn("own", F.lit(True))
    modules = fb["declaration"].where("entityType = 'module'").select("file").distinct().withColumn("module", F.lit(True))
    all_ = barrels.join(own, "file", "full").join(modules, "file", "full")
    return all_.agg(F.count("barrel").alias("barrels"), F.count_if(F.col("barrel") & F.col("own").isNull()).alias("pure"), F.count("module").alias("files"), F.count_if(F.col("module") & F.col("file").rlike(locale)).alias("locale_files"))


def static_edges(fb: FactBase, caller: str = "", callee: str = "", kinds: tuple[str, ...] = ("calls", "references")) -> DataFrame:
    """(kind, caller, target, name, file, line) of facts whose ends match the patterns (an empty one matches all)."""
    names = {"calls": ("calleeId", "calleeName"), "instantiates": ("classId", "className"), "references": ("targetId", "name")}
    out = None
    for k in kinds:
        goal, text = names[k]
        part = fb[k].select(F.lit(k).alias("kind"), F.col("callerId").alias("caller"), F.col(goal).alias("target"), F.col(text).alias("name"), "file", "line")
        part = part.where(F.col("caller").rlike(caller)) if caller else part
        part = part.where(F.coalesce("target", "name").rlike(callee)) if callee else part
        out = part if out is None else out.unionByName(part)
    return out


def isolated_modules(fb: FactBase) -> DataFrame:
    e = rel.module_imports(fb)
    linked = e.select(F.col("src").alias("module")).union(e.select("dst")).distinct()
    return fb["declaration"].where("entityType = 'module'").select(ids.as_file("entityId").alias("module")).distinct().join(linked, "module", "left_anti")


def layer_edges(fb: FactBase, wanted: Column, layer_of=None) -> DataFrame:
    """Import edges between layers that satisfy ``wanted`` (a predicate on from_layer and to_layer); ``layer_of`` maps a file column to its layer (default: the digit that ends its name)."""
    name = layer_of or (lambda c: F.regexp_extract(c, r"([0-9])\.ts$", 1))
    e = rel.module_imports(fb).select(name(F.col("src")).alias("from_layer"), name(F.col("dst")).alias("to_layer"))
    return e.where(wanted).groupBy("from_layer", "to_layer").agg(F.count("*").alias("n"))


def dependency_density(fb: FactBase) -> DataFrame:
    m = fb["declaration"].where("entityType = 'module'").agg(F.count_distinct("entityId").alias("modules"))
    i = rel.module_imports(fb).agg(F.count("*").alias("import_edges"))
    c = rel.module_calls(fb).agg(F.count("*").alias("call_edges"))
    out = m.join(i).join(c)  # three one-row tables
    return out.withColumns({"imports_per_module": F.when(F.col("modules") > 0, F.round(F.col("import_edges") / F.col("modules"), 2)), "calls_per_module": F.when(F.col("modules") > 0, F.round(F.col("call_edges") / F.col("modules"), 2))})
