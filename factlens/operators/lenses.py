"""Views that combine relations: symbols, confidence, contradictions, dead code, contracts, overrides, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.facts import FactBase
from factlens.functions import ids
from factlens.shared import forget, save

from . import graph, runtime
from . import relations as rel


def definitions(fb: FactBase, name: str) -> DataFrame:
    """Declarations whose last name segment is ``name``."""
    return fb["declaration"].where(ids.last_segment("name") == name).select("entityId", "entityType", "name", "file", "exported")


def usages(fb: FactBase, name: str) -> DataFrame:
    """(target, ctx, file, n) of calls, instantiations and references of the entities of that name."""
    d = definitions(fb, name).select(F.col("entityId").alias("target")).distinct()
    return rel.uses(fb).join(d, "target", "left_semi").groupBy("target", "ctx", "file").agg(F.count("*").alias("n"))


def confident(fb: FactBase, least: float) -> FactBase:
    """The same facts without edges of less confidence."""
    views = {k: fb[k] for k in fb.kinds}
    for k in ("calls", "instantiates", "references"):
        views[k] = views[k].where(F.col("confidence") >= least)
    return FactBase(views)


def contradictions(static: DataFrame, observed: DataFrame) -> DataFrame:
    """(callerId, static_to, runtime_to): callers of which runtime saw other callees only, where both know some."""
    s, o = runtime.static_pairs(static), runtime.pairs(observed).select("callerId", "calleeId")
    agree = s.join(o, ["callerId", "calleeId"], "left_semi").select("callerId").distinct()
    n = lambda d, c: d.groupBy("callerId").agg(F.count("*").alias(c))
    return n(s, "static_to").join(n(o, "runtime_to"), "callerId").join(agree, "callerId", "left_anti")


def preferred(static: DataFrame, observed: DataFrame) -> DataFrame:
    """(callerId, calleeId, source, confidence): each pair once, the more confident source wins; runtime wins ties."""
    s = static.where("calleeId is not null").select("callerId", "calleeId", F.struct("confidence", F.lit(0).alias("rank"), F.lit("static").alias("source")).alias("f"))
    o = runtime.pairs(observed).select("callerId", "calleeId", F.struct(F.lit(0.95).alias("confidence"), F.lit(1).alias("rank"), F.lit("runtime").alias("source")).alias("f"))
    best = s.unionByName(o).groupBy("callerId", "calleeId").agg(F.max("f").alias("f"))
    return best.select("callerId", "calleeId", "f.source", "f.confidence")


def dead_code(fb: FactBase) -> DataFrame:
    """Functions and methods that aren't exported and that nothing calls, instantiates or references but themselves."""
    used = rel.uses(fb).where("target is not null and target <> caller").select(F.col("target").alias("entityId")).distinct()
    return rel.last_declaration(fb).where("entityType in ('function', 'method') and not exported").join(used, "entityId", "left_anti").select("entityId", "entityType", "file")


def endpoints(fb: FactBase, seeds: DataFrame) -> DataFrame:
    """(seed, endpoint): exported entities that depend on the seed and on which nothing depends in turn."""
    e = rel.entity_calls(fb, "calls", "instantiates")
    reach = graph.closure(e, seeds, reverse=True)
    tops = rel.last_declaration(fb).where("exported").select(F.col("entityId").alias("id")).join(e.where("src <> dst").select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return reach.join(tops, "id", "left_semi").select("seed", F.col("id").alias("endpoint"))


def contract_violations(fb: FactBase, layer: Column, allowed: DataFrame) -> DataFrame:
    """(src, dst, from_layer, to_layer): import edges between layers that ``allowed`` (from_layer, to_layer) doesn't list.

    ``layer`` maps column ``file`` to its layer; edges within one layer, or of files without one, are free.
    """
    files = rel.module_imports(fb)
    names = files.select(F.col("src").alias("file")).union(files.select("dst")).distinct().select("file", layer.alias("layer")).where("layer is not null and layer <> ''")
    e = files.join(names.select(F.col("file").alias("src"), F.col("layer").alias("from_layer")), "src").join(names.select(F.col("file").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    return e.where("from_layer <> to_layer").join(allowed, ["from_layer", "to_layer"], "left_anti").select("src", "dst", "from_layer", "to_layer")


def override_edges(fb: FactBase) -> DataFrame:
    """(src, dst): a member and the same-named member of a direct parent, both ways, as either may stand for the other."""
    h = fb.heritage().where("parentId is not null").select("childId", "parentId").distinct()
    d = fb["declaration"].select("entityId").distinct().withColumn("owner", F.regexp_replace("entityId", r"\.[^.:]*$", "")).withColumn("member", ids.last_segment("entityId")).where("owner <> entityId")
    a = d.select(F.col("entityId").alias("a"), F.col("owner").alias("childId"), "member")
    b = d.select(F.col("entityId").alias("b"), F.col("owner").alias("parentId"), "member")
    pair = h.join(a, "childId").join(b, ["parentId", "member"]).select("a", "b")
    return pair.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pair.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()


def override_blast_radius(fb: FactBase, seeds: DataFrame) -> DataFrame:
    """(seed, id) as the blast radius, over calls, instantiations and overrides."""
    return graph.closure(rel.entity_calls(fb, "calls", "instantiates").unionByName(override_edges(fb)).distinct(), seeds, reverse=True)


def clusters(edges: DataFrame) -> DataFrame:
    """(id, cluster): connected components of undirected (src, dst) edges, named by their smallest id."""
    both = save(edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).union(edges.select("dst", "src")).where("id <> to").distinct(), "links")
    label = save(both.groupBy("id").agg(F.least(F.first("id"), F.min("to")).alias("cluster")), "label")
    while True:
        # Take the smallest label around, and what that label points at in turn.
        near = both.join(label.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("cluster").alias("near"))
        jump = label.select(F.col("id").alias("cluster"), F.col("cluster").alias("over"))
        new = label.join(near, "id").join(jump, "cluster", "left").select("id", F.least("cluster", "near", F.coalesce("over", "cluster")).alias("cluster"))
        new = save(new, "label")
        same = new.join(label, ["id", "cluster"], "left_anti").isEmpty()
        forget(label)
        label = new
        if same:
            return label


def recovered_architecture(fb: FactBase) -> DataFrame:
    """(cluster, modules, directories): clusters of mutually importing modules, and how many directories they span."""
    e = rel.module_imports(fb)
    mutual = e.intersect(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    c = clusters(mutual).withColumn("directory", ids.directory("id"))
    return c.groupBy("cluster").agg(F.count("*").alias("modules"), F.count_distinct("directory").alias("directories"))


def follow(pointers: DataFrame) -> DataFrame:
    """(id, last): where chains of (id, to) pointers end; a pointer into a cycle has no end and is left out."""
    now = save(pointers.select("id", F.col("to").alias("last")), "pointers")
    for _ in range(max(now.count(), 1).bit_length()):  # each round doubles the steps taken
        step = now.alias("x").join(now.select(F.col("id").alias("last"), F.col("last").alias("far")), "last", "left").select("id", F.coalesce("far", "last").alias("last"))
        step = save(step, "pointers")
        forget(now)
        now = step
    return now.join(pointers.select(F.col("id").alias("last")).distinct(), "last", "left_anti").select("id", "last")
