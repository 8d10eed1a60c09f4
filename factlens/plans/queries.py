"""The registered queries over facts: each applies one operator to the test projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.facts import FactBase
from factlens.operators import graph, hygiene, integrity, lenses, metrics, runtime, snapshot
from factlens.operators import relations as rel

from . import samples
from .testbed import Testbed

SCHEMES = ["entityId", "structureId", "contentId"]


def _dep(fb: FactBase, *kinds: str) -> DataFrame:
    return rel.entity_calls(fb, *kinds)


def _seeds(fb: FactBase) -> DataFrame:
    """The five busiest callees; a handful of ids by definition."""
    return metrics.top_seeds(fb).select(F.col("entityId").alias("seed"))


def _radius(t: Testbed, *kinds: str) -> DataFrame:
    """(seed, callers, modules): who depends on the busiest entities, transitively."""
    fb = t.facts()
    seeds = _seeds(fb)
    reach = graph.closure(_dep(fb, *kinds), seeds, reverse=True)
    em = rel.entity_module(fb).withColumnRenamed("entityId", "id")
    n = reach.join(em, "id", "left").groupBy("seed").agg(F.count("*").alias("callers"), F.count_distinct("module").alias("modules"))
    return seeds.join(n, "seed", "left").fillna(0, ["callers", "modules"])


def _by_file(t: Testbed) -> DataFrame:
    fb = t.facts()
    reach = graph.closure(_dep(fb, "calls"), _seeds(fb), reverse=True)
    d = rel.last_declaration(fb).select(F.col("entityId").alias("id"), "file", "name")
    return reach.join(d, "id").groupBy("seed", "file").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def _subtypes(t: Testbed) -> DataFrame:
    h = t["heritage"].where("parentId is not null").select(F.col("parentId").alias("src"), F.col("childId").alias("dst"))
    seeds = t["region"].select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("seed"))
    return graph.closure(h, seeds).groupBy("seed").agg(F.count("*").alias("subtypes"))


def _seed_pairs(fb: FactBase) -> DataFrame:
    s = _seeds(fb)
    a, b = s.select(F.col("seed").alias("src"), F.lit(1).alias("one")), s.select(F.col("seed").alias("dst"), F.lit(1).alias("one"))
    return a.join(b, "one").drop("one")


def _paths(t: Testbed) -> DataFrame:
    fb = t.facts()
    return graph.shortest_path(_dep(fb, "calls", "instantiates"), _seed_pairs(fb)).select("src", "dst", "hops")


def _forward(t: Testbed) -> DataFrame:
    fb = t.facts()
    seeds = _seeds(fb)
    n = graph.closure(_dep(fb, "calls", "instantiates"), seeds).groupBy("seed").agg(F.count("*").alias("reached"), F.count_if(F.col("id").contains("1")).alias("matching"))
    return seeds.join(n, "seed", "left").fillna(0, ["reached", "matching"])


def _scoped(t: Testbed) -> DataFrame:
    seeds = _seeds(t.facts())
    return graph.scoped_closure(runtime.real_edges(t["runtime"]), runtime.real_edges(t["runtime"], exact=True), seeds).groupBy("seed").agg(F.count("*").alias("n"))


def _tree(t: Testbed) -> DataFrame:
    return t["profile"].withColumnRenamed("turn", "node")


def _raw(t: Testbed, side: str) -> DataFrame:
    return t["snap_a" if side == "a" else "snap_b"]


def _diff(t: Testbed) -> DataFrame:
    return snapshot.diff(_raw(t, "a"), _raw(t, "b"))


def _clusters(t: Testbed) -> DataFrame:
    """Events of one pair, shared out to five commits by a digit of their id."""
    e = snapshot.events(_diff(t), _raw(t, "a"), _raw(t, "b"), SCHEMES)
    return snapshot.event_clusters(e.withColumn("child", F.concat(F.lit("c"), F.length(F.regexp_replace("id", "[^0-4]", "")) % 5)))


def _records(t: Testbed) -> DataFrame:
    return snapshot.records(_raw(t, "b")).select("file", "name", "type", "fp", "n", "ord", "dup", *SCHEMES)


def _runtime_merge(t: Testbed) -> DataFrame:
    return runtime.merge(t["runtime"].select("run", "ord", "callerFrame", "calleeFrame", "samples", "viaNative", "callerId", "calleeId", "callerTier", "calleeTier"))


def _alias(t: Testbed) -> DataFrame:
    declared = t["users"].select(F.concat(F.lit("user:"), F.col("u").cast("string")).alias("entityId"))
    declared = declared.unionByName(declared.select(F.concat("entityId", F.lit(".fn")).alias("entityId")))
    return runtime.alias_edges(t["runtime"].withColumn("calleeId", F.concat("calleeId", F.lit(".fn"))), t["calls"], declared)


def _frames(t: Testbed) -> DataFrame:
    u = F.col("u")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    functions = t["users"].select(
        text("src/m", (u % 40).cast("string"), ".ts").alias("file"), (u % 6 + 1).cast("int").alias("line"), (u % 12 * 10).alias("start"), (u % 12 * 10 + 5).alias("nameStart"),
        F.when(u % 3 != 0, text("f", (u % 4).cast("string"))).alias("name"), F.when(u % 5 < 3, text("user:", u.cast("string"))).otherwise(text("none:", u.cast("string"))).alias("id"),
        F.when(u % 5 == 4, "none:0").otherwise(text("module:src/m", (u % 40).cast("string"), ".ts")).alias("encl"), u.alias("ord"),
    )
    k = F.col("k")
    frames = t["steps"].select(
        text("src/m", (F.col("src") % 40).cast("string"), ".ts").alias("file"), F.when(k % 7 == 0, 1).otherwise(k % 6 + 1).cast("int").alias("line"), F.when(k % 7 == 0, 0).otherwise(k % 120).cast("int").alias("col"),
        F.when(k % 7 == 0, "").otherwise(text("f", (k % 5).cast("string"))).alias("fn"), (k % 120).cast("long").alias("pos"),
    )
    return runtime.resolve_frames(frames, functions, t["declaration"])


def _contract(t: Testbed) -> DataFrame:
    allowed = t.spark.createDataFrame([(str(a), str(b)) for a in range(10) for b in range(10) if (a + b) % 3], "from_layer string, to_layer string")
    return lenses.contract_violations(t.facts(), F.regexp_extract("file", r"([0-9])\.ts$", 1), allowed)


def _overrides(t: Testbed) -> DataFrame:
    fb = t.facts()
    member = fb["declaration"].where("entityType in ('function', 'method')")
    more = member.withColumn("entityId", F.concat("entityId", F.lit(".run"))).withColumn("entityType", F.lit("method"))
    return lenses.override_edges(FactBase({**{k: fb[k] for k in fb.kinds}, "declaration": fb["declaration"].unionByName(more)}))


def _layers(t: Testbed) -> DataFrame:
    return metrics.layer_edges(t.facts(), F.col("from_layer") != F.col("to_layer"))


_OPS: dict[str, Callable[[Testbed], DataFrame]] = {
    # Census
    "facts_by_kind": lambda t: metrics.facts_by_kind(t.facts()),
    "decls_by_type": lambda t: metrics.decls_by_type(t.facts()),
    "confidence_hist": lambda t: metrics.confidence_hist(t.facts()),
    "resolution_rates": lambda t: metrics.resolution_rates(t.facts()),
    "refs_by_ctx": lambda t: metrics.refs_by_ctx(t.facts()),
    "call_reasons": lambda t: metrics.call_reasons(t.facts()),
    "method_calls": lambda t: metrics.method_calls(t.facts()),
    "low_confidence_calls": lambda t: metrics.low_confidence(t.facts()),
    "external_imports": lambda t: metrics.external_imports(t.facts()),
    "resolved_calls": lambda t: t["calls"].where("calleeId is not null").select("callerId", "calleeId", "calleeName", "confidence", "line"),
    # Relations
    "entity_module": lambda t: rel.entity_module(t.facts()),
    "file_module": lambda t: rel.file_module(t.facts()),
    "module_entities": lambda t: rel.module_entities(t.facts()),
    "entity_calls": lambda t: rel.entity_calls(t.facts()),
    "module_calls": lambda t: rel.module_calls(t.facts()),
    "module_imports": lambda t: rel.module_imports(t.facts()),
    "module_imports_one_hop": lambda t: rel.module_imports_one_hop(t.facts()),
    "module_refs_by_tier": lambda t: rel.module_refs_by_tier(t.facts()),
    "import_resolution": lambda t: rel.import_resolution(t["specifiers"], t["source_files"]),
    # Structure
    "import_fan_in": lambda t: metrics.fan(rel.module_imports(t.facts()), "dst", "src"),
    "import_fan_out": lambda t: metrics.fan(rel.module_imports(t.facts()), "src", "dst"),
    "import_fan_in_top": lambda t: metrics.fan(rel.module_imports(t.facts()), "dst", "src", top=5),
    "call_fan_in": lambda t: metrics.fan(rel.module_calls(t.facts()), "dst", "src"),
    "call_fan_out": lambda t: metrics.fan(rel.module_calls(t.facts()), "src", "dst"),
    "inbound_calls": lambda t: metrics.inbound_calls(t.facts()),
    "top_seeds": lambda t: metrics.top_seeds(t.facts()),
    "coupling": lambda t: metrics.coupling(t.facts()),
    "importers_of_index": lambda t: metrics.importers_of(t.facts(), F.col("dst").contains("index")),
    "mutual_imports": lambda t: metrics.mutual_imports(t.facts()),
    "pure_barrels": lambda t: metrics.pure_barrels(t.facts()),
    "isolated_modules": lambda t: metrics.isolated_modules(t.facts()),
    "layer_edges": _layers,
    "barrel_counts": lambda t: metrics.barrel_counts(t.facts(), r"m[0-9]\.ts$"),
    "first_seeds": lambda t: metrics.first_seeds(t.facts(), F.col("segment").contains("1")),
    "static_edges": lambda t: metrics.static_edges(t.facts(), caller="^user:1", callee="7$"),
    "dependency_density": lambda t: metrics.dependency_density(t.facts()),
    # Recursion
    "blast_radius": lambda t: _radius(t, "calls", "instantiates"),
    "blast_radius_calls": lambda t: _radius(t, "calls"),
    "blast_radius_by_file": _by_file,
    "transitive_subtypes": _subtypes,
    "reexport_closure": lambda t: hygiene.reexport_closure(t.facts()),
    "shortest_path": _paths,
    "forward_reach": _forward,
    "scoped_closure": _scoped,
    "runtime_closure_gain": lambda t: runtime.closure_gain(t["runtime"], t["calls"], _seeds(t.facts())),
    "inclusive_samples": lambda t: graph.tree_inclusive(_tree(t), ["conv_id"], "hits"),
    "collapsed_frames": lambda t: graph.collapse_tree(_tree(t), ["conv_id"]),
    "frame_edges": lambda t: runtime.frame_edges(_tree(t), ["conv_id"]),
    # Hygiene
    "dead_imports": lambda t: hygiene.dead_imports(t.facts()),
    "evidence_tiers": lambda t: hygiene.evidence_tiers(t.facts()),
    "type_only_signatures": lambda t: hygiene.type_only_signatures(t.facts()),
    "explain_evidence": lambda t: hygiene.explain_evidence(t.facts()),
    "unused_imports": lambda t: hygiene.unused_imports(t.facts()),
    "accidental_deps_v1": lambda t: hygiene.accidental_deps_v1(t.facts()),
    "dead_end_calls": lambda t: hygiene.dead_end_calls(t.facts()),
    "link_exists": lambda t: hygiene.link_exists(t.facts(), _seed_pairs(t.facts())),
    # Integrity
    "closure_violations": lambda t: integrity.closure_violations(t.facts()),
    "closed_edges": lambda t: integrity.closed_edges(t.facts()),
    "ambiguous_ids": lambda t: integrity.ambiguous_ids(t.facts()),
    "confidence_violations": lambda t: integrity.confidence_violations(t.facts()),
    "id_collisions": lambda t: integrity.id_collisions(t.facts()),
    "question_verdicts": lambda t: integrity.question_verdicts(t.facts()),
    # Temporal
    "snapshot_records": _records,
    "snapshot_diff": _diff,
    "diff_categories": lambda t: snapshot.categories(_diff(t), snapshot.records(_raw(t, "a")), snapshot.records(_raw(t, "b"))),
    "scheme_scores": lambda t: snapshot.scheme_scores(_diff(t), _raw(t, "a"), _raw(t, "b"), SCHEMES),
    "distinct_events": lambda t: snapshot.distinct_events(_diff(t), _raw(t, "a"), _raw(t, "b"), SCHEMES),
    "event_clusters": _clusters,
    "reappearing_types": lambda t: snapshot.reappearing_types(_diff(t), _raw(t, "a"), _raw(t, "b"), "structureId"),
    "scheme_scores_classes": lambda t: snapshot.scheme_scores(_diff(t), _raw(t, "a"), _raw(t, "b"), SCHEMES, types=["class"]),
    "blind_spots": lambda t: snapshot.blind_spots(_diff(t), _raw(t, "a"), _raw(t, "b")),
    "snapshot_join_rate": lambda t: snapshot.join_rate(_raw(t, "a"), _raw(t, "b").withColumnRenamed("type", "entityType")),
    # Lenses
    "symbol_usages": lambda t: lenses.usages(t.facts(), "f7"),
    "confident_calls": lambda t: rel.entity_calls(lenses.confident(t.facts(), 0.85), "calls", "instantiates"),
    "contradictions": lambda t: lenses.contradictions(t["calls"], t["runtime"]),
    "preferred_edges": lambda t: lenses.preferred(t["calls"], t["runtime"]),
    "dead_code": lambda t: lenses.dead_code(t.facts()),
    "impact_endpoints": lambda t: lenses.endpoints(t.facts(), _seeds(t.facts())),
    "contract_violations": _contract,
    "override_edges": _overrides,
    "recovered_architecture": lambda t: lenses.recovered_architecture(t.facts()),
    # Runtime
    "runtime_merge": _runtime_merge,
    "runtime_pairs": lambda t: runtime.pairs(t["runtime"]),
    "runtime_join_rate": lambda t: runtime.join_rate(t["runtime"]),
    "runtime_tiers": lambda t: runtime.tiers(t["runtime"]),
    "runtime_novelty": lambda t: runtime.novelty(t["runtime"], t["calls"]),
    "shortcut_edges": lambda t: runtime.shortcuts(runtime.pairs(t["runtime"])),
    "alias_edges": _alias,
    "sampling_recall": lambda t: runtime.sampling_recall(_runtime_merge(t)),
    "hot_runtime_edges": lambda t: runtime.hot_edges(t["runtime"], "1"),
    "observed_static": lambda t: runtime.observed_static(t["runtime"], t["calls"]),
    "frame_resolution": _frames,
}


def _bound(op: Callable[[Testbed], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(Testbed(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**{k: _bound(v) for k, v in _OPS.items()}, **samples.QUERIES}
