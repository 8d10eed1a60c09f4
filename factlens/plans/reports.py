"""The six flagship questions as one report, and the command line's sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.facts import FactBase
from factlens.operators import graph, hygiene, integrity, metrics, runtime
from factlens.operators import relations as rel


@dataclass
class Answer:
    """A question, whether the facts answer it, why not if not, and the rows."""

    question: str
    answered: bool
    note: str
    rows: DataFrame


def blast_radius(fb: FactBase, seeds: DataFrame) -> DataFrame:
    """(seed, callers, modules)."""
    reach = graph.closure(rel.entity_calls(fb, "calls", "instantiates"), seeds, reverse=True)
    em = rel.entity_module(fb).withColumnRenamed("entityId", "id")
    return reach.join(em, "id", "left").groupBy("seed").agg(F.count("*").alias("callers"), F.count_distinct("module").alias("modules"))


def dispatch(fb: FactBase, pairs: DataFrame) -> DataFrame:
    """(src, dst, src_declared, dst_declared, linked, callers): a declared method and what implements it, whether any fact joins them, and who reaches the declared one."""
    known = fb["declaration"].select("entityId").distinct().withColumn("yes", F.lit(True))
    n = graph.closure(rel.entity_calls(fb, "calls", "instantiates"), pairs.select(F.col("src").alias("seed")), reverse=True).groupBy(F.col("seed").alias("src")).agg(F.count("*").alias("callers"))
    out = hygiene.link_exists(fb, pairs.select("src", "dst").distinct()).join(n, "src", "left")
    for c in ("src", "dst"):
        out = out.join(known.select(F.col("entityId").alias(c), F.col("yes").alias(f"{c}_declared")), c, "left")
    return out.select("src", "dst", *(F.coalesce(f"{c}_declared", F.lit(False)).alias(f"{c}_declared") for c in ("src", "dst")), "linked", F.coalesce("callers", F.lit(0)).alias("callers"))


def declared_members(fb: FactBase) -> DataFrame:
    """(src, dst): members of a type, and those of the same name of what extends or implements it."""
    member = rel.last_declaration(fb).select("entityId", F.regexp_extract("entityId", r"^(.*)\.[^.]+$", 1).alias("holder"), F.regexp_extract("entityId", r"\.([^.]+)$", 1).alias("member")).where("holder <> ''")
    pairs = fb.heritage().where("parentId is not null").select("childId", "parentId").distinct()
    over = pairs.join(member.select(F.col("entityId").alias("src"), F.col("holder").alias("parentId"), "member"), "parentId")
    return over.join(member.select(F.col("entityId").alias("dst"), F.col("holder").alias("childId"), "member"), ["childId", "member"]).select("src", "dst").distinct()


def questions(fb: FactBase, seeds: DataFrame | None = None, installed: DataFrame | None = None) -> list[Answer]:
    """``installed`` has (src, dst) pairs of declared methods and their implementations; by default members and those that redefine them."""
    seeds = seeds if seeds is not None else metrics.top_seeds(fb).select(F.col("entityId").alias("seed"))
    verdict = {r.question: r.answered for r in integrity.question_verdicts(fb).collect()}
    heritage = fb.heritage().where("parentId is not null").select(F.col("parentId").alias("src"), F.col("childId").alias("dst"))
    parents = heritage.select(F.col("src").alias("seed")).distinct()
    ask = lambda q, rows, note="": Answer(q, verdict[q], note, rows)
    return [
        ask("what breaks if this signature changes", blast_radius(fb, seeds)),
        ask("which modules carry the load", metrics.fan(rel.module_imports(fb), "dst", "src", top=5)),
        ask("what implements this interface", graph.closure(heritage, parents).groupBy("seed").agg(F.count("*").alias("subtypes")), "unresolved parents leave it open"),
        ask("which imports are dead weight", hygiene.dead_imports(fb), "needs calls, instantiations and references together"),
        ask("what does a runtime-installed method dispatch to", dispatch(fb, installed if installed is not None else declared_members(fb)), "no static fact names the method on that path: runtime facts are needed"),
        ask("which call edges lead nowhere", hygiene.dead_end_calls(fb), "an upper bound: the kind of the target is judged, not its body"),
    ]


def statistics(fb: FactBase) -> dict[str, DataFrame]:
    """Censuses of a fact base by name."""
    return {
        "facts": metrics.facts_by_kind(fb),
        "declarations": metrics.decls_by_type(fb),
        "confidence": metrics.confidence_hist(fb),
        "resolution": metrics.resolution_rates(fb),
        "references": metrics.refs_by_ctx(fb),
        "ambiguous": integrity.ambiguous_ids(fb),
        "collisions": integrity.id_collisions(fb),
    }


def trace(fb: FactBase, r: DataFrame, seeds: DataFrame | None = None) -> dict[str, DataFrame]:
    """Runtime facts against the static ones, by section: how well they join, what is new, what sampling saw, what closures gain."""
    seeds = seeds if seeds is not None else metrics.top_seeds(fb).select(F.col("entityId").alias("seed"))
    return {
        "join rate": runtime.join_rate(r),
        "tiers": runtime.tiers(r),
        "novelty": runtime.novelty(r, fb["calls"]),
        "known under another name": runtime.alias_edges(r, fb["calls"], fb["declaration"]),
        "runs that saw an edge": runtime.sampling_recall(r),
        "static pairs seen": runtime.observed_static(r, fb["calls"]),
        "closure gain": runtime.closure_gain(r, fb["calls"], seeds),
        "busiest edges": runtime.hot_edges(r),
    }


def preview(df: DataFrame, group: str, order: str, most: int = 6) -> DataFrame:
    """The first ``most`` rows of each group, by ``order``."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
