"""Runtime call facts from sampling profiles, against the static ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions import ids
from factlens.shared import save

from . import graph


def _both() -> Column:
    return F.expr("callerResolved and calleeResolved")


def _exact() -> Column:
    return F.expr("callerTier = 'exact' and calleeTier = 'exact'")


def _inside() -> Column:
    return F.expr("callerTier <> 'external'")


def merge(runs: DataFrame) -> DataFrame:
    """One row a frame pair: samples add up, native flags or, runs are counted, other fields are the first row's."""
    key = ["callerFrame", "calleeFrame"]
    rest = [c for c in runs.columns if c not in (*key, "samples", "viaNative", "run", "runs", "ord")]
    n = F.sum("runs") if "runs" in runs.columns else F.count_distinct("run")
    return runs.groupBy(*key).agg(F.sum("samples").alias("samples"), F.max("viaNative").alias("viaNative"), n.cast("long").alias("runs"), *(F.min_by(c, "ord").alias(c) for c in rest))


def pairs(r: DataFrame) -> DataFrame:
    """Distinct (callerId, calleeId) of resolved inside edges: samples, exact, viaNative."""
    return r.where(_inside() & _both()).groupBy("callerId", "calleeId").agg(F.sum("samples").alias("samples"), F.max(_exact()).alias("exact"), F.max("viaNative").alias("viaNative"))


def join_rate(r: DataFrame) -> DataFrame:
    out = r.agg(
        F.count("*").alias("edges"), F.count_if(_inside()).alias("inside"), F.count_if(_inside() & _both()).alias("joined"), F.count_if(_inside() & _exact()).alias("exact"),
        F.coalesce(F.sum(F.when(_inside(), F.col("samples"))), F.lit(0)).alias("samples"), F.coalesce(F.sum(F.when(_inside() & _both(), F.col("samples"))), F.lit(0)).alias("joined_samples"),
    )
    return out.withColumns({"joined_pct": ids.percent("joined", "inside"), "exact_pct": ids.percent("exact", "inside"), "weighted_pct": ids.percent("joined_samples", "samples")})


def tiers(r: DataFrame) -> DataFrame:
    """(side, tier, n): endpoints by tier, and distinct frames by their last tier."""
    out = r.where(_inside()).groupBy(F.lit("caller").alias("side"), F.col("callerTier").alias("tier")).agg(F.count("*").alias("n"))
    out = out.unionByName(r.groupBy(F.lit("callee").alias("side"), F.col("calleeTier").alias("tier")).agg(F.count("*").alias("n")))
    f = r.select(F.col("calleeFrame").alias("frame"), F.col("calleeTier").alias("tier"), (F.col("ord") * 2).alias("at")).unionByName(r.where(_inside()).select(F.col("callerFrame").alias("frame"), F.col("callerTier").alias("tier"), (F.col("ord") * 2 + 1).alias("at")))
    last = f.groupBy("frame").agg(F.max_by("tier", "at").alias("tier"))
    return out.unionByName(last.groupBy(F.lit("frame").alias("side"), "tier").agg(F.count("*").alias("n")))


def static_pairs(calls: DataFrame) -> DataFrame:
    return calls.where("calleeId is not null").select("callerId", "calleeId").distinct()


def shortcuts(p: DataFrame) -> DataFrame:
    """(callerId, calleeId) of pairs A, B with A to X to B in the graph too, X neither.

    X is looked for among A's callees or B's callers, whichever are fewer, so
    that a hub in the middle isn't multiplied out.
    """
    p = p.select("callerId", "calleeId").distinct()
    e = save(p.where("callerId <> calleeId"), "calls")
    out, into = e.groupBy("callerId").agg(F.count("*").alias("down")), e.groupBy("calleeId").agg(F.count("*").alias("up"))
    sized = save(p.join(out, "callerId").join(into, "calleeId"), "sized")
    ahead = sized.where("down <= up").select("callerId", "calleeId").join(e.select("callerId", F.col("calleeId").alias("x")), "callerId").where("x <> calleeId")
    ahead = ahead.join(e.select(F.col("callerId").alias("x"), "calleeId"), ["x", "calleeId"], "left_semi")
    behind = sized.where("down > up").select("callerId", "calleeId").join(e.select(F.col("callerId").alias("x"), "calleeId"), "calleeId").where("x <> callerId")
    behind = behind.join(e.select("callerId", F.col("calleeId").alias("x")), ["x", "callerId"], "left_semi")
    return ahead.select("callerId", "calleeId").unionByName(behind.select("callerId", "calleeId")).distinct()


def novelty(r: DataFrame, calls: DataFrame) -> DataFrame:
    """(class, n, exact, via_native, shortcut) of distinct pairs: static ones, and the new by what they join."""
    p = pairs(r)
    p = p.join(static_pairs(calls).withColumn("static", F.lit(True)), ["callerId", "calleeId"], "left").join(shortcuts(p).withColumn("shortcut", F.lit(True)), ["callerId", "calleeId"], "left")
    kind = (
        F.when(F.col("static").isNotNull(), "static")
        .when(F.col("callerId") == F.col("calleeId"), "self_loop")
        .when(F.col("calleeId").startswith("module:"), "module_callee")
        .when(F.col("callerId").startswith("module:"), "module_caller")
        .otherwise("function_to_function")
    )
    return p.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.count_if("viaNative").alias("via_native"), F.count_if(F.col("shortcut").isNotNull()).alias("shortcut"))


def alias_edges(r: DataFrame, calls: DataFrame, declared: DataFrame) -> DataFrame:
    """New pairs that the static graph has under another name: the callee is a closure one segment below a factory which a variable calls."""
    closures = declared.select(F.col("entityId").alias("closure")).distinct().withColumn("factory", F.regexp_replace("closure", r"\.[^.]*$", "")).where("factory <> closure")
    holders = calls.where("callerKind = 'variable' and calleeId is not null").select(F.col("calleeId").alias("factory"), F.col("callerId").alias("holder")).distinct()
    known = closures.join(holders, "factory").select(F.col("closure").alias("calleeId"), F.col("holder"))
    s = static_pairs(calls)
    new = pairs(r).select("callerId", "calleeId").join(s, ["callerId", "calleeId"], "left_anti")
    return new.join(known, "calleeId").join(s.select("callerId", F.col("calleeId").alias("holder")), ["callerId", "holder"], "left_semi").select("callerId", "calleeId").distinct()


def sampling_recall(merged: DataFrame) -> DataFrame:
    return merged.groupBy("runs").agg(F.count("*").alias("edges"))


def hot_edges(r: DataFrame, pattern: str = "", top: int = 12) -> DataFrame:
    e = r.where(F.col("calleeId").rlike(pattern)) if pattern else r
    return e.groupBy("callerId", "calleeId").agg(F.sum("samples").alias("samples")).orderBy(F.desc("samples"), "callerId", "calleeId").limit(top)


def observed_static(r: DataFrame, calls: DataFrame) -> DataFrame:
    out = static_pairs(calls).join(pairs(r).select("callerId", "calleeId", F.lit(1).alias("hit")), ["callerId", "calleeId"], "left").agg(F.count("*").alias("static"), F.count("hit").alias("observed"))
    return out.withColumn("pct", ids.percent("observed", "static"))


def closure_gain(r: DataFrame, calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, static_n, exact_n, joined_n, added): transitive callers without and with runtime edges."""
    s = static_pairs(calls).select(F.col("callerId").alias("src"), F.col("calleeId").alias("dst"))
    more = r.where(_inside()).select(F.col("callerId").alias("src"), F.col("calleeId").alias("dst"), _exact().alias("exact"), _both().alias("both"))
    # Three graphs in one walk.
    graphs = F.explode(F.array(F.lit("static"), F.lit("exact"), F.lit("joined")))
    edges = s.withColumn("graph", graphs).unionByName(more.where("exact").select("src", "dst", F.lit("exact").alias("graph"))).unionByName(more.where("both").select("src", "dst", F.lit("joined").alias("graph")))
    reach = graph.closure(edges, seeds.select("seed").distinct().withColumn("graph", graphs), reverse=True, by=("graph",))
    held = reach.groupBy("seed", "id").agg(*(F.max(F.col("graph") == g).alias(g) for g in ("static", "exact", "joined")))
    size = held.groupBy("seed").agg(*(F.count_if(g).alias(f"{g}_n") for g in ("static", "exact", "joined")), F.count_if(F.col("exact") & ~F.col("static")).alias("added"))
    return seeds.select("seed").distinct().join(size, "seed", "left").fillna(0, ["static_n", "exact_n", "joined_n", "added"])


def real_edges(r: DataFrame, exact: bool = False) -> DataFrame:
    """(src, dst) of distinct pairs without shortcuts of longer chains."""
    p = pairs(r)
    real = p.join(shortcuts(p), ["callerId", "calleeId"], "left_anti")
    return (real.where("exact") if exact else real).select(F.col("callerId").alias("src"), F.col("calleeId").alias("dst"))


def resolve_frames(frames: DataFrame, functions: DataFrame, declared: DataFrame) -> DataFrame:
    """(file, line, col, fn, id, tier): the best candidate of each distinct frame.

    functions has (file, line, start, nameStart, name, id, encl, ord), frames
    (file, line, col, fn, pos).  A frame at the very top is its module; else
    functions that start at the position or one before it, or whose name does,
    nearest first, exact by their own id or enclosing by the one around; else
    functions on the line with a matching or no name.
    """
    f = frames.select("file", "line", "col", "fn", "pos").distinct()
    known = declared.select(F.col("entityId").alias("id")).distinct().withColumn("ok", F.lit(True))
    fun = functions.join(known, "id", "left").join(known.select(F.col("id").alias("encl"), F.col("ok").alias("encl_ok")), "encl", "left")
    fun = fun.select("file", F.col("line").alias("at"), "start", "nameStart", "name", "id", "encl", "ord", "ok", "encl_ok")
    # Positions meet by equality: a function is offered at each of the places where it may be hit.
    spots = fun.select("*", F.explode(F.array_distinct(F.array("start", F.col("start") + 1, F.coalesce("nameStart", "start")))).alias("pos"))
    key = ["file", "line", "col", "fn", "pos"]
    here = f.join(spots, ["file", "pos"]).select(*key, F.lit(0).alias("stage"), F.abs(F.col("start") - F.col("pos")).alias("gap"), "id", "encl", "ord", "ok", "encl_ok")
    line = f.join(fun, "file").where((F.col("at") == F.col("line")) & ((F.col("name") == F.col("fn")) | F.col("name").isNull() | (F.col("name") == "") | F.col("fn").isNull() | (F.col("fn") == "")))
    line = line.select(*key, F.lit(1).alias("stage"), F.lit(0).alias("gap"), "id", "encl", "ord", "ok", "encl_ok")
    cand = here.unionByName(line)
    own = cand.where("ok").select(*key, F.struct("stage", F.lit(0).alias("how"), "gap", "ord", F.col("id").alias("got")).alias("c"))
    around = cand.where("encl_ok").select(*key, F.struct("stage", F.lit(1).alias("how"), "gap", "ord", F.col("encl").alias("got")).alias("c"))
    best = own.unionByName(around).groupBy(*key).agg(F.min("c").alias("c"))
    top = (F.col("line") == 1) & (F.col("col") == 0) & (F.col("fn").isNull() | (F.col("fn") == ""))
    cond = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in key]
    out = f.alias("x").join(best.alias("y"), cond, "left").select(*(F.col(f"x.{k}") for k in key), "c")
    tier = F.when(top, "module").when(F.col("c").isNull(), "none").when(F.col("c.how") == 1, "enclosing").when(F.col("c.stage") == 0, "exact").otherwise("line")
    return out.select("file", "line", "col", "fn", F.when(top, ids.module_id("file")).otherwise(F.col("c.got")).alias("id"), tier.alias("tier"))


def frame_edges(tree: DataFrame, keys: list[str]) -> DataFrame:
    """(caller, callee, via, samples): profile nodes to weighted edges of frames, foreign frames collapsed.

    tree has (keys, node, parent, corpus, frame, hits); an edge weighs its callee's subtree.
    """
    inc = graph.tree_inclusive(tree, keys, "hits")
    c = graph.collapse_tree(tree, keys).join(inc, [*keys, "node"])
    names = tree.select(*keys, "node", "frame")
    c = c.join(names.withColumnRenamed("frame", "callee"), [*keys, "node"]).join(names.select(*keys, F.col("node").alias("last"), F.col("frame").alias("caller")), [*keys, "last"], "left")
    return c.groupBy(F.coalesce("caller", F.lit("<workload>")).alias("caller"), "callee").agg(F.max("via").alias("via"), F.sum("inclusive").alias("samples"))
