"""Recursive operators: semi-naive fixpoints over edge tables.

Each round joins the last frontier with the edges, drops what is known, and is
written to the shared folder, so that plans stay small and a lost executor
costs one round.  Rounds are as many as the longest shortest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.shared import forget, save, together


def closure(edges: DataFrame, seeds: DataFrame, reverse: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(seed, id) reachable from each seed over (src, dst); never the seed itself, even on a cycle.

    ``reverse`` walks from dst to src (who depends on the seed).  With ``by``,
    columns that edges and seeds have besides, several graphs are walked in one loop.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = save(edges.where("src <> dst").select(*by, F.col(a).alias("id"), F.col(b).alias("next")).distinct(), "edges")
    frontier = save(seeds.select(*by, "seed", F.col("seed").alias("id")).distinct(), "frontier")
    rounds = [frontier]
    while not frontier.isEmpty():
        found = frontier.join(step, [*by, "id"]).select(*by, "seed", F.col("next").alias("id")).distinct()
        frontier = save(found.join(together(*rounds), [*by, "seed", "id"], "left_anti"), "frontier")
        rounds.append(frontier)
    return together(*rounds).where("seed <> id")


def group_closure(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """(seed, id) as ``closure``, for groups: seeds has (seed, id) members, none of which is in its group's result."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = save(edges.where("src <> dst").select(F.col(a).alias("id"), F.col(b).alias("next")).distinct(), "edges")
    start = save(seeds.select("seed", "id").distinct(), "frontier")
    rounds, frontier = [start], start
    while not frontier.isEmpty():
        found = frontier.join(step, "id").select("seed", F.col("next").alias("id")).distinct()
        frontier = save(found.join(together(*rounds), ["seed", "id"], "left_anti"), "frontier")
        rounds.append(frontier)
    return together(*rounds[1:]) if len(rounds) > 1 else start.limit(0)


def all_pairs_closure(edges: DataFrame, reflexive: bool = True) -> DataFrame:
    """(src, dst) closure from every vertex that has an edge out, by doubling: rounds are the log of the depth."""
    base = edges.select("src", "dst").distinct()
    reach = base.unionByName(base.select("src", F.col("src").alias("dst"))).distinct() if reflexive else base
    reach = save(reach, "reach")
    while True:
        wider = reach.unionByName(reach.alias("x").join(reach.alias("y"), F.col("x.dst") == F.col("y.src")).select("x.src", "y.dst")).distinct()
        wider = save(wider, "reach")
        if wider.count() == reach.count():
            return wider
        forget(reach)
        reach = wider


def shortest_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, hops, path) for each (src, dst) pair: breadth first; of equally short ways the one with smallest ids, read from the end backwards; null without a way."""
    step = save(edges.where("src <> dst").select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct(), "edges")
    want = save(pairs.select("src", "dst").distinct(), "pairs")
    seen = save(want.select("src").distinct().select("src", F.col("src").alias("at"), F.array("src").alias("path")), "paths")
    frontier, open_ = seen, want.where("src <> dst")
    while not frontier.isEmpty() and not open_.isEmpty():
        found = frontier.join(step, "at").join(seen.select("src", F.col("at").alias("next")), ["src", "next"], "left_anti")
        # Each new vertex keeps its smallest parent.
        found = found.groupBy("src", "next").agg(F.min(F.struct("at", "path"))["path"].alias("path"))
        frontier = save(found.select("src", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")), "paths")
        seen = save(seen.unionByName(frontier), "paths")
        open_ = open_.join(frontier.select("src", F.col("at").alias("dst")), ["src", "dst"], "left_anti")
        frontier = frontier.join(open_.select("src").distinct(), "src", "left_semi")
    return want.join(seen.select("src", F.col("at").alias("dst"), "path"), ["src", "dst"], "left").select("src", "dst", (F.size("path") - 1).cast("long").alias("hops"), F.array_join("path", ">").alias("path")).withColumn("hops", F.when(F.col("path").isNotNull(), F.col("hops")))


def scoped_closure(first: DataFrame, then: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id): one hop back over ``first``, then all the way back over ``then``; the hop's ids are in it, the seed may be."""
    hop = save(seeds.select(F.col("seed").alias("dst")).join(first.where("src <> dst"), "dst").select(F.col("dst").alias("seed"), F.col("src").alias("id")).distinct(), "hop")
    return hop.unionByName(group_closure(then, hop, reverse=True)).distinct()


def tree_inclusive(tree: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, node, inclusive): the sum of ``value`` over each node's subtree; tree has (keys, node, parent).

    By doubling: after k rounds a node has the sum of what lies less than 2**k
    levels below, and points 2**k levels up.  Rounds are the log of the depth,
    and each has one row a node.
    """
    state = save(tree.select(*keys, "node", F.col("parent").alias("up"), F.col(value).alias("inclusive")), "sums")
    while not state.where("up is not null").isEmpty():
        below = state.where("up is not null").groupBy(*keys, F.col("up").alias("node")).agg(F.sum("inclusive").alias("more"))
        above = state.select(*keys, F.col("node").alias("up"), F.col("up").alias("over"))
        new = state.join(below, [*keys, "node"], "left").join(above, [*keys, "up"], "left")
        new = save(new.select(*keys, "node", F.col("over").alias("up"), (F.col("inclusive") + F.coalesce("more", F.lit(0))).alias("inclusive")), "sums")
        forget(state)
        state = new
    return state.select(*keys, "node", "inclusive")


def collapse_tree(tree: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, last, via) for corpus nodes: the nearest corpus ancestor, and whether a foreign frame lies between.

    tree has (keys, node, parent, corpus).  Without a corpus ancestor ``last``
    is null (the workload drives it) and ``via`` is false.
    """
    # A level at a time, top down: all nodes of a level learn what stands above them.
    level = save(tree.where("parent is null").select(*keys, "node", "corpus", F.lit(None).cast(tree.schema["node"].dataType).alias("last"), F.lit(False).alias("via")), "level")
    done = [level]
    while not level.isEmpty():
        above = level.select(*keys, F.col("node").alias("parent"), F.when(F.col("corpus"), F.col("node")).otherwise(F.col("last")).alias("last"), F.when(F.col("corpus"), False).otherwise(F.col("via") | F.col("last").isNotNull()).alias("via"))
        level = save(tree.join(above, [*keys, "parent"]).select(*keys, "node", "corpus", "last", "via"), "level")
        done.append(level)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.where("corpus").select(*keys, "node", "last", "via")
