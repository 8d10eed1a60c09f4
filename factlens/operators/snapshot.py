"""Matching entities between two snapshots, and scoring id schemes by the match.

Records have (file, name, type, fp, n, dup, ord) and id columns.  Stages run in
order, each on what the earlier ones left: same key; same file and body; same
last name segment and body in another file; same body.  A bucket of a stage
matches only one to one; other buckets on both sides are ambiguous and used up.

With ``by``, columns that both sides have besides (the commit, say), many pairs of
snapshots are matched in one pass, each by itself; ordinals are unique in a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions import ids
from factlens.shared import save

KEY = ["file", "name", "type"]
MIN_NODES = 12


By = tuple[str, ...]


def records(raw: DataFrame, by: By = ()) -> DataFrame:
    """One record a key, the first; ``dup`` where a key has several."""
    rest = [c for c in raw.columns if c not in (*KEY, *by) and c not in ("ord", "dup")]
    return raw.groupBy(*by, *KEY).agg(*(F.min_by(c, "ord").alias(c) for c in rest), F.min("ord").alias("ord"), (F.count("*") > 1).alias("dup"))


def join_rate(raw: DataFrame, declarations: DataFrame) -> DataFrame:
    """(records, joined, pct): how many records find their declaration by (file, name, type)."""
    d = declarations.select("file", "name", F.col("entityType").alias("type")).distinct().withColumn("hit", F.lit(1))
    out = records(raw).join(d, KEY, "left").agg(F.count("*").alias("records"), F.count("hit").alias("joined"))
    return out.withColumn("pct", ids.percent("joined", "records"))


def _one_to_one(a: DataFrame, b: DataFrame, bucket: list[str]) -> DataFrame:
    """Buckets on both sides with their counts and (first) members."""
    side = lambda d, s: d.groupBy(*bucket).agg(F.count("*").alias(f"n{s}"), F.min("ord").alias(f"{s}"), F.min_by("file", "ord").alias(f"f{s}"), F.min_by("name", "ord").alias(f"m{s}"))
    return side(a, "a").join(side(b, "b"), bucket)


def diff(a: DataFrame, b: DataFrame, min_nodes: int = MIN_NODES, by: By = ()) -> DataFrame:
    """(by, cat, type, a, b): ordinals of the records of each classified pair, bucket or leftover."""
    key, at = [*by, *KEY], [*by, "ord"]
    a, b = save(records(a, by).withColumn("seg", ids.last_segment("name")), "a"), save(records(b, by).withColumn("seg", ids.last_segment("name")), "b")
    dups = a.where("dup").select(*key).unionByName(b.where("dup").select(*key)).distinct()
    ea, eb = a.join(dups, key, "left_anti"), b.join(dups, key, "left_anti")
    same = ea.select(*key, F.col("ord").alias("a"), F.col("fp").alias("fa")).join(eb.select(*key, F.col("ord").alias("b"), F.col("fp").alias("fb")), key)
    same = save(same.select(*by, F.when(F.col("fa") == F.col("fb"), "unchanged").otherwise("body_edit").alias("cat"), "type", "a", "b"), "same")
    la = save(ea.join(same.select(*by, F.col("a").alias("ord")), at, "left_anti"), "la")
    lb = save(eb.join(same.select(*by, F.col("b").alias("ord")), at, "left_anti"), "lb")
    out = same
    stages = [
        (["file", "type", "fp"], F.when(F.substring_index("ma", ".", -1) == F.substring_index("mb", ".", -1), "rename_owner").otherwise("rename")),
        (["seg", "type", "fp"], F.when(F.col("fa") != F.col("fb"), "move")),
        (["type", "fp"], F.lit("rename_move")),
    ]
    for own, cat in stages:
        bucket = [*by, *own]
        big_a, big_b = la.where(F.col("n") >= min_nodes), lb.where(F.col("n") >= min_nodes)
        met = _one_to_one(big_a, big_b, bucket)
        single = (F.col("na") == 1) & (F.col("nb") == 1)
        met = save(met.select(*bucket, F.when(single, cat).otherwise("ambiguous").alias("cat"), "a", F.when(single, F.col("b")).alias("b")).where("cat is not null"), "met")
        out = out.unionByName(met.select(*by, "cat", "type", "a", "b"))
        used = met.select(*bucket).distinct()
        gone_a, gone_b = big_a.join(used, bucket, "left_semi").select(*at), big_b.join(used, bucket, "left_semi").select(*at)
        la, lb = save(la.join(gone_a, at, "left_anti"), "la"), save(lb.join(gone_b, at, "left_anti"), "lb")
    none = F.lit(None).cast("long")
    out = out.unionByName(la.select(*by, F.lit("removed").alias("cat"), "type", F.col("ord").alias("a"), none.alias("b")))
    return save(out.unionByName(lb.select(*by, F.lit("added").alias("cat"), "type", none.alias("a"), F.col("ord").alias("b"))), "diff")


def categories(d: DataFrame, a: DataFrame, b: DataFrame, by: By = ()) -> DataFrame:
    """(by, cat, n, positional): rows per category; positional owner renames have a numbered anonymous segment."""
    names = d.join(a.select(*by, F.col("ord").alias("a"), F.col("name").alias("na")), [*by, "a"], "left").join(b.select(*by, F.col("ord").alias("b"), F.col("name").alias("nb")), [*by, "b"], "left")
    return names.groupBy(*by, "cat").agg(F.count("*").alias("n"), F.count_if((F.col("cat") == "rename_owner") & F.concat("na", "nb").rlike(r"@\w+?\d+")).alias("positional"))


def _scored(d: DataFrame, a: DataFrame, b: DataFrame, schemes: list[str], by: By = ()) -> DataFrame:
    """(by, cat, type, scheme, ida, idb, outcome, in_a, in_b, shared, alone): a row for each classified row but ambiguous ones, and scheme."""
    long = lambda t: t.select(*by, "ord", *schemes).unpivot([*by, "ord"], schemes, "scheme", "id")
    la, lb, key = long(a), long(b), [*by, "scheme"]
    rows = d.where("cat <> 'ambiguous'").select(*by, "cat", "type", "a", "b")
    both = rows.withColumn("scheme", F.explode(F.array(*map(F.lit, schemes))))
    both = both.join(la.select(*key, F.col("ord").alias("a"), F.col("id").alias("ida")), [*key, "a"], "left").join(lb.select(*key, F.col("ord").alias("b"), F.col("id").alias("idb")), [*key, "b"], "left")
    held = lambda t, n: t.where("id is not null").groupBy(*key, "id").agg(F.count("*").alias(n))
    both = both.join(held(lb, "in_b").withColumnRenamed("id", "ida"), [*key, "ida"], "left").join(held(la, "in_a").withColumnRenamed("id", "idb"), [*key, "idb"], "left")
    both = both.join(held(lb, "shared").withColumnRenamed("id", "idb"), [*key, "idb"], "left").join(held(la, "alone").withColumnRenamed("id", "ida"), [*key, "ida"], "left")
    missing = (F.col("a").isNotNull() & F.col("ida").isNull()) | (F.col("b").isNotNull() & F.col("idb").isNull())
    pair = F.col("a").isNotNull() & F.col("b").isNotNull()
    outcome = (
        F.when(missing, "missing")
        .when(pair & (F.col("ida") == F.col("idb")), "survive")
        .when(pair, F.when(F.col("in_b").isNotNull(), "alias").otherwise("vanish"))
        .when(F.col("a").isNotNull(), F.when(F.col("in_b").isNotNull(), "reappear").otherwise("none"))
        .otherwise(F.when(F.col("in_a").isNotNull(), "reappear").otherwise("none"))
    )
    return both.withColumn("outcome", outcome)


def scheme_scores(d: DataFrame, a: DataFrame, b: DataFrame, schemes: list[str], by: By = (), types: list[str] | None = None) -> DataFrame:
    """(cat, scheme, outcome, n, shared): outcomes, and survivals whose id names several child entities; of entities of ``types`` only, if given."""
    s = _scored(d if types is None else d.where(F.col("type").isin(*types)), records(a, by), records(b, by), schemes, by)
    return s.groupBy("cat", "scheme", "outcome").agg(F.count("*").alias("n"), F.count_if((F.col("outcome") == "survive") & (F.col("shared") > 1)).alias("shared"))


def events(d: DataFrame, a: DataFrame, b: DataFrame, schemes: list[str], by: By = (), min_nodes: int = MIN_NODES) -> DataFrame:
    """(by, cat, scheme, outcome, id, size, unique, holder, small): aliases and reappearances by id, not by entity.

    ``unique``: one entity of its own side has the id.  Of a removed entity whose
    id is seen again, ``holder`` tells whether an entity that was there before or
    has a counterpart holds it ('other'), or added ones only ('added'); ``small``
    whether its body is below the size that is matched.
    """
    ra, rb = records(a, by), records(b, by)
    scored = save(_scored(d, ra, rb, schemes, by), "scored")
    held = scored.where("b is not null and idb is not null").groupBy(*by, "scheme", F.col("idb").alias("ida")).agg(F.max(F.col("cat") != "added").alias("other"))
    s = scored.where("outcome in ('alias', 'reappear')").join(held, [*by, "scheme", "ida"], "left").join(ra.select(*by, F.col("ord").alias("a"), F.col("n").alias("nodes")), [*by, "a"], "left")
    alone = F.when(F.col("a").isNotNull(), F.col("alone")).otherwise(F.col("shared"))
    e = s.groupBy(*by, "cat", "scheme", "outcome", F.coalesce("ida", "idb").alias("id")).agg(F.count("*").alias("size"), (F.min(alone) == 1).alias("unique"), F.max("other").alias("other"), (F.min("nodes") < min_nodes).alias("small"))
    gone = (F.col("cat") == "removed") & (F.col("outcome") == "reappear")
    return e.select(*by, "cat", "scheme", "outcome", "id", "size", "unique", F.when(gone, F.when(F.coalesce("other", F.lit(False)), "other").otherwise("added")).alias("holder"), F.when(gone, F.col("small")).alias("small"))


def distinct_events(d: DataFrame, a: DataFrame, b: DataFrame, schemes: list[str], by: By = ()) -> DataFrame:
    """(cat, scheme, outcome, raw, events, largest, several, from_unique, held_by_added, held_by_other, small): events counted; the last three of unique ids."""
    e = events(d, a, b, schemes, by)
    of = lambda cond: F.count_if(F.col("unique") & F.coalesce(cond, F.lit(False)))
    return e.groupBy("cat", "scheme", "outcome").agg(
        F.sum("size").alias("raw"), F.count("*").alias("events"), F.max("size").alias("largest"), F.count_if(F.col("size") > 1).alias("several"), F.count_if("unique").alias("from_unique"),
        of(F.col("holder") == "added").alias("held_by_added"), of(F.col("holder") == "other").alias("held_by_other"), of(F.col("small")).alias("small"),
    )


def event_clusters(e: DataFrame, sizes: int = 8, commits: int = 3, commit: str = "child") -> DataFrame:
    """(cat, scheme, outcome, raw, events, distinct_ids, commits, without_top, top_sizes, top_commits) of many commits' ``events``.

    ``without_top`` leaves out the events of the commit with most entities (of
    several the first by name); the lists are texts, largest first.
    """
    key = ["cat", "scheme", "outcome"]
    per = e.groupBy(*key, commit).agg(F.sum("size").alias("raw"), F.count("*").alias("events"))
    one = per.groupBy(*key).agg(F.sum("raw").alias("raw"), F.sum("events").alias("events"), F.count("*").alias("commits"), F.min_by("events", F.struct(-F.col("raw"), F.col(commit))).alias("top"))
    known = e.select(*key, "id").distinct().groupBy(*key).agg(F.count("*").alias("distinct_ids"))
    # Sizes are counted before they are ranked: a few rows a key.
    rank = lambda df, *order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    size = rank(e.groupBy(*key, "size").agg(F.count("*").alias("times")), F.desc("size")).where(F.col("_n") <= sizes)
    size = size.withColumn("many", F.array_repeat(F.col("size").cast("string"), F.least("times", F.lit(sizes)).cast("int")))
    size = size.groupBy(*key).agg(F.array_join(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", "many"))), lambda x: x["many"])), 1, sizes), ",").alias("top_sizes"))
    busy = rank(per, F.desc("raw"), commit).where(F.col("_n") <= commits).withColumn("said", F.concat_ws(":", commit, F.col("raw").cast("string")))
    busy = busy.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "said"))), lambda x: x["said"]), " ").alias("top_commits"))
    return one.join(known, key).join(size, key).join(busy, key).select(*key, "raw", "events", "distinct_ids", "commits", (F.col("events") - F.col("top")).alias("without_top"), "top_sizes", "top_commits")


def reappearing_types(d: DataFrame, a: DataFrame, b: DataFrame, scheme: str = "entityId", by: By = ()) -> DataFrame:
    """(cat, type, other_type, n): removed and added entities whose id the other side has all the same, and the type it has there (the last by ord)."""
    ra, rb = records(a, by), records(b, by)
    other = lambda r: r.where(F.col(scheme).isNotNull()).groupBy(*by, F.col(scheme).alias("id")).agg(F.max_by("type", "ord").alias("other_type"))
    own = lambda r, c: r.select(*by, F.col("ord").alias(c), F.col(scheme).alias("id"))
    gone = d.where("cat = 'removed'").join(own(ra, "a"), [*by, "a"]).join(other(rb), [*by, "id"])
    new = d.where("cat = 'added'").join(own(rb, "b"), [*by, "b"]).join(other(ra), [*by, "id"])
    cols = ["cat", "type", "other_type"]
    return gone.select(*cols).unionByName(new.select(*cols)).groupBy(*cols).agg(F.count("*").alias("n"))


def common_schemes(meta: DataFrame) -> list[str]:
    """The id schemes that all commits have; ``meta`` has an array ``schemes`` a commit."""
    n = meta.count()
    return sorted(r.s for r in meta.select(F.explode(F.array_distinct("schemes")).alias("s")).groupBy("s").count().where(F.col("count") == n).collect())


def blind_spots(d: DataFrame, a: DataFrame, b: DataFrame, by: By = ()) -> DataFrame:
    """Removed records with a plausible edited successor among the added, or whose file is gone."""
    at = [*by, "ord"]
    ra = d.where("cat = 'removed'").select(*by, F.col("a").alias("ord")).join(records(a, by), at).select(*at, *KEY)
    ab = d.where("cat = 'added'").select(*by, F.col("b").alias("ord")).join(records(b, by), at).select(*by, *KEY)
    sibling = ab.select(*by, "file", "type").distinct().withColumn("sibling", F.lit(True))
    # Another file has it, unless the one file that has it is its own.
    other = ab.groupBy(*by, "name", "type").agg(F.min("file").alias("first"), F.max("file").alias("last"))
    here = b.select(*by, "file").distinct().withColumn("here", F.lit(True))
    all_ = ra.join(sibling, [*by, "file", "type"], "left").join(other, [*by, "name", "type"], "left").join(here, [*by, "file"], "left")
    return all_.agg(
        F.count("*").alias("removed"), F.count("sibling").alias("same_file_sibling"),
        F.count_if((F.col("first") != F.col("file")) | (F.col("last") != F.col("file"))).alias("same_name_elsewhere"), F.count_if(F.col("here").isNull()).alias("file_gone"),
    )


def check_unchanged(scores: DataFrame) -> None:
    """Unchanged entities must keep an id that is made of file and name."""
    bad = scores.where("cat = 'unchanged' and scheme = 'entityId' and outcome not in ('survive', 'missing')").agg(F.sum("n")).first()[0]
    if bad:
        raise ValueError(f"{bad} unchanged records lost their entityId")


def quality_gate(meta: DataFrame, least_files: int = 100) -> DataFrame:
    """Commits whose extraction had no error and enough files."""
    return meta.where(F.col("error").isNull() & (F.col("files") >= least_files)).select("sha").distinct()


def gated(records_: DataFrame, meta: DataFrame, least_files: int = 100) -> DataFrame:
    """Records of commits that pass the gate."""
    return records_.join(quality_gate(meta, least_files), "sha", "left_semi")


def rates(meta: DataFrame) -> DataFrame:
    """Least, greatest and mean share of records that found their declaration, over commits."""
    r = meta.where("declKeys > 0").select((100.0 * F.col("joined") / F.col("declKeys")).alias("rate"))
    return r.agg(F.count("*").alias("commits"), F.round(F.min("rate"), 1).alias("least"), F.round(F.max("rate"), 1).alias("greatest"), F.round(F.avg("rate"), 1).alias("mean"))


def examples(d: DataFrame, most: int = 6) -> DataFrame:
    """The first rows of each category, by their ordinals."""
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("cat").orderBy(F.coalesce("a", "b"), "b"))).where(F.col("_n") <= most).drop("_n")


def changing_commits(pairs: DataFrame) -> DataFrame:
    """(cat, rows, commits) of many pairs' classified rows, with column ``child``."""
    per = pairs.groupBy("child", "cat").agg(F.count("*").alias("n"))
    return per.groupBy("cat").agg(F.sum("n").alias("rows"), F.count("*").alias("commits"))
