"""``python -m factlens extract|check|ask|history|trace``: facts from a source tree, invariants, the six questions, versions, runtime.

Exits with 1 if an invariant is violated; facts are written before they are checked.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from factlens.config import Config
from factlens.facts import FactBase
from factlens.operators import integrity
from factlens.plans import history, reports
from factlens.sources import extract, facts_io, tree


def _show(sections: dict, most: int = 20) -> None:
    for name, df in sections.items():
        print(name)
        df.show(most, truncate=False)


def _history(spark: SparkSession, a: argparse.Namespace, c: Config) -> int:
    prefixes = [x for x in a.commits.split(",") if x]
    pairs = history.commit_pairs(spark, a.repository, a.path, a.most_commits or None, prefixes or None)
    new = history.collect(spark, a.repository, a.out, pairs, a.path)
    print(f"{len(new)} commits read")
    sections = history.compare(spark, a.out, pairs, c.min_nodes, a.least_files)
    _show(sections)
    from factlens.operators.snapshot import check_unchanged

    check_unchanged(sections["scores"])
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    c = Config.from_env()
    p = argparse.ArgumentParser(prog="factlens")
    p.add_argument("command", choices=["extract", "check", "ask", "history", "trace"])
    p.add_argument("--target", default=c.target)
    p.add_argument("--out", default=c.out)
    p.add_argument("--repository", default=c.repository, help="history: the repository")
    p.add_argument("--path", default=c.path, help="history: the part of it that is read")
    p.add_argument("--commits", default=c.commits, help="history: beginnings of child commits, comma-separated")
    p.add_argument("--most-commits", type=int, default=c.most_commits, help="history: so many pairs, evenly spread")
    p.add_argument("--least-files", type=int, default=c.least_files, help="history: commits with fewer files don't count")
    p.add_argument("--runtime", default=c.runtime, help="trace: merged runtime facts")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "history":
        return _history(spark, a, c)
    if a.command == "extract":
        fb = extract.extract(tree.source_files(spark, a.target, c.glob), c.local_references, c.unique_members)
        facts_io.write(extract.wide(fb), a.out)
        for r in fb.errors.limit(50).collect():
            print(f"not parsed: {r.file}:{r.line} {r.name}", file=sys.stderr)
    fb = FactBase.read(spark, a.out)
    if a.command == "trace":
        _show(reports.trace(fb, spark.read.parquet(a.runtime)))
        return 0
    if a.command == "ask":
        for q in reports.questions(fb):
            print(f"\n{q.question}? {'ANSWERED' if q.answered else 'CANNOT ANSWER'}{': ' + q.note if q.note else ''}")
            q.rows.show(10, truncate=False)
        return 0
    _show(reports.statistics(fb))
    try:
        integrity.assert_invariants(fb)
    except integrity.IntegrityError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
