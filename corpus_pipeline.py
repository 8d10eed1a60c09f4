"""The corpus pipeline: quality filter, near-dedup, decontamination, masking, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result to the shared folder and reads it back, so a
stage never recomputes an earlier one and a lost executor costs only its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlens.llm import decontaminate, minhash_dedup, packing, pii, quality, token_count
from factlens.llm.common import Scratch, table
from factlens.llm.queries import PIECES


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier of operator 10 accepts (score at least 0.3), all columns.

    Null and empty texts are scored like any empty text; a null id stays or goes
    by its text; repeated rows stay or go together; without labels all stay; an
    empty table gives an empty one; extra columns pass through.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (operator 1: five words, similarity 0.8) the smallest id's rows, all columns.

    Null, empty and wordless texts are like nothing and stay; null ids stay;
    rows that repeat an id stay or go together; an empty table gives an empty
    one; extra columns pass through.
    """
    return minhash_dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that operator 3 doesn't find contaminated by ``benchmark``, all columns.

    Null and empty texts and null ids stay; repeated rows stay or go together;
    empty tables take nothing away; extra columns pass through.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the spans of operator 9 in ``text`` replaced by marks, and ``n_chars`` counted anew.

    A null text stays null and an empty one empty; of spans that overlap the
    first's mark stands for all; ids and extra columns pass through.
    """
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each packed sequence (operator 4), with its documents' ids, lengths and texts in order.

    Null and empty texts are an end mark only; null ids are packed like others;
    repeated rows are each packed; very long texts are spread over sequences; an
    empty table gives none.
    """
    return packing.sequences(docs, token_count.load_pieces(PIECES))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mask_personal_data", mask_personal_data),
    ("pack_sequences", pack_sequences),
]

#: A fitted classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        last, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
