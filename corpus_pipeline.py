"""From raw documents to sampled token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.common import materialise, table
from folioframe.llm.decontaminate import keep_clean
from folioframe.llm.pieces import digests, sample_segmentations
from folioframe.llm.quality import keep_good
from folioframe.llm.secrets import redact
from folioframe.llm.simhash import keep_one


#: Characters encoded together, a quarter of what op1 takes: an executor has been through four stages by then, and its two workers share the rest with it.
CHUNK = 300_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail a base rule or lie far from their language and source go, each judged for itself.

    Null and empty texts fail; null languages and sources are groups of their
    own; rows that share an id, or have none, don't share a verdict; repeated
    rows and ties do; an empty table gives none; other columns pass whatever
    their names, long texts whole.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id stays, of equal ids one.

    Rows without an id come after all others of their component. Null and
    empty texts are copies of one another; an empty table gives none; other
    columns pass whatever their names, long texts whole.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go, each searched for itself.

    Null and empty texts and items contain nothing; rows that share an id, or
    have none, don't share a verdict; empty tables change nothing; other
    columns pass whatever their names, long texts whole.
    """
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credentials are replaced by their kind in brackets; all rows stay.

    Null and empty texts stay as they are; repeated rows are each redacted; an
    empty table gives none; other columns pass whatever their names, long texts whole.
    """
    return redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations, as token ids, of each row that is left.

    Null and empty texts have one, of no ids; rows with equal id and text have
    equal ones; a row without an id is seeded by its text; an empty table gives
    none; other columns are not looked at, long texts are encoded whole.
    """
    return digests(sample_segmentations(docs, chunk=CHUNK))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", remove_secrets),
    ("sentencepiece encoding", encode),
]

#: No stage but decontamination can be said in SQL; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
