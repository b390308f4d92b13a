"""From raw documents to a training mix: quality, near-duplicates, decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir), with docs as the stage before left them, and calls
one operator of ``fieldloom.llm``.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontamination, mixing, near_dedup, pii, quality_rules
from fieldloom.llm.common import checkpoint_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust distance keep.

    Null and empty texts have no words and go.  Null languages and sources are groups of
    their own.  Rows that agree in id, text, language and source share their verdict, and
    each counts in the estimates.  An empty table stays one.
    """
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, by five-word shingles at 0.8: the smallest id.

    Null and empty texts are linked with nothing and stay.  Of rows that share an id one
    stays; rows without an id all stay.  An empty table stays one.
    """
    return near_dedup.deduplicate(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts have no words and stay; null and empty items take nothing.  Rows
    that agree in id and text share their verdict.  An empty table stays one.
    """
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind, and n_chars as it is then.

    Null texts stay null with their n_chars, empty ones empty; repeated rows each come back
    with the same text.  An empty table stays one.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for, with the number of each copy.

    A null source is a source of its own, last in order; null and empty texts have size 0.
    Rows that agree in id and text get the same copies.  An empty table stays one.
    """
    return mixing.emit(mixing.mix(docs)).select(*docs.columns, "size", "target", "copies", "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("pii", remove_pii),
    ("mixing", mix),
]
#: SQL cannot express the robust distance nor the discovered patterns; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    A stage's table is deleted once the next one is written; the result reads the last of
    them, which goes with the folder of the session's checkpoints.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if old:
            _delete(spark, old)
        old = f"{folder}/{name}"
        docs = spark.read.parquet(old)
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
