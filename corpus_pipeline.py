"""A corpus pipeline: five operators in turn over the documents.

Each stage reads what the one before it has written, and its decisions take effect: texts without a
known language go, one document of each group of near copies stays, contaminated documents go and
single benchmark passages are cut out of the others, sources are mixed to their target weights, and
what is left is written as token files, whose documents are the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, language, mixing, neardup, tokens
from nearfield.llm._shared import discard, held_out, private, scratch, stage

#: Similarity of word shingles, in hundredths, from which documents are near-duplicates here.
LINK = 80


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    prefix = private(docs)("")  # no column of the documents begins with it
    return language.classify(docs, model, prefix).where(~F.col(f"{prefix}rejected")).select(*docs.columns)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, LINK)


def _counted(docs: DataFrame) -> DataFrame:
    """With n_chars in step with texts that were cut."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else docs


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _counted(clean)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix(docs))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _language),
    ("near_dedup", _near_dedup),
    ("decontamination", _decontaminate),
    ("mixing", _mix),
    ("token_files", _tokens),
]

#: SQL can't express the first two stages; tests hold the pipeline against plain versions of them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again.

    What a stage has staged goes when it is written, and its input too, so that only the result stays. Null texts
    and empty ones go in the first stage, as they have no language; rows that share a doc_id are documents
    of their own; an empty table makes no rows; texts may be of any length, and columns of any name stay.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        with scratch(spark) as made:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            written = made.pop()  # the last folder made is that of the stage itself
        if before:
            discard(spark, before)
        before = written
    return docs
