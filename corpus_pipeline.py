"""From raw documents to token ids, in five stages that each work on all that the one before kept.

``run`` writes what every stage but the last returns to the shared folder and rereads it, so that a lost
executor costs no stage again, and removes what is read no more.

Every stage takes any table with the columns of documents, whatever further columns it has; all but the last return
just these columns, and all return an empty table for an empty one. What else a stage does with odd rows stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.shared import made, remove, scratch, stored
from factweave.llm import jaccard, linededup, mixing, pieces, quality
from factweave.llm.common import WS, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. Its model is learnt from the labels of ``docs``.

    A null or empty text is scored as one without words, a text of any length whole; rows with a null id are scored and
    never learnt from; equal rows get equal scores and go or stay together; without labels all scores are 0.5, so all stay.
    """
    scored = quality.score_rows(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes common blocks of lines from later documents, and documents of which nothing but blanks is left.

    Null and empty texts stay as they are; documents are ordered by id, a null id last, those with one id by a hash of the
    text; rows equal in id and text are one document and stay alike; n_chars is counted anew where lines went.
    """
    clean = linededup.dedup(docs)
    emptied = (F.col("n_deleted") > 0) & (F.regexp_replace("text", WS, "") == "")
    text_length = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", text_length).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group.

    Rows that share an id are one document: those of a kept one all stay, but each text once. Rows without an id, a text or
    words are in no group and stay; of those equal in id and text one stays.
    """
    groups = jaccard.join(docs).where("doc_id IS NOT NULL AND n_shingles > 0")
    kept = groups.groupBy("doc_id").agg(F.min("component_id").alias("root")).where("doc_id <> root").select("doc_id")
    alone = docs.join(kept, "doc_id", "left_anti")
    return alone.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every source at its target, documents repeated or cut as the draw says.

    A null source is a source of its own; null texts and texts without words take none of the target and are in the mix once;
    repeated rows are drawn one after the other; n_chars is counted anew, null for a null text.
    """
    drawn = mixing.draw(docs, F.col("doc_id"), carry=["doc_id", "text", "lang", "n_chars"])
    return mixing.materialise(drawn, COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix: null for a null text, none for an empty one, equal for equal texts."""
    return pieces.encode(docs.select("doc_id", "source", "text")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("sentencepiece", tokenize),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, path = made(), scratch(spark, name.replace(" ", "-"))
        docs = stored(stage(spark, docs, sf_dir), path)
        remove(spark, *(made() - before - {path}), *([last] if last else []))
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
