"""From raw documents to packed training sequences, in five stages over whole tables.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the
last return the columns of documents, with their values, but for text and n_chars: also columns that
are named like a figure of an operator. Quality and near-duplicate decisions are by doc_id: rows that
repeat an id stay or go together, rows without an id stay. Rows with a null or empty text pass all
stages; such a text is packed as its end mark alone. Of equal documents the smallest id stays. Null
languages have the threshold of all languages, null lengths are counted anew. An empty table gives
no rows; without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import neardup, packing, pii, quality, substring
from barlake.llm.storage import discard, finished, read_table

SIMILARITY = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose perplexity exceeds their language's threshold."""
    judged = quality.classify(docs, read_table(spark, sf_dir, "labels"), stable=True)  # docs are a table in files
    return without(docs, judged.filter(~F.col("keep")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    return without(docs, neardup.group(docs, percent=SIMILARITY).filter(~F.col("kept")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that also stand in a document with a smaller id; documents stay."""
    return sized(substring.remove_repeats(docs, with_text=True), docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by marks of its kind; documents stay."""
    return sized(pii.mask(docs), docs.columns)


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, the length of the text counted anew."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all token ids into sequences; one row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each result is written before the next stage reads it."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(*before)  # of each stage only its result stays, until the next one is written
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
