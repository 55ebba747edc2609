"""A corpus from raw documents to packed training sequences: five operators of segspark.llm, one after another."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import read, shared_dir
from segspark.llm.decontam import decontaminate
from segspark.llm.langid import identify
from segspark.llm.lines import dedup_lines
from segspark.llm.packing import pack
from segspark.llm.simhash import near_duplicates

CARRY = ("lang", "source")
#: A language is taken for certain from here on; texts below are rejected with those without letters.
MIN_SCORE = 0.5


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars is that of the text as it is now."""
    return df.select("doc_id", "text", "carried.lang", "carried.source", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    Texts that are null, empty or without a letter go, however long they are; so does every text if none is labelled. Each of
    repeated rows is judged by its text, so they stay or go together; a tie between languages goes to the name that sorts
    first. A null id becomes -1. Other columns are dropped, whatever their names. No rows give no rows.
    """
    return _columns(identify(docs, carry=CARRY).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines; texts may become empty, rows never go.

    Null texts become empty ones; a null id becomes -1. A repeated line stays in the largest id that holds it; rows that share
    this id all keep it. Very long texts are split whole. Other columns are dropped, whatever their names. No rows give none.
    """
    return _columns(dedup_lines(docs, carry=CARRY))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies: texts with a Jaccard similarity of 0.8 or more
    over shingles of five words.

    Null and empty texts are copies of one another, of which one stays; a null id counts as -1 and is left as it is. Rows
    that share an id stay or go together, so repeated rows of the smallest id stay. Very long texts are compared whole. Other
    columns are dropped, whatever their names. No rows give no rows.
    """
    found = near_duplicates(docs, width=5, similarity=0.8)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("keep_id")).distinct()
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return own.join(keep, F.coalesce(own["doc_id"], F.lit(-1)) == keep["keep_id"], "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: less than a twentieth of their words lies in windows of the benchmark.

    Null, empty and wordless texts are clean; very long ones are scanned whole. Repeated rows stay or go together; exactly a
    twentieth is contaminated. A null id becomes -1. Other columns are dropped, whatever their names. No rows give no
    rows, an empty benchmark leaves all.
    """
    return _columns(decontaminate(docs, read(spark, sf_dir, "benchmark"), carry=CARRY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids.

    Null and empty texts are their end id alone; a null id becomes -1; rows that share an id are packed each for itself.
    Very long texts are cut into many pieces, none is dropped. Other columns are ignored. No rows give no rows.
    """
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Components of near copies, language models and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
