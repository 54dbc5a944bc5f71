"""A corpus from documents: quality rules, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, those of any other name too, as they were.

Null texts, and empty ones, have no words: the first stage drops them, and each other stage takes them without harm. A long
text is one row of a task in each stage. Rows of a null id are judged like any others, but are never trusted and never
dropped as copies, as nothing names them. Repeated rows are each a row, until the third stage keeps one of them. Ties go by
the id, then by the text. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, near_dups, packing, quality_rules
from tessera.llm.common import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep. Null and empty texts go, a score equal to the threshold stays,
    repeated rows stay or go together. ``labels`` of null id or value are no trust; without any only the rules decide."""
    judged = quality_rules.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats; n_chars is counted anew where there is such a column.

    A null text stays null, a null source is a source of its own, and each repeated row counts as a page. No row goes.
    """
    left = line_dedup.line_dedup(docs, host="source").withColumn("row", F.col("row").withField("text", F.col("text")))
    return left.withColumn("row", F.col("row").withField("n_chars", F.length("text").cast("long"))).select("row.*") if "n_chars" in docs.columns else left.select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id, of equal ids the one of least text digest.

    Texts without words, and rows of null id, stay. Texts that share an id and are no copies of one another all stay.
    """
    return near_dups.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null and empty texts stay; items without words are in none."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("spans") == 0).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 2048. A null or empty text is the end id alone; a null id stays
    null; each repeated row is packed on its own."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048, cached_pieces=200_000)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Hashed counts, tokenizer ids and tree packing have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``: the last one's rows. Each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
