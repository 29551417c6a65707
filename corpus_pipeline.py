"""A corpus pipeline over documents: rules, classifier, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet in the shared folder and reads it again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import line_dedup, packing, quality_classifier, quality_rules, simhash
from crestline.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_rules.keep_good(docs).select(*COLUMNS)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go. The model learns from the labelled documents of the whole table."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality_classifier.score_column(spark, model)(F.coalesce("text", F.lit("")))
    return docs.filter(scored >= quality_classifier.THRESHOLD).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; every document stays, n_chars is that of what is left."""
    return line_dedup.with_lines_dropped(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays."""
    return simhash.keep_one(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed into sequences; a row per piece. A first line bears no loss."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), prompt=packing.first_line(F.col("text")), max_loss=packing.MAX_LOSS)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: The classifier, XXH64 fingerprints and BPE are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
