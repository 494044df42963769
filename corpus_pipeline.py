"""From raw documents to packed token sequences, in stages that hand each other written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm import language_id, line_spread, minhash, packing, spaced_seed
from atlasframe.llm.queries import packed_digest, table
from atlasframe.llm.storage import materialize, workers_import_us

#: Documents that share that many percent of their five-word shingles are near-duplicates.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages."""
    workers_import_us(spark)
    return language_id.remove_rejected(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; n_chars follows the text. Documents that only held such lines go, as all their text stands elsewhere."""
    workers_import_us(spark)
    cleaned = line_spread.remove_boilerplate(docs)
    left = cleaned.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    text_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", text_chars).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    workers_import_us(spark)
    return minhash.remove_near_duplicates(docs, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return spaced_seed.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, see op5."""
    workers_import_us(spark)
    return packed_digest(packing.pack(docs))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("decontaminate", decontaminate), ("pack", pack_tokens)]

#: Sketches, seeds and token ids aren't within SQL's reach; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
