"""The operators' queries over the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_tree, collocations, html_extract, katz, language_id, license_scan, line_spread, minhash, packing, quality_rules, secret_scan, spaced_seed, whitening
from .storage import workers_import_us


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import_us(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.train_and_score(table(spark, sf_dir, "documents"))


def op3_spaced_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack(table(spark, sf_dir, "documents")))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_spread.remove_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents declare a language and name a source as host; their sources have no address suffix."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where there is all evidence: pages have an html element's lang and an address."""
    return language_id.identify(language_id.page_evidence(table(spark, sf_dir, "pages")), ("page_id",))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    parts = rows.select("vec_id", "n", F.expr("try_cast(deviation as long)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return parts.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_katz, op3_spaced_seed, op4_minhash, op5_packing, op6_html_extract, op7_secret_scan, op8_line_spread, op9_ann_tree, op10_language_id, op10_language_id_pages, op11_whitening, op12_quality_rules, op13_collocations)
}
ORACLES: dict[str, str] = {"op7_secret_scan": secret_scan.oracle(), "op8_line_spread": line_spread.ORACLE, "op12_quality_rules": quality_rules.oracle(), "op13_collocations": collocations.oracle()}
