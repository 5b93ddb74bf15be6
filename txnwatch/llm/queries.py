"""One query per operator over its whole table, with production parameters, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm import alignment, decontaminate, licenses, manifest, neighbours, oracle, packing, quality, sharding, simhash, substrings, token_counts, toxicity, urls
from txnwatch.llm.urls import Rule

#: Name of the vocabulary files; their folder is that of the installed package.
PACKING_TOKENIZER = "byte_bpe_50k.json"
COUNTING_TOKENIZER = "piece_bpe_32k.model"
PACKED_TOKENS = 1024
TOKEN_BUDGET = 4096
URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"),
             Rule("block", "com", "/de/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, packing.file_encoder(tokenizer_path(PACKING_TOKENIZER)), end_id=0, window=PACKED_TOKENS, with_ids=False)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc.id").alias("doc_id"), "start", "length", "kind", "cluster_doc", "cluster_start", "removed")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(COUNTING_TOKENIZER), TOKEN_BUDGET)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_on_open_labels(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumn("doc_id", F.col("doc.id"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         F.size("spans").alias("offending_sentences"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_copies(table(spark, sf_dir, "documents"))
    return groups.select(F.col("doc.id").alias("doc_id"), simhash.hex_print(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc.id").alias("doc_id"), "item_id", "windows", F.col("of").alias("item_windows"), F.round("coverage", 6).alias("coverage"),
                        "first_word", "last_word", "reparameterised", "consistent")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified_documents(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER), tokenizer_path(COUNTING_TOKENIZER))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_token_counts, op4_licenses, op5_urls, op6_neighbours, op7_toxicity, op8_simhash,
                                      op9_sharding, op10_decontamination, op11_manifest, op12_alignment, op13_quality)}
ORACLE = {
    "op4_licenses": oracle.license_scan(licenses.TEMPLATES, licenses.PHRASES, licenses.THRESHOLD),
    "op5_urls": oracle.url_verdicts(URL_RULES),
    "op11_manifest": oracle.manifest_proofs(manifest.FIELDS),
}
