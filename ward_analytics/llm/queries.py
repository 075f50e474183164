"""One registered query per operator of this subpackage, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ward_analytics.llm import conversations, decontaminate, html_text, langid, licenses, merkle, ngram_join, oracles, packing, quality, recompression, sharding, suffix_dedup, toxicity
from ward_analytics.llm.tables import held_out, load, ship

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES = oracles.SQL


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return fn(spark, folder)

    REGISTRY[fn.__name__] = run
    return run


@query
def op1_language(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents").withColumn("held_out", held_out())
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    languages, chance = langid.learn(documents.where("not held_out"), pieces)
    return langid.identify(documents, languages, chance, pieces, ["doc_id", "held_out"])


@query
def op8_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = recompression.remove_repeats(load(spark, d, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(load(spark, d, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(load(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, d, "documents"), load(spark, d, "benchmark"))


@query
def op10_html_text(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(load(spark, d, "pages"))


@query
def op2_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.classes(load(spark, d, "documents"))


@query
def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents").withColumn("held_out", held_out())
    model = toxicity.fit(documents, load(spark, d, "labels"))
    return toxicity.score(documents, model, ["doc_id", "held_out"])


@query
def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(load(spark, d, "documents"))


@query
def op4_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(load(spark, d, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every row's proof. Every second row is tampered with (line feeds deleted): its own leaf changes, the siblings are the original ones."""
    documents = load(spark, d, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(tampered & F.col("text").contains("\n"), merkle.leaf(text=F.replace("text", F.lit("\n"), F.lit(""))))
    manifest = merkle.build(documents, {"changed": changed})
    folded = merkle.fold(F.coalesce("changed", "digest"))
    root = F.lit(manifest.root).cast("string")
    proofs = merkle.prove(manifest).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), merkle.siblings_digest().alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(load(spark, d, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations")
    return conversations.repair(conversations.damage(rows), known=rows)
