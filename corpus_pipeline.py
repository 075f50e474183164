"""A corpus from raw documents to packed sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; what it returns is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ward_analytics.llm import decontaminate, idmap, langid, ngram_join, packing, recompression
from ward_analytics.llm.tables import cut, held_out, load, shared_folder, ship

#: A text whose letters cost more nats each, in its best language, than nearly any mix of known words is in none.
WORST_NATS = 5.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter, or unlike every language, go."""
    ship(spark)
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    languages, chance = langid.learn(docs.where(~held_out()), pieces)
    found = langid.identify(docs.select(F.struct(*docs.columns).alias("row")), languages, chance, pieces, ["row"], text="row.text")
    return found.where((F.col("lang_pred") != "und") & (F.col("nats_a_letter") <= WORST_NATS)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    ship(spark)
    found = cut(ngram_join.classes(docs).where("component_id < doc_id").select("doc_id"))
    return idmap.without(docs, found)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has, too; those of which nothing is left go."""
    ship(spark)
    found = recompression.remove_repeats(docs, rest=docs.columns).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("rest.text"))
    columns = {c: F.col(f"rest.{c}") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    return found.select(*[value.alias(name) for name, value in columns.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    ship(spark)
    return decontaminate.drop_leaking(docs, load(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("packing", packed),
]

#: SQL can't express language models, recompression or packing; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what each returns lies in the shared folder, where it can be looked at and removed afterwards."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
