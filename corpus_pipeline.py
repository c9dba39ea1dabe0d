"""Corpus pipeline: language ID, quality classifier, n-gram Jaccard join, best-fit packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame that works on all documents its predecessor kept; `run`
applies them to the documents table, each result written as Parquet and read back as the next one's docs. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import language_id, ngram_jaccard, packing, quality_classifier
from framelake.llm.common import materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter and texts far from every language go."""
    model = language_id.fit(docs, F.lit(True))
    return language_id.identify(whole(docs), model, "text").where(~F.col("rejected")).select("doc.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier puts in label 1."""
    weights = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality_classifier.score(whole(docs), weights, "text").where(F.col("score") >= 0.5).select("doc.*")


def whole(docs: DataFrame) -> DataFrame:
    """(doc, text): the row as one column, so that no name of it clashes with a result."""
    return docs.select(F.struct(*docs.columns).alias("doc"), "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates, once; documents with a null id stay.

    Near duplicates have a Jaccard similarity of at least 0.8 on shingles of five words (op3 alone takes 4 words and 0.85).
    """
    found = ngram_jaccard.join_components(docs, size=5, percent=80)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    rest = [F.col(c) for c in docs.columns if c != "doc_id"]
    kept = docs.join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("least"))
    kept = kept.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"least.{c}").alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, as operator 10 returns them."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [("language_id", known_language), ("quality_classifier", good_quality), ("ngram_jaccard_join", one_of_each_group), ("best_fit_packing", packed)]
ORACLE_SQL = None  # trained models and tokenisers have no SQL form; tests hold the stages to their contracts, not yet run() to a brute-force result


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
