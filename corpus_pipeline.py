"""A training corpus from documents: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet into the
shared folder and reads it again as the next stage's documents.

- quality: documents whose perplexity is outside their language's quantiles go, and so do those
  without text.  Rows with the same doc_id stay or go together.
- language: documents without a letter, or close to no language, go.
- near_duplicates: of the texts that SimHash finds alike by 0.8 in their five-word shingles, the
  one with the least doc_id stays, once; a text without a doc_id stays if no text like it has one.
  Texts are told apart by themselves, not by doc_id, so rows that share a doc_id lose no text.
- packing: the batches of token ids: their bucket, doc_ids, lengths and padded ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.files import delete
from tabulon.llm import kneser_ney, language_id, packing, simhash
from tabulon.llm.common import table, written
from tabulon.llm.queries import byte_pairs

#: The least cosine with the nearest language profile.
MIN_COSINE = 0.1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the Kneser-Ney classifier, trained on the labelled good ones, finds good."""
    judged = kneser_ney.classify(docs, table(spark, sf_dir, "labels"))
    good = judged.where("good").select(F.col("doc_id").alias("__good_id")).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["__good_id"]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which some language is found."""
    prototypes = language_id.learn(docs)
    found = language_id.predict(docs, prototypes, made=("__lang_pred", "__cosine"))
    known = (F.col("__lang_pred") != language_id.UNKNOWN) & (F.col("__cosine") >= MIN_COSINE)
    return found.where(known | F.lit(not prototypes)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.without_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of the length buckets, with their documents' padded token ids."""
    return packing.pack_documents(docs, *byte_pairs())


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", packed)]

#: SQL expresses none of the first three stages; the tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table over the documents of ``sf_dir``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            delete(spark, last)
        last = path
    return docs
