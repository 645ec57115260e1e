"""A training corpus from raw documents, stage by stage; each stage reads what the one before it wrote.

Stages: toxicity (documents that it rejects go), quality rules (documents that
they reject go), near duplicates (one document of each group stays), personal
data (found spans are replaced by their kind), packing (sequences of token ids).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import minhash, packing, pii, quality, toxicity
from wayfold.llm.common import table, written
from wayfold.session import ship


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the limit; the model is fitted on labelled documents of docs."""
    ship(spark)
    model = toxicity.fit_on(docs, toxicity.labelled_grades(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where(F.col("severity") < toxicity.REJECT).select("_row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps."""
    return quality.keep_good(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, similarity 0.8 or more."""
    ship(spark)
    return minhash.keep_one(docs, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced; n_chars is that of the new text."""
    ship(spark)
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids at most: one row for each piece of a document."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [("toxicity", not_toxic), ("quality_rules", good), ("near_duplicates", unique), ("personal_data", without_personal_data), ("packing", packed)]
#: The stages hold fitted models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
