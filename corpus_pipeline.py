"""A corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)``, works on all rows of ``docs`` and returns a DataFrame that the next
one reads from a file. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import languages, likeness, packing, quality_model, substrings
from tapeloom.llm.common import written

#: SQL for the rows of ``run``: models, fingerprints and tokenizers can't be expressed in it.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the weak-label model on all of ``docs`` and keep what it scores 0.5 or more."""
    rows = quality_model.scored(docs, quality_model.fit(docs))
    return rows.where("score >= 0.5").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose main language has at least half of the text; ``und`` goes.

    The models learn from rows with a language that are not held out.
    """
    model = languages.learn(docs.where(~languages.held_out()))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    rows = languages.identify(rows, model, ["row"])
    return rows.where(F.col("lang_pred") != languages.UNKNOWN).where("score >= 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class linked at a likeness of 0.8 or more of five-word shingles."""
    return likeness.one_of_each(docs, percent=80, size=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words in windows of 35 that start at another place too; all other text stays as it is."""
    rest = F.struct(*(docs[c] for c in docs.columns if c != "text"))
    rows = substrings.without_repeats(docs.select("doc_id", "text", rest.alias("row")), least=35, keep=["row"], source=True)
    values = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept").cast("long"))}
    return rows.select(*(values[c].alias(c) if c in values else F.col(f"row.`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
