"""The stages of the corpus pipeline, each a decision by one of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import langid, neardup, packing, toxicity
from ledgerweave.llm.text import configure, fold, table
from ledgerweave.workspace import Workspace

#: A text of at least so many characters, and of a smaller likeness to its language, is taken as unreadable.
ENOUGH_CHARACTERS = 100
LEAST_LIKENESS = 0.1


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers do not call toxic; labels of four of five folds train them."""
    configure(spark)
    known = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    training = toxicity.sample(docs.where(fold("doc_id", 5) != 0), known)
    model = toxicity.fit(Workspace(spark, "toxicity"), training, toxicity.prior_of(known))
    return docs.where(toxicity.scorer(model)(F.col("text")) < 0.5)


def readable(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages.

    Those without a letter go, and those long enough to tell that resemble no language learned.
    """
    configure(spark)
    profiles = langid.fit(Workspace(spark, "language"), langid.sample(docs))
    judged = langid.judge(profiles)(F.col("text"))
    unlike = (F.length("text") >= ENOUGH_CHARACTERS) & (judged["likeness"] < LEAST_LIKENESS)
    return docs.where((judged["lang_pred"] != langid.UNDETERMINED) & ~unlike)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest key, of each group of near copies: five-word shingles, similarity 0.8."""
    configure(spark)
    judged = neardup.near_copies(Workspace(spark, "deduplicated"), docs)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    configure(spark)
    return packing.pack(Workspace(spark, "packed"), docs, public_tokenizers.path("byte_bpe_50k.json"))
