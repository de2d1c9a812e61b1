"""A corpus pipeline: toxic texts out, foreign and unreadable ones out, near copies out, the rest packed.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
and read again as the next one's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.llm import stages
from ledgerweave.llm.text import table
from ledgerweave.workspace import Workspace

STAGES = [
    ("toxicity", stages.without_toxic),
    ("language", stages.readable),
    ("near-dedup", stages.deduplicated),
    ("packing", stages.packed),
]

#: Trained classifiers, profiles and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
