"""The corpus pipeline: raw documents to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet to the cluster's
shared folder and rereads it as the next stage's documents, so every stage works on all that its predecessor kept, and
a lost executor costs no more than the stage it worked on. A stage's table, and what the stage itself wrote, is deleted
when the next one is written; only the last remains.

Defined cases: documents without text, with an empty one, or without a letter have no language and go in the first
stage; rows with a null id are kept by every stage that keeps their text; rows that repeat or share an id are one
document each until the join's stage, of which one row of each group of near copies stays; very long texts go whole
through all stages; further columns, whatever their names, are kept to the end, where ``token_ids`` is added (and
replaces a column of that name); an empty table gives no rows.

SQL can't express language identification, greedy tiling or the tokenizer, so there is no SQL twin; the stages are
tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexloom.llm import decontaminate, jaccard_join, language_id, line_dedup, sentencepiece_codec
from hexloom.llm.common import dropped, scratch, written

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("sentencepiece", sentencepiece_codec.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch():
            done = written(stage(spark, docs, sf_dir), name, keep=True)
        dropped(docs)  # nothing but a table that ``written`` made
        docs = done
    return docs
