"""The corpus pipeline: documents pass through five operators.

Each stage reads what the one before has written as Parquet and returns the columns of documents,
but for the last, which returns a row per document of the token file.  A null or empty table
passes through all stages; further columns of documents stay with their rows up to the token file.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronolake.llm import decontaminate, mixing, neardup, quality, tokenfile
from chronolake.llm.common import removed, table, written
from chronolake.llm.docstats import held_out

#: Documents with a quality score below this are rejected.
KEEP = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels outside its held-out fold, accepts."""
    model = quality.fitted(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return quality.accepted(docs, model, KEEP)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return neardup.kept_rows(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of the documents, read back: doc_id, start, n_tokens and ids_crc32 of each."""
    return tokenfile.digests(spark, tokenfile.token_file(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]
#: The learned first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents on; a stage's table is removed when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        removed(spark, *before)
        before = [path]
    out = STAGES[-1][1](spark, docs, sf_dir)
    removed(spark, *before)  # the token file holds what it takes
    return out
