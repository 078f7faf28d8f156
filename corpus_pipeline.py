"""Documents to packed training sequences.

`STAGES` in order: toxic documents go, repetitive and very short ones go, one document of each
group of near copies stays, passages that an earlier document holds go, and the rest is packed,
with the token ids of each piece.
Each stage works on the rows that the one before wrote; all but the last return the columns of
`documents`. Columns beyond these pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import automaton, covering, packing, repetition, toxicity
from turnwise.llm.common import documents, fold
from turnwise.session import ensure_checkpoint_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id") != 0)
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def with_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return covering.distinct(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = automaton.without_passages(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer = packing.file_tokenizer(public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packing.pack(docs, tokenizer)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality", with_quality),
    ("near_duplicates", without_copies),
    ("passages", without_passages),
    ("packing", packed),
]

#: No SQL gives the rows of trained dictionaries, fingerprints and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
