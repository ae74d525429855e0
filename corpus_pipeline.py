"""From documents to packed sequences: five stages, each written as Parquet and read again by the next.

1. ``language_id`` keeps documents with a language; those without a letter, or with an unsure language, go.
2. ``exact_dedup`` keeps the document with the largest id of each text.
3. ``simhash`` keeps the document with the smallest id of each group of near copies, by wide SimHash fingerprints of
   five-word runs and a radius for a similarity of 0.8.
4. ``decontamination`` keeps documents without a window of a benchmark item.
5. ``packing`` returns the pieces of the documents that are left, with their places in sequences.

The first four return documents with all their columns. Nulls, empty and repeated rows are treated as the operators say.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import exact_dedup, language_id, near_copies, packing, phrases
from strandlake.llm.common import table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.keep_known(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrases.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can express neither the language model nor the tokenizer; ``tests/llm/test_pipeline.py`` has a plain version.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="corpus-pipeline-")
    return f"{shared.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
