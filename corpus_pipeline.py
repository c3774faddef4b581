"""The corpus pipeline: stages that each read what the one before kept.

toxicity -> exact dedup -> near dedup -> decontamination -> packing. All stages but
the last return the columns of ``documents``, whatever else those hold and whatever they are
called; the last returns the packed pieces. Empty tables give empty results. Null and
empty texts: see each stage. Repeated rows are rows of their own up to exact dedup, which
keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prismview.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from prismview.llm.scratch import scratch_dropped, shared_folder, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not call toxic. A null or empty text has score 0 and stays; without both labels nothing can be learnt and all stay."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest id; null ids lose, and of rows with equal ids one stays."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.75 of their five-word shingles the row with the smallest id. Texts without words are linked with nothing and stay; null ids lose."""
    return near_dedup.survivors(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words is in benchmark windows. Texts without words are clean; items without words match nothing."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in as few sequences as they fit in. A null text is an empty one: its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: The learnt model and the tokenizer have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch_dropped(spark):  # the stage's own tables
            docs = written(stage(spark, docs, sf_dir), name, folder)
    return docs
