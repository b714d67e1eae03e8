"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage reads all that its predecessor kept; ``run`` writes every stage to the shared folder, so a lost executor
costs one stage's work at most.  A stage's files, and those it wrote on the way, are deleted once its successor is written.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import decontaminate, packing, quality, secrets, simhash
from framelake.llm.common import drop_stage, run_stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, by the shingles and bits of the operator's contract."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not name."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret redacted."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, run_stage(partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
        drop_stage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
