"""The corpus pipeline: documents to token ids, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, pieces, pseudonyms, quality_rules, simhash
from quillstone.llm.common import Scratch, read

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("pseudonyms", pseudonyms.stage),
    ("pieces", pieces.stage),
]
#: SQL can't express perplexities, fingerprints and segmentation; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
