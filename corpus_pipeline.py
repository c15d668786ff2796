"""A cleaning pipeline over `documents`: rules, near copies, benchmark passages, private data, packing.

Each stage takes ``(spark, docs, sf_dir)``, calls one operator of ``riskgraph.llm`` and returns a
frame; it is written as Parquet below the shared folder and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskgraph.llm import decontaminate, packing, pii, quality_rules, simhash
from riskgraph.plans.lineage import cut

STAGES = [
    ("quality rules", quality_rules.stage),
    ("near duplicates", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("personal data", pii.stage),
    ("packing", packing.stage),
]

#: Tokenising and fingerprints cannot be said in SQL; the tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
