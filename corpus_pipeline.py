"""A corpus pipeline: each stage reads what the one before it kept.

Toxicity filter, near-duplicate removal, benchmark decontamination, pseudonyms for personal
data, packing. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saleslode.llm import stages

STAGES = [
    ("toxicity", stages.civil),
    ("gram_jaccard", stages.deduplicated),
    ("benchmark_decontamination", stages.decontaminated),
    ("pseudonyms", stages.pseudonymised),
    ("packing", stages.packed),
]

# Token ids, keyed permutations and a fitted classifier are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir, STAGES)
