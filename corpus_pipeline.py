"""From raw documents to packed training sequences: five stages, each written and read again by the next.

1. quality rules: documents that a rule rejects go;
2. line dedup: repeated lines go, and documents of which nothing but blank lines is left;
3. near-dedup: one document of each group of similar ones stays, that with the smallest id;
4. benchmark decontamination: documents with a twentieth or more of their words in benchmark windows go;
5. packing: what is left becomes pieces of training sequences.

All stages but the last return the columns of ``documents``; n_chars follows the text. Tokenizing has no SQL, so
the pipeline has none; tests hold every stage against a plain version of it.

Defined results: null, empty and blank texts have fewer than ten words and go with the first stage, so later ones see
texts alone. Rows are documents of their own whether or not their id repeats or is null; of rows that are near copies
one stays, whatever their ids are. Very long texts pass whole. Ties are settled by id, then by a hash of the text. An
empty table gives an empty result, an empty benchmark takes nothing out. Further columns pass through all stages but the
last, which returns pieces, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import storage
from docloom.llm import decontaminate, lines, neardup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.apply(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.apply(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.apply(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        with storage.scope() as kept:
            kept.append(docs := storage.table(stage(spark, before, sf_dir), "pipeline"))
        storage.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
