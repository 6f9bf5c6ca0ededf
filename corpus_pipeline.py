"""Corpus preparation in stages, each one operator of galewatch.llm over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it. Stages handle what
their operators define: nulls, empty and long texts, repeated rows, empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewatch.llm import line_dedup, mixing, ngram_join, packing, quality
from galewatch.llm.common import stored

#: The columns of documents; all stages but the last return them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs.select(*COLUMNS))


def boilerplate_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go. A document that has no other lines stays whole: that
    many equal texts are copies, which the next stage sees to."""
    cut = line_dedup.drop_lines(docs.select(*COLUMNS), "source", "text", ratio=0.1, keep_whole=True)
    changed = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles stays."""
    return ngram_join.keep_first(docs.select(*COLUMNS)).select(*COLUMNS)


def source_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.repeated(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in batches."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", boilerplate_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("packing", packed),
]
#: Suffix arrays, the similarity join and the dynamic programme have no SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
