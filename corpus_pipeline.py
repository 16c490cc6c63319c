"""A corpus from documents: quality rules, near duplicates out, sources mixed, sequences packed.

Each stage works on all rows that the stage before kept and is written as Parquet before the next one reads it.

Defined cases, for every stage: null, empty and blank texts fail the quality rules; repeated rows are judged alike and
become one in the second stage, the one whose other columns come first as JSON; texts that share an id, or have none, are
documents of their own; an empty table passes through; columns besides those of documents are kept up to the last stage,
which returns places in sequences; columns named like those of a stage's own keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.llm import jaccard, mixing, packing, quality
from inspectra.llm.common import KEPT, clear, keep, table, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the host-level rules keep."""
    return quality.judge(docs.select(F.struct(*docs.columns).alias("own")), "own.text", "own.source").where("kept").select("own.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join, that with the smallest id, null ids last.

    A document is an id with a text: texts that share an id, or have none, are documents of their own, equal ones are one.
    """
    row = unused(docs, "row_key")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    ids = rows.select(F.col(row).alias("row"), "doc_id", "text")
    parts = jaccard.jaccard_components(ids, "row").select(F.col("doc_id").alias("row"), "component_id").distinct()
    named = keep(parts.join(ids.select("row", "doc_id").distinct(), "row"), "pipeline-parts")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    first = named.groupBy("component_id").agg(least.alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    gone = keep(named.join(first, "component_id").where("row <> first").select(F.col("row").alias(row)), "pipeline-gone")
    others = F.to_json(F.struct(*[c for c in docs.columns if c.lower() != "text"]))
    return rows.join(gone, row, "left_anti").groupBy(row).agg(F.min_by(F.struct(*docs.columns), others).alias("kept_row")).select("kept_row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every copy of a document, or part of one, that its source's target takes."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all words of the mix in training sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("source mixing", mixed_sources), ("best-fit packing", packed)]
#: Packing is sequential within a shard, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = len(KEPT)
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear(spark, KEPT[done:-1])  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
