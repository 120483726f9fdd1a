"""A training-corpus pipeline over documents: filter, deduplicate twice, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilattice.functions.cluster import ship_package
from perilattice.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from perilattice.llm.common import materialize
from perilattice.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half; the model learns as in op3."""
    ship_package(spark)
    model = toxicity_model(spark, sf_dir, docs.select("doc_id", "text"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingle links of similarity 0.75 or more connect, the document with the smallest doc_id.

    Documents without words stay, and so do those of a group in which none has an id.
    """
    ship_package(spark)
    uid = ngram_join.UID
    found = ngram_join.jaccard_components(docs)
    grouped = found.where("n_shingles > 0 and component_id is not null")
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")).alias("f"))
    kept = first.select(F.col("f.uid").alias(uid)).union(found.where("n_shingles = 0 or component_id is null").select(F.col("uid").alias(uid)))
    return docs.withColumn(uid, F.monotonically_increasing_id()).join(kept, uid, "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources by weights 5, 2, 1 takes it."""
    return mixing.emit_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids."""
    ship_package(spark)
    return packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL can't express the toxicity model or the tokenizer; tests/llm/test_pipeline.py holds the stages against plain Python, mixing by its bounds only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
