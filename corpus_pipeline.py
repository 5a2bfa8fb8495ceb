"""Quality rules, toxicity, near duplicates, source mix and packing over ``documents``, as five Spark stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the documents are a Parquet table in
the shared folder, so a lost executor or a failed stage costs that stage alone.

Defined cases: further columns of the input are not read; null and blank texts fail the quality rules; rows with a null
doc_id are documents as others; repeated rows are near duplicates of one another; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import mixing, ngram_join, packing, quality, toxicity
from lexiforge.llm.common import cut_lineage, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
GRAM, PERCENT = 5, 80  # of the near-duplicate stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, trained on the labels that are not held out, does not predict toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join (words by five, similarity 0.8), that with the smallest id.

    Documents without words stay. Texts are joined with their keys only; repeated rows of a kept key go through a
    group-by of their own.
    """
    found = ngram_join.jaccard_components(docs, GRAM, PERCENT, count_links=False).where("n_shingles > 0")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    times = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("_times"))
    best = times.groupBy("component").agg(F.min_by(F.struct("doc_id", "text_hash", "_times"), key).alias("k"))
    best = cut_lineage(best.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_h"), F.col("k._times").alias("_times")))
    docs = docs.select(*COLUMNS)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    once = docs.join(best.where("_times = 1"), same, "left_semi")
    often = docs.join(best.where("_times > 1"), same).dropDuplicates(["_id", "_h"]).select(*COLUMNS)
    blank = docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return once.union(often).union(blank)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once per copy, dealt to shards and shuffled inside them."""
    sized = docs.select(*COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    return mixing.mix(sized, mixing.draw_quotas(mixing.sized(docs))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix in sequences of at most 2048 tokens."""
    return packing.op10_packing(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The toxicity machine has no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
