"""Vocabulary tables in files: token-score TSV, JSON objects, Parquet models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.sources.corpus import numbered


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(pos, token, score). An empty line whose next line has an empty token is the newline token; others are skipped."""
    lines = numbered(spark.read.text(path), "line_no").select("line_no", F.split("value", "\t").alias("f"), "value")
    order = Window.orderBy("line_no")  # a vocabulary file, not a corpus
    rows = lines.withColumn("before", F.lag("value").over(order))
    token = F.when((F.get("f", F.lit(0)) == "") & (F.col("before") == ""), F.lit("\n")).otherwise(F.get("f", F.lit(0)))
    named = rows.where(F.size("f") > 1).select("line_no", token.alias("token"), F.get("f", F.lit(1)).cast("double").alias("score"))
    return named.where("token <> ''").select((F.row_number().over(order) - 1).cast("int").alias("pos"), "token", "score")


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """(pos, token, score) of a JSON object, in key order of the file."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.posexplode(F.map_entries(F.from_json("value", "map<string,double>"))).alias("pos", "e")
    return raw.select(entries).select("pos", F.col("e.key").alias("token"), F.col("e.value").alias("score"))


def write_vocab_json(vocab: DataFrame, path: str, score: str = "freq") -> None:
    """One JSON object, which is one row: for vocabularies, not for the counts of a corpus."""
    pairs = F.map_from_entries(F.collect_list(F.struct("token", score)))
    vocab.agg(F.to_json(pairs).alias("value")).write.mode("overwrite").text(path)


def vocab_lines(vocab: DataFrame, log: str = "ln") -> DataFrame:
    """(pos, value): the lines ``token<TAB>score`` of ``vocab(pos, token, theta)``; zero probabilities are left out."""
    score = {"ln": F.log, "log2": F.log2}[log](F.col("theta"))
    return vocab.where("theta > 0").select("pos", F.format_string("%s\t%f", "token", score).alias("value"))


def write_vocab(vocab: DataFrame, path: str, log: str = "ln") -> None:
    lines = vocab_lines(vocab, log)
    lines.repartitionByRange(1, "pos").sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)


def save_model(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
