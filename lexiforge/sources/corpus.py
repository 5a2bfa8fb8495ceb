"""Corpora: lines of text, samples of them, and what is written of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions.text import rstrip, strip
from lexiforge.operators.ngrams import uniform_hash

LINES = T.StructType([T.StructField("line_id", T.LongType()), T.StructField("text", T.StringType())])


def numbered(df: DataFrame, name: str = "line_id") -> DataFrame:
    """Rows of a file in order with 0-based numbers; two narrow passes, no shuffle."""
    schema = T.StructType([T.StructField(name, T.LongType()), *df.schema.fields])
    return df.sparkSession.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (x[1], *x[0])), schema)


def read_lines(spark: SparkSession, path: str, mode: str = "rstrip") -> DataFrame:
    """(line_id, text) of a text file; ``mode`` is strip, rstrip or raw."""
    clean = {"strip": strip, "rstrip": rstrip, "raw": lambda c: c}[mode]
    return numbered(spark.read.text(path)).select("line_id", clean(F.col("value")).alias("text"))


def read_jsonl_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_no, text) of JSON documents with a ``text``: their lines, then a blank one for each document."""
    docs = spark.read.schema("text string").json(path)
    return docs.select(F.posexplode(F.split(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "\n", -1)).alias("line_no", "text"))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): the lines of ``docs(doc_id, text)``."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "text"))


def read_line_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").cast("long").alias("line_id")).where("line_id is not null")


def extract_lines(lines: DataFrame, ids: DataFrame, key: str = "line_id") -> DataFrame:
    """The lines whose number is listed, right-stripped; ids are a set, their order and repeats do not matter."""
    kept = lines.join(ids.select(key).distinct(), key, "left_semi")
    return kept.withColumn("text", rstrip(F.col("text")))


def sample_corpus(df: DataFrame, budget_bytes: int, by: str = "source", key: str = "doc_id", text: str = "text", seed: int = 0, buckets: int = 1024) -> DataFrame:
    """A random sample to a byte budget per source: rows in hash order while their running sum fits.

    Hash buckets are added up first, one row per source and bucket, so that only the bucket in which the budget ends
    is ordered row by row; a source with most of all rows needs no big window.
    """
    rows = df.withColumn("_h", uniform_hash(key, seed=seed)).withColumn("_b", F.floor(F.col("_h") * buckets).cast("int")).withColumn("_n", F.octet_length(F.coalesce(text, F.lit(""))).cast("long"))
    totals = rows.groupBy(by, "_b").agg(F.sum("_n").alias("_sum"))
    before = totals.withColumn("_before", F.sum("_sum").over(Window.partitionBy(by).orderBy("_b")) - F.col("_sum"))
    starts = before.select(F.col(by).alias("_by"), F.col("_b").alias("_bb"), "_sum", "_before").where(F.col("_before") < budget_bytes)
    found = rows.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_bb")))
    whole = found.where(F.col("_before") + F.col("_sum") <= budget_bytes)
    part = found.where(F.col("_before") + F.col("_sum") > budget_bytes)
    part = part.withColumn("_run", F.col("_before") + F.sum("_n").over(Window.partitionBy(by, "_b").orderBy("_h", key))).where(F.col("_run") <= budget_bytes)
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def concat_corpora(**corpora: DataFrame) -> DataFrame:
    """The corpora one after the other, with the name of each in ``source``."""
    out = None
    for name, df in corpora.items():
        named = df.withColumn("source", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def read_seeds(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct right-stripped lines as ``token``; empty ones are left out."""
    return spark.read.text(list(paths)).select(rstrip(F.col("value")).alias("token")).where("token <> ''").distinct()


def read_dictionary_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path).select(F.col("_c0").alias("token")).where("token is not null").distinct()


def read_freq(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """(token, freq) of JSON objects: one a line, of any number of tokens, or with ``multiline`` one a file."""
    raw = spark.read.text(path, wholetext=multiline)
    return raw.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("token", "freq"))


def write_freq(freq: DataFrame, path: str) -> None:
    """A JSON object a line, of one token each, so no table is too large for it."""
    freq.select(F.to_json(F.create_map("token", "freq")).alias("value")).write.mode("overwrite").text(path)


def write_segmentation(df: DataFrame, path: str) -> None:
    """Pieces joined by a blank, a line per segmented line, in line order."""
    df.repartitionByRange("line_id").sortWithinPartitions("line_id").select(F.array_join("pieces", " ").alias("value")).write.mode("overwrite").text(path)
