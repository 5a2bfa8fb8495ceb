"""Running segment and n-gram counts over a stream of documents (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.operators.ngrams import count_ngrams, to_segments


def read_document_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streaming_segments(docs: DataFrame) -> DataFrame:
    """(seg, weight), growing with the stream; write it with output mode ``complete`` or ``update``."""
    return to_segments(docs)


def streaming_ngrams(docs: DataFrame, max_length: int) -> DataFrame:
    """(token, freq) over the stream: words are exploded one by one, so that one stateful aggregate is enough."""
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+")).alias("w")).where("w <> ''")
    return count_ngrams(words.select(F.concat(F.lit("▁"), "w").alias("seg"), F.lit(1).alias("weight")), max_length)
