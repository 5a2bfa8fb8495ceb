"""Online training over a stream of documents: a step of the best-path trainer for every micro-batch.

Each batch reads the vocabulary that the batch before has left and writes its own version, in a folder named by the batch;
a version counts once Spark has committed its write. A batch that runs again after a failure or a restart finds its version
and leaves it, or makes it anew from the same one before, so each batch is applied once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from lexiforge.operators.ngrams import to_segments
from lexiforge.operators.train import Trainer, stepped, token_counts_of


def version(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The vocabulary after batch ``number``, if its write was committed; -1 is the start."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={number}/_SUCCESS")
    done = mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
    return spark.read.parquet(f"{folder}/version={number}") if done else None


def start_training(vocab: DataFrame, folder: str) -> None:
    """Writes ``vocab(token_id, token, theta)`` as the start, unless a training in this folder has one."""
    if version(vocab.sparkSession, folder, -1) is None:
        vocab.write.mode("overwrite").parquet(f"{folder}/version=-1")


def train_on_batch(docs: DataFrame, batch: int, folder: str, decay: float = 0.8, max_length: int | None = None, ticks: float | None = None, text: str = "text") -> None:
    """One step towards the relative counts of a batch's best paths; a batch without words leaves the vocabulary as it is."""
    spark = docs.sparkSession
    if version(spark, folder, batch) is not None:
        return
    old = version(spark, folder, batch - 1)
    if old is None:
        raise RuntimeError(f"version {batch - 1} is missing in {folder}")
    segments = to_segments(docs, text)
    with Trainer(segments, old, max_length) as held:
        new = old if held.rows.isEmpty() else stepped(old, token_counts_of(held.best(old, ticks)), batch, decay)
        new.write.mode("overwrite").parquet(f"{folder}/version={batch}")


def streaming_training(docs: DataFrame, folder: str, checkpoint: str, **options: object) -> DataStreamWriter:
    """The writer of a training over the stream ``docs``; ``folder`` and ``checkpoint`` are shared, and belong together."""
    return docs.writeStream.foreachBatch(lambda df, batch: train_on_batch(df, batch, folder, **options)).option("checkpointLocation", checkpoint)
