"""Frequent n-grams level by level: an n-gram can be frequent only if the two that are one shorter are.

The frequent n-grams of the level before are a trie, which the tasks hold. A level walks it at all places, takes up the places where the two shorter n-grams are frequent, and counts there; each task sends a row for a candidate, so
n-grams that cannot be frequent are neither made nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import chars
from lexiforge.operators.lines import groups
from lexiforge.operators.ngrams import count_ngrams, spread
from lexiforge.operators.trie import MAX_TOKENS, DoubleArray, code_points

COUNTS = "token string, freq long"


def candidates(rows: DataFrame, known: Broadcast, n: int) -> DataFrame:
    """(token, freq) of the n-grams of ``rows(seg, weight)`` whose two shorter ones are in ``known``, the trie of those."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: DoubleArray = known.value
        for batch in batches:
            texts, weights = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=np.float64)
            for own in groups(texts, 1):
                points = [code_points(texts[i]) for i in own]
                sizes = np.array(list(map(len, points)), dtype=np.int64)
                starts = np.cumsum(sizes + 1) - sizes - 1
                row = np.repeat(np.arange(len(own)), sizes + 1)
                codes = np.zeros(len(row), dtype=np.int32)  # 0 behind each text
                inside = np.ones(len(row), dtype=bool)
                inside[starts + sizes] = False
                codes[inside] = trie.encode(np.concatenate(points))
                at, state = trie.descend(codes, n - 1)
                both = np.flatnonzero(np.r_[at[1:] == at[:-1] + 1, False]) if len(at) else at
                key = state[both] * (len(trie.alphabet) + 1) + codes[at[both] + n - 1]
                _, first, which = np.unique(key, return_index=True, return_inverse=True)
                freq = np.bincount(which, weights=weights[own][row[at[both]]], minlength=len(first)).astype(np.int64)
                where = at[both][first]
                tokens = [texts[own[r]][i : i + n] for r, i in zip(row[where].tolist(), (where - starts[row[where]]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(freq)], names=["token", "freq"])

    return rows.mapInArrow(run, COUNTS).groupBy("token").agg(F.sum("freq").alias("freq"))


def frequent_ngrams(segments: DataFrame, max_length: int, min_freq: int) -> DataFrame:
    """(token, freq): all single characters of ``segments(seg, weight)``, and the longer n-grams of at least ``min_freq``.

    With more frequent n-grams than a trie may have, they are counted in one pass instead.
    """
    spark = segments.sparkSession
    rows = spread(segments).select("seg", F.col("weight").cast("long")).persist()
    try:
        single = rows.select(F.explode(chars(F.col("seg"))).alias("token"), "weight").groupBy("token").agg(F.sum("weight").alias("freq"))
        found = level = single.limit(MAX_TOKENS + 1).collect()
        known = [r.token for r in found if r.freq >= min_freq]
        for n in range(2, max_length + 1):
            if not level or len(found) > MAX_TOKENS:
                break
            counts = candidates(rows, spark.sparkContext.broadcast(DoubleArray(known)), n)
            level = counts.where(F.col("freq") >= min_freq).limit(MAX_TOKENS + 1).collect()
            found = found + level
            known = [r.token for r in level]
    finally:
        rows.unpersist()
    if len(found) > MAX_TOKENS:
        return count_ngrams(segments, max_length).where((F.length("token") == 1) | (F.col("freq") >= min_freq))
    return spark.createDataFrame(pa.table({"token": pa.array([r.token for r in found], pa.string()), "freq": pa.array([r.freq for r in found], pa.int64())}))
