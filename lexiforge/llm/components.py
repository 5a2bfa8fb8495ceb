"""Connected components of an edge table: tasks join up the edges that they hold, alternating star steps do the rest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import cut_lineage

TASK_EDGES = 100_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it reaches) of every node but the smallest ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label, (a, b) = np.arange(len(nodes)), at.reshape(2, -1)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def join_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow job: the stars of the edges of a partition. It holds its nodes and ``TASK_EDGES`` edges at a time."""
    u, v, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def close() -> None:
        u[:], v[:] = ([x] for x in stars(np.concatenate(u), np.concatenate(v)))

    for batch in batches:
        u.append(batch.column(0).to_numpy(zero_copy_only=False))
        v.append(batch.column(1).to_numpy(zero_copy_only=False))
        size += batch.num_rows
        if size > max(TASK_EDGES, len(u[0])):
            close()
            size = 0
    close()
    for at in range(0, len(u[0]), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(x[0][at : at + 65_536]) for x in (u, v)], names=["u", "v"])


def joined(edges: DataFrame) -> DataFrame:
    return cut_lineage(edges.mapInArrow(join_up, "u long, v long"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``: component is the smallest node that it reaches.

    The edges of a task become stars, then those of as many tasks as there are ``TASK_EDGES`` edges. While that is more
    than one task, a round hooks neighbours to the smallest one around them, first the larger neighbours of every node,
    then the smaller ones; paths shorten about by half. A hub's edges are a skewed join side, which Spark splits.
    """
    e = joined(edges.where("u <> v").select("u", "v"))
    before = None
    for _ in range(max_rounds):
        n = e.count()
        if n > TASK_EDGES:
            e = joined(e.coalesce(-(-n // TASK_EDGES)))
            n = e.count()
        if n <= TASK_EDGES:
            e = joined(e.coalesce(1))
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        e = cut_lineage(pairs.select("u", F.col("m").alias("v")).union(pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
