"""Mixing sources to target weights by exact block quotas.

1. Sizes (words) per source; targets by water filling: weights 5, 2, 1 in source order share all words, a source
   stops at three times its own size, and the excess is shared again by weight.
2. A document's place in its source is a seeded hash. A source's target is some whole passes over all its documents
   and a last pass in hash order that takes each document that still fits. It is a list of runs: a run ends at the
   first document that does not fit, which is found by counting words in ever finer hash bins (nothing is sorted, so
   a source with a third of all rows is as easy as any); the next run goes on above it with the documents that are
   no larger than what is missing, until none is left. Every run starts with less missing than a document's size.
3. Each pass of a source is ``blocks_for(shards)`` hash blocks, drawn in a permuted order without replacement. A splitting
   tree deals them to output shards: every node splits its sources' quotas between its halves by a multivariate
   hypergeometric draw, so shard quotas are exact; each shard walks its own path from the root in a Spark task.
4. Inside a shard rows are shuffled by hash. ``op5_mixing`` deals the mix in this way and reports, for every
   document, the shard and the turn of each of its copies.

What reaches the driver is a few numbers per source. Documents meet per-source tables in equi-joins; these tables are
broadcast up to ``MAX_BROADCAST_SOURCES`` sources and shuffled beyond.

Defined cases: a null source is a source of its own, last in order; null or blank texts have size 0 and are taken
once per whole pass; rows with the same id, source and size are taken together; an empty table gives no rows; of the
input of ``op5_mixing`` only doc_id, source and text are read; ``mix`` replaces columns named copy, shard or turn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import WORD, cut_lineage

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
N_BLOCKS = 256
BLOCKS_A_SHARD = 8
SHARD_WORDS = 50_000_000
MIN_SHARDS = 16
SEED = 17
BIN_BITS = (10, 10, 10, 10, 12)
HASH_BITS = 52
MAX_BROADCAST_SOURCES = 10_000


def small(table: DataFrame, sources: int) -> DataFrame:
    """A table of a row per source, to be broadcast if there are few."""
    return F.broadcast(table) if sources <= MAX_BROADCAST_SOURCES else table


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def place(seed: int = SEED) -> Column:
    """A document's hash in [0, 2^52), by id and size."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), 64 - HASH_BITS)


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` (a row per source) with position, weight and target.

    Sources stop at their limit in the order of limit over weight; the first k stop where the share that the
    others would then get by weight is still above theirs. Windows run over a row per source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS))
    t = sizes.withColumns({"position": F.row_number().over(order) - 1, "weight": weight})
    t = t.withColumns({"_all": F.sum("source_size").over(everything).cast("double"), "_w": F.sum("weight").over(everything), "_limit": F.lit(MAX_PASSES) * F.col("source_size")})
    up_to = Window.orderBy(F.col("_limit") / F.col("weight"), "position").rowsBetween(Window.unboundedPreceding, -1)
    spent, gone = F.coalesce(F.sum("_limit").over(up_to), F.lit(0)), F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))
    t = t.withColumn("_level", F.greatest(F.lit(0.0), (F.col("_all") - spent) / (F.col("_w") - gone)))
    t = t.withColumn("_stops", F.col("_limit") <= F.col("_level") * F.col("weight"))
    t = t.withColumn("_share", F.max(F.when(~F.col("_stops"), F.col("_level"))).over(everything))
    return t.withColumn("target", F.when(F.col("_stops"), F.col("_limit").cast("double")).otherwise(F.col("_share") * F.col("weight"))).select("source", "source_size", "position", "weight", "target")


@dataclass
class Quota:
    """What is taken of a source: whole passes, then ``runs`` (low, high, most) of a last pass.

    A run takes the documents with low <= hash < high whose size is at most ``most``. Rows that share id, source and
    size are taken together, so their sizes count together; ``repeated`` says whether the source has such rows.
    """

    source: str | None
    source_size: int
    target: float
    passes: int
    runs: list[tuple[int, int, int]]
    missing: int = 0
    last_size: int = 0
    repeated: bool = False


def draw_quotas(docs: DataFrame, seed: int = SEED) -> list[Quota]:
    """The quotas of ``docs(doc_id, source, size)``."""
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    quotas = []
    for r in targets(per_source).orderBy("position").collect():  # a row per source
        passes = min(MAX_PASSES, int(r["target"] // r["source_size"])) if r["source_size"] else 1
        missing = round(r["target"]) - passes * r["source_size"]
        quotas.append(Quota(r["source"], r["source_size"], r["target"], passes, [], max(0, missing) if passes < MAX_PASSES else 0))
    open_ = {i: 0 for i, q in enumerate(quotas) if q.missing > 0}  # the hash at which the next run starts
    if not open_:
        return quotas
    spark = docs.sparkSession
    units = cut_lineage(docs.where("size > 0").select("source", place(seed).alias("_u"), "size").groupBy("source", "_u").agg(F.sum("size").alias("_n"), F.count("*").alias("_rows")))
    repeated = {r["source"]: r["_r"] for r in units.groupBy("source").agg((F.max("_rows") > 1).alias("_r")).collect()}
    for q in quotas:
        q.repeated = repeated.get(q.source, False)
    while open_:
        width, low, short = HASH_BITS, dict(open_), {i: quotas[i].missing for i in open_}
        for bits in BIN_BITS:
            width -= bits
            if not low:
                break
            state = spark.createDataFrame([(quotas[i].source, v, quotas[i].missing, short[i]) for i, v in low.items()], "_s string, _low long, _most long, _m long")
            inside = (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_low") + (1 << (width + bits))) & (F.col("_n") <= F.col("_most"))
            found = units.join(small(state, len(low)), F.col("source").eqNullSafe(F.col("_s"))).where(inside)
            bins = found.groupBy("source", "_m", F.shiftright(F.col("_u") - F.col("_low"), width).alias("_bin")).agg(F.sum("_n").alias("_n"), F.min("_u").alias("_first"), F.max("_u").alias("_end"))
            ends = bins.withColumn("_sum", F.sum("_n").over(Window.partitionBy("source").orderBy("_bin")))  # at most 2^bits rows a source
            stop = F.min(F.when(F.col("_sum") > F.col("_m"), F.struct("_bin", (F.col("_sum") - F.col("_n")).alias("_before"), "_first", "_end"))).alias("_stop")
            stops = {r["source"]: r for r in ends.groupBy("source").agg(F.max("_sum").alias("_all"), stop).collect()}
            for i in list(low):
                q, r = quotas[i], stops.get(quotas[i].source)
                if r is None or r["_stop"] is None:  # all that is left fits, or nothing is left; the first step says so
                    if r is not None:
                        q.runs.append((open_[i], 1 << HASH_BITS, q.missing))
                        q.missing, q.last_size = q.missing - r["_all"], q.last_size + r["_all"]
                    del low[i], open_[i]
                    continue
                _, before, first, end = r["_stop"]
                short[i] -= before
                if first < end:
                    low[i] += r["_stop"]["_bin"] << width
                    continue
                q.runs.append((open_[i], first, q.missing))  # the document at ``first`` does not fit
                q.last_size += q.missing - short[i]
                q.missing = short[i]
                del low[i]
                if q.missing:
                    open_[i] = first + 1
                else:
                    del open_[i]
    return quotas


def with_copies(docs: DataFrame, quotas: list[Quota], seed: int = SEED) -> DataFrame:
    """``docs(doc_id, source, size, ...)`` with source_size, target and copies; scan, small join and project."""
    rows = [(q.source, q.source_size, q.target, q.passes, q.runs) for q in quotas]
    table = docs.sparkSession.createDataFrame(rows, "_s string, source_size long, target double, _passes int, _runs array<struct<low:bigint,high:bigint,most:bigint>>")
    u, unit = place(seed), F.col("size")
    if any(q.repeated and q.runs for q in quotas):
        many = docs.groupBy(F.col("source").alias("_rs"), u.alias("_ru")).agg(F.sum("size").alias("_unit"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
        docs = docs.join(many, F.col("source").eqNullSafe(F.col("_rs")) & (u == F.col("_ru")), "left").drop("_rs", "_ru")
        unit = F.coalesce("_unit", "size")
    joined = docs.join(small(table, len(quotas)), F.col("source").eqNullSafe(F.col("_s")))
    more = (F.col("size") > 0) & F.exists("_runs", lambda r: (u >= r["low"]) & (u < r["high"]) & (unit <= r["most"]))
    return joined.withColumn("copies", F.col("_passes") + more.cast("int")).drop("_s", "_passes", "_runs", "_unit")


# --- shards ------------------------------------------------------------------------------------


def split_path(counts: list[int], shards: int, shard: int, seed: int) -> list[tuple[int, int]]:
    """(first block, blocks) of each source for one shard: a walk down the splitting tree.

    A node holds a run of shards and its sources' quotas. Its left half takes its share of blocks, drawn from the
    sources by a multivariate hypergeometric distribution that is seeded by the node, so all walks agree.
    """
    low, high = 0, shards
    quota, start = np.array(counts, dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        size = int(quota.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left, rest, open_ = np.zeros_like(quota), size, int(quota.sum())
        for i, n in enumerate(quota.tolist()):
            open_ -= n
            left[i] = rng.hypergeometric(n, open_, rest) if n and rest and open_ else min(n, rest)
            rest -= int(left[i])
        if shard < middle:
            quota, high = left, middle
        else:
            start, quota, low = start + left, quota - left, middle
    return list(zip(start.tolist(), quota.tolist(), strict=True))


def permuted(block: int, n: int, seed: int) -> int:
    """A block's turn among n: a seeded affine permutation."""
    step = seed % n
    while np.gcd(step, n) != 1:
        step += 1
    return (block * step + seed // 7) % n


def blocks_for(shards: int) -> int:
    """Blocks of a pass: a power of two, and several for each shard, however many these are."""
    return max(N_BLOCKS, 1 << (BLOCKS_A_SHARD * shards - 1).bit_length())


def mix(docs: DataFrame, quotas: list[Quota], seed: int = SEED, n_blocks: int | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix of ``docs(doc_id, source, size, ...)``: a row per taken copy, with copy, shard and turn.

    Rows come out range-partitioned by shard, and in each in the order of ``turn``, a hash.
    """
    spark = docs.sparkSession
    shards = max(MIN_SHARDS, -(-int(sum(q.target for q in quotas)) // shard_words))
    n_blocks = n_blocks or blocks_for(shards)
    if n_blocks & (n_blocks - 1):
        raise ValueError("n_blocks is a power of two")
    width = HASH_BITS - (n_blocks.bit_length() - 1)
    last = [-(-n_blocks * q.last_size // q.source_size) if q.last_size else 0 for q in quotas]  # blocks of the last pass, by its share of the source
    counts = [q.passes * n_blocks + n for q, n in zip(quotas, last, strict=True)]

    def walk(batches: Iterator) -> Iterator:
        import pandas as pd

        for ids in batches:
            for shard in ids["id"].tolist():
                rows = []
                for i, (start, n) in enumerate(split_path(counts, shards, shard, seed)):
                    rows += [(i, turn, shard) for turn in range(start, start + n)]
                yield pd.DataFrame(rows, columns=["_source", "_turn", "shard"])

    dealt = spark.range(shards).mapInPandas(walk, "_source int, _turn int, shard long")
    # Which (pass, block) of a source has which turn: passes come one after the other, blocks permuted in each.
    passes = [(i, p, n_blocks, zlib.crc32(f"{seed}:{i}:{p}".encode())) for i, q in enumerate(quotas) for p in range(q.passes)]
    passes += [(i, q.passes, n, zlib.crc32(f"{seed}:{i}:{q.passes}".encode())) for i, (q, n) in enumerate(zip(quotas, last, strict=True)) if n]

    def turns(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            rows = [(i, p, b, p * n_blocks + permuted(b, n, s)) for i, p, n, s in frame.itertuples(index=False) for b in range(n)]
            yield pd.DataFrame(rows, columns=["_source", "copy", "_block", "_turn"])

    turned = spark.createDataFrame(passes, "_source int, copy int, n int, seed long").mapInPandas(turns, "_source int, copy int, _block int, _turn int")
    table = turned.join(dealt, ["_source", "_turn"]).drop("_turn")
    order = spark.createDataFrame([(q.source, i, q.passes, max(1, n)) for i, (q, n) in enumerate(zip(quotas, last, strict=True))], "_s string, _source int, _passes int, _last int")
    block, again = F.shiftright(place(seed), width), F.pmod(F.xxhash64(place(seed)), F.col("_last"))  # runs have gaps, so the last pass is dealt anew
    docs = docs.drop("copy", "shard", "turn")
    taken = with_copies(docs, quotas, seed).where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    taken = taken.join(small(order, len(quotas)), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_block", F.when(F.col("copy") == F.col("_passes"), again).otherwise(block).cast("int")).drop("_s", "_passes", "_last")
    out = taken.join(table, ["_source", "copy", "_block"]).drop("_source", "_block")
    return out.withColumn("turn", F.xxhash64(F.lit(seed), "shard", "copy", "doc_id")).repartitionByRange("shard", "turn").sortWithinPartitions("shard", "turn")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of documents, written once: all later passes read these few bytes a row."""
    return cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))


def op5_mixing(docs: DataFrame) -> DataFrame:
    """Every document with the copies that the mix deals of it: their number, and the shard and turn of each in order."""
    light = sized(docs)
    quotas = draw_quotas(light)
    key = ["doc_id", "source", "size"]
    # Repeated rows are dealt alike, so their copies are the same set.
    dealt = mix(light, quotas).groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("copy", "shard", "turn"))).alias("_dealt"))
    dealt = dealt.select(*[F.col(c).alias(f"_{c}") for c in key], "_dealt")
    per_source = light.sparkSession.createDataFrame([(q.source, q.source_size, q.target) for q in quotas], "_s string, source_size long, target double")
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = light.join(dealt, same, "left").join(small(per_source, len(quotas)), F.col("source").eqNullSafe(F.col("_s")))
    got = F.coalesce("_dealt", F.array().cast("array<struct<copy:int,shard:bigint,turn:bigint>>"))
    copies = F.size(got)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", got["shard"].alias("shard"), got["turn"].alias("turn"))
