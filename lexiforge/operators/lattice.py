"""Lattices: which tokens of a vocabulary can cover which part of a segment.

``lattice`` makes a row per edge by an equi-join; ``edge_arrays`` packs a segment's edges into one sorted array, on
which paths and probabilities are folds (segment.py). Edges name tokens by id, so a lattice outlives a change of the
probabilities; ``with_scores`` puts the current ones in without another shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.patterns import UNK
from lexiforge.operators.ngrams import spread, substrings

#: Up to this many tokens their scores travel as one constant array; beyond it they are joined by id.
MAX_SCORE_ARRAY = 500_000

#: Up to this many tokens (some 50 MB) the vocabulary is broadcast; beyond it the substrings are shuffled by token.
MAX_BROADCAST_TOKENS = 1_000_000


def lattice(segments: DataFrame, vocab: DataFrame, max_length: int | None = None, use_unk: bool = True) -> DataFrame:
    """(seg, weight, e, l, token_id): tokens of ``vocab(token_id, token)`` that end at ``e`` and have length ``l``.

    A single character that is no token is the unknown token, or no edge if ``use_unk`` is off.
    """
    entries, longest, unk = looked_up(vocab, max_length)
    sub = substrings(spread(segments), longest)
    if not use_unk:
        return sub.join(entries, "token").select("seg", "weight", "e", "l", "token_id")
    return with_unk(sub.join(entries, "token", "left"), unk)


def looked_up(vocab: DataFrame, max_length: int | None) -> tuple[DataFrame, int, int | None]:
    """The entries to join by token, the longest token's length and the unknown token's id.

    Vocabularies of a checked size are broadcast: then the lattice keeps the partitions of the segments, and packing
    its edges by segment needs no shuffle.
    """
    size, longest, unk = vocab.agg(F.count("*"), F.max(F.length("token")), F.max(F.when(F.col("token") == UNK, F.col("token_id")))).collect()[0]
    entries = vocab.select("token", "token_id")
    return (F.broadcast(entries) if size <= MAX_BROADCAST_TOKENS else entries), max_length or longest or 1, unk


def with_unk(found: DataFrame, unk: int | None) -> DataFrame:
    """Edges of a left join: a single character without a token gets the unknown one, longer strings go."""
    kept = found.where(F.col("token_id").isNotNull() | (F.col("l") == 1))
    return kept.select("seg", "weight", "e", "l", F.coalesce("token_id", F.lit(unk)).alias("token_id")).where("token_id is not null")


def continuation_lattice(segments: DataFrame, vocab: DataFrame, prefix: str = "##", max_length: int | None = None) -> DataFrame:
    """A lattice of words whose later pieces are looked up with a prefix; edges as in :func:`lattice`."""
    entries, longest, unk = looked_up(vocab, max_length)
    sub = substrings(spread(segments), longest)
    name = F.when(F.col("e") > F.col("l"), F.concat(F.lit(prefix), F.col("token"))).otherwise(F.col("token"))
    return with_unk(sub.withColumn("token", name).join(entries, "token", "left"), unk)


def candidate_ids(segments: DataFrame, vocab: DataFrame, max_length: int | None = None) -> DataFrame:
    """Every token in a segment, with repeats and without unknown ones."""
    return lattice(segments, vocab, max_length, use_unk=False)


def edge_arrays(edges: DataFrame) -> DataFrame:
    """(seg, weight, ed): a segment's edges as an array of (e, l, token_id), by end and length."""
    return edges.groupBy("seg", "weight").agg(F.sort_array(F.collect_list(F.struct("e", "l", "token_id"))).alias("ed"))


def score_array(vocab: DataFrame, score: str, size: int) -> Column:
    """The scores of tokens 0 to ``size - 1`` as one constant array; null where there is none.

    It is part of the plan, so each executor gets it once, with the stage, and rows do not carry it.
    """
    found = {r[0]: r[1] for r in vocab.select("token_id", F.col(score).cast("double")).collect()}  # at most MAX_SCORE_ARRAY
    return F.from_json(F.lit(json.dumps([found[i] for i in range(size)])), "array<double>")


def with_scores(arrays: DataFrame, vocab: DataFrame, score: str = "lp") -> DataFrame:
    """``arrays`` with ``lp`` in each edge, from ``vocab(token_id, <score>)``; edges of tokens without one go.

    Dense ids are looked up in one constant array; sparse or very many ids are joined.
    """
    size, low, high, distinct = vocab.agg(F.count("*"), F.min("token_id"), F.max("token_id"), F.countDistinct("token_id")).collect()[0]
    if size and low == 0 and high == size - 1 == distinct - 1 and size <= MAX_SCORE_ARRAY:
        scores = score_array(vocab, score, size)
        lookup = lambda x: F.struct(x["e"].alias("e"), x["l"].alias("l"), x["token_id"].alias("token_id"), F.get(scores, x["token_id"]).alias("lp"))
        return arrays.withColumn("ed", F.filter(F.transform("ed", lookup), lambda x: x["lp"].isNotNull()))
    rows = arrays.select("seg", "weight", F.explode("ed").alias("x")).select("seg", "weight", "x.*")
    joined = rows.join(vocab.select("token_id", F.col(score).alias("lp")).where("lp is not null"), "token_id")
    return joined.groupBy("seg", "weight").agg(F.sort_array(F.collect_list(F.struct("e", "l", "token_id", "lp"))).alias("ed"))
