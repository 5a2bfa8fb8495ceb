"""Segments, n-gram counts, seed vocabularies and frequency dictionaries.

Equal segments are collapsed into one row with a weight first. Everything later is linear in lines, so this loses
nothing, and the work then grows with distinct words rather than with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.patterns import HEAD, UNK
from lexiforge.functions.text import SPACE, normalize_for_model, strip


def to_segments(df: DataFrame, text: str = "text", space_split: bool = True) -> DataFrame:
    """(seg, weight): words with a head mark, or whole lines with one for every blank."""
    if space_split:
        split = F.split(F.coalesce(F.col(text), F.lit("")), SPACE)  # empty ones go behind: an array's filter is no generated code
        segs = df.select(F.explode(split).alias("w")).where("w <> ''").select(F.concat(F.lit(HEAD), "w").alias("seg"))
    else:
        segs = df.select(strip(F.col(text)).alias("t")).where("t <> ''").select(normalize_for_model(F.col("t")).alias("seg"))
    return segs.groupBy("seg").agg(F.count("*").alias("weight"))


def spread(segments: DataFrame) -> DataFrame:
    """The segments that are not empty, in ``spark.sql.shuffle.partitions`` partitions.

    A segment becomes dozens of substrings: adaptive execution sees only the small rows before and merges them into one task.
    Both columns are keys, as when edges are packed; by ``seg`` alone the planner would drop this as done already.
    """
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.where("seg <> ''").repartition(parts, "seg", "weight")


def substrings(segments: DataFrame, max_length: int) -> DataFrame:
    """``segments`` with a row for every substring of at most ``max_length``: its end ``e``, length ``l``, ``token``."""
    ends = segments.withColumn("e", F.explode(F.sequence(F.lit(1), F.length("seg"))))
    lengths = ends.withColumn("l", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_length), F.col("e")))))
    return lengths.withColumn("token", F.substring("seg", F.col("e") - F.col("l") + 1, F.col("l")))


def count_ngrams(segments: DataFrame, max_length: int) -> DataFrame:
    """(token, freq): overlapping occurrences of every substring, by weight."""
    return substrings(spread(segments), max_length).groupBy("token").agg(F.sum("weight").alias("freq"))


def seed_vocab(ngrams: DataFrame, min_freq: int, drop: tuple[str, ...] = ("",)) -> DataFrame:
    """(token, freq): single characters and n-grams of at least ``min_freq``, and the unknown token with 0."""
    kept = ngrams.where((F.length("token") == 1) | (F.col("freq") >= min_freq)).where(~F.col("token").isin(*drop, UNK))
    unk = ngrams.sparkSession.range(1).select(F.lit(UNK).alias("token"), F.lit(0).cast("long").alias("freq"))
    return kept.select("token", F.col("freq").cast("long").alias("freq")).union(unk)


def unigram_total(segments: DataFrame) -> DataFrame:
    """One row: the characters of all segments, by weight."""
    return segments.agg(F.coalesce(F.sum(F.length("seg") * F.col("weight")), F.lit(0)).alias("unigram_total"))


def with_initial_seeds(seeds: DataFrame) -> DataFrame:
    """Candidates from a list instead of n-grams."""
    return seeds.select("token").where("token <> ''").distinct()


def with_fixed_seeds(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """(token, is_fixed): the union with tokens that training must keep."""
    fixed = seeds.select("token", F.lit(True).alias("is_fixed")).where("token <> ''")
    return tokens.select("token", F.lit(False).alias("is_fixed")).union(fixed).groupBy("token").agg(F.max("is_fixed").alias("is_fixed"))


def index_vocab(tokens: DataFrame, order: str = "token") -> DataFrame:
    """``tokens`` with ``token_id`` by code-point order: range partitions are sorted and numbered in place."""
    ordered = tokens.repartitionByRange(order).sortWithinPartitions(order)
    kept = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).persist()
    sizes = kept.groupBy("_p").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    starts = sizes.select("_p", before.alias("_start"))
    ids = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return kept.join(F.broadcast(starts), "_p").select(ids.cast("int").alias("token_id"), *tokens.columns)


def effective_max_length(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.max(F.length("token")).alias("max_length"))


def uniform_hash(*columns: str, seed: int = 0) -> F.Column:
    """A number in (0, 1) that depends on the columns and the seed only: 52 bits of an MD5, which any engine can repeat."""
    return unit_interval(F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])


def unit_interval(*parts: F.Column) -> F.Column:
    digits = F.left(F.md5(F.concat_ws(":", *parts)), F.lit(13))
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def normalized(vocab: DataFrame, weight: str | F.Column) -> DataFrame:
    """``vocab`` with theta = weight over the sum of weights."""
    w = vocab.withColumn("theta", F.col(weight).cast("double") if isinstance(weight, str) else weight)
    total = w.agg(F.sum("theta").alias("_total"))
    return w.join(F.broadcast(total)).withColumn("theta", F.col("theta") / F.col("_total")).drop("_total")  # one row


def init_theta_random(vocab: DataFrame, seed: int = 0) -> DataFrame:
    return normalized(vocab, uniform_hash("token", seed=seed))


def add_word(vocab: DataFrame, word: str, theta: float = 0.0) -> DataFrame:
    """Appends a word with the next id; a word that is there already changes nothing."""
    last = vocab.agg((F.coalesce(F.max("token_id"), F.lit(-1)) + 1).cast("int").alias("token_id"), F.max((F.col("token") == word).cast("int")).alias("there"))
    new = last.where("coalesce(there, 0) = 0").select("token_id", F.lit(word).alias("token"), F.lit(theta).alias("theta"))
    return vocab.select("token_id", "token", "theta").union(new)


def theta_from_counts(pieces: DataFrame, vocab: DataFrame | None = None, smoothing: float = 1.0) -> DataFrame:
    """(token, theta) from a table of ``pieces`` (array) with additive smoothing; unknown pieces count as unknown."""
    tokens = pieces.select(F.explode("pieces").alias("token"))
    if vocab is None:
        counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
        vocab = counts.select("token").union(pieces.sparkSession.range(1).select(F.lit(UNK).alias("token"))).distinct()
    known = vocab.select("token").distinct()
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    named = counts.join(known.withColumn("_k", F.lit(True)), "token", "left").select(F.when(F.col("_k"), F.col("token")).otherwise(UNK).alias("token"), "n")
    summed = named.groupBy("token").agg(F.sum("n").alias("n"))
    smoothed = known.join(summed, "token", "left").select("token", (F.coalesce("n", F.lit(0)) + F.lit(smoothing)).alias("n"))
    return normalized(smoothed, "n").select("token", "theta")


def vocab_uniform(tokens: DataFrame) -> DataFrame:
    """(token_id, token, theta) with equal theta; ids by order, or the given ``token_id``, which must be 0..n-1."""
    if "token_id" not in tokens.columns:
        return normalized(index_vocab(tokens.select("token").distinct()), F.lit(1.0))
    n, low, high, distinct = tokens.agg(F.count("*"), F.min("token_id"), F.max("token_id"), F.countDistinct("token_id")).collect()[0]
    if n and (low != 0 or high != n - 1 or distinct != n):
        raise ValueError("token ids must be 0..n-1")
    return normalized(tokens.select("token_id", "token"), F.lit(1.0))


def vocab_from_unigrams(weights: DataFrame, weight: str = "freq") -> DataFrame:
    """(token, theta): given weights, normalised."""
    return normalized(weights, weight).select("token", "theta")


def vocab_from_scores(scored: DataFrame, vocab: DataFrame | None = None, missing: float = -30.0) -> DataFrame:
    """(token, theta) from log scores; a score of 0 and a token without one count as ``missing``."""
    rows = scored.select("token", "score")
    if vocab is not None:
        rows = vocab.select("token").distinct().join(rows, "token", "left")
    score = F.when(F.col("score").isNull() | (F.col("score") == 0), F.lit(missing)).otherwise(F.col("score"))
    return normalized(rows, F.exp(score)).select("token", "theta")


def substring_freq(lines: DataFrame, vocab: DataFrame, text: str = "text", max_length: int | None = None) -> DataFrame:
    """(token, freq): non-overlapping occurrences of each entry in each stripped line, as counting left to right finds.

    Lines are walked through the entries' trie where they are, and each task sends a count for an entry; for entries that
    are too many for that, distinct lines meet them by equal n-grams.
    """
    from lexiforge.operators.lines import entry_counts
    from lexiforge.operators.trie import fits, matcher

    entries = vocab.select("token").where("token <> ''").distinct()
    stripped = lines.select(strip(F.col(text)).alias("seg")).where("seg <> ''")
    if max_length is None and fits(entries):
        numbered = index_vocab(entries).persist()
        counts = entry_counts(stripped, matcher(numbered, use_unk=False))
        return numbered.join(counts, "token_id", "left").select("token", F.coalesce("freq", F.lit(0)).alias("freq"))
    longest = max_length or entries.agg(F.max(F.length("token"))).collect()[0][0] or 1
    distinct = stripped.groupBy("seg").agg(F.count("*").alias("weight"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("seg"))), lambda n: F.transform(F.sequence(F.lit(1), F.length("seg") - n + 1), lambda i: F.substring("seg", i, n)))))
    pairs = distinct.select("seg", "weight", F.explode(grams).alias("token")).join(entries, "token")
    times = (F.length("seg") - F.length(F.replace("seg", F.col("token"), F.lit("")))) / F.length("token")
    counts = pairs.groupBy("token").agg(F.sum(times.cast("long") * F.col("weight")).alias("freq"))
    return entries.join(counts, "token", "left").select("token", F.coalesce("freq", F.lit(0)).alias("freq"))


def merge_freq(*freqs: DataFrame) -> DataFrame:
    out = freqs[0].select("token", "freq")
    for f in freqs[1:]:
        out = out.union(f.select("token", "freq"))
    return out.groupBy("token").agg(F.sum("freq").alias("freq"))


def top_tokens(freq: DataFrame, n: int | None, min_freq: int = 3, tie: str = "token") -> DataFrame:
    """The ``n`` most frequent tokens (all, if None) of at least ``min_freq``; ties by ``tie``."""
    kept = freq.where(F.col("freq") >= min_freq).orderBy(F.desc("freq"), tie)
    return kept if n is None else kept.limit(n)
