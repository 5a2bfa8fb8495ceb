"""Paths through lattices: best, sampled, n best; and the sums over all paths.

Best paths go by a walk of the vocabulary's trie (lines.py), for words and whole lines alike. Vocabularies that are too
large for it, and the sums of single edges, fold over a segment's sorted edge array in the JVM, a row per *distinct*
segment; that costs length times edges, so it is for words. Samples, n best paths and sums of whole segments take the
edge arrays of a batch together (lines.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.arrays import evaluated, log_sum_exp, minus_infinity
from lexiforge.functions.patterns import UNK
from lexiforge.functions.text import SPACE, normalize_for_model, strip
from lexiforge.operators.lattice import edge_arrays, lattice, with_scores
from lexiforge.operators.lines import best_paths_by_trie, ids_by_trie, nbest_of_edges, samples_of_edges, sums_of_edges, word_segments_by_trie
from lexiforge.operators.ngrams import spread, to_segments, uniform_hash
from lexiforge.operators.trie import fits, matcher

STEP = "array<struct<start:int,l:int,token_id:int>>"


def ends(length: Column) -> Column:
    return F.sequence(F.lit(1), length)


def edges_at(ed: Column, end: Column) -> Column:
    return F.filter(ed, lambda x: x["e"] == end)


# --- best path ---------------------------------------------------------------------------------


def best_steps(ed: Column, length: Column) -> Column:
    """Per position the best score and the last step; of equal scores the shorter last token."""
    start = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("l"), F.lit(-1).alias("token_id")))
    none = F.struct(minus_infinity().alias("s"), F.lit(0).alias("l"), F.lit(-1).alias("token_id"))

    def better(best: Column, x: Column, table: Column) -> Column:
        s = F.get(table, x["e"] - x["l"])["s"] + x["lp"]
        return F.when(s > best["s"], F.struct(s.alias("s"), x["l"].alias("l"), x["token_id"].alias("token_id"))).otherwise(best)

    return F.aggregate(ends(length), start, lambda table, i: F.array_append(table, F.aggregate(edges_at(ed, i), none, lambda b, x: better(b, x, table))))


def trace_back(table: Column, length: Column) -> Column:
    """The steps (start, l, token_id) of the best path, first to last; empty if there is none."""
    state = F.struct(length.alias("at"), F.array().cast(STEP).alias("path"))

    def back(st: Column, _: Column) -> Column:
        step = F.get(table, st["at"])
        taken = F.struct((st["at"] - step["l"]).alias("start"), step["l"].alias("l"), step["token_id"].alias("token_id"))
        return F.when((st["at"] > 0) & (step["l"] > 0), F.struct((st["at"] - step["l"]).alias("at"), F.array_append(st["path"], taken).alias("path"))).otherwise(st)

    return F.aggregate(ends(length), state, back, lambda st: F.when(st["at"] == 0, F.reverse(st["path"])).otherwise(F.array().cast(STEP)))


def pieces_of(path: Column, seg: Column) -> Column:
    return F.transform(path, lambda s: F.substring(seg, s["start"] + 1, s["l"]))


def best_paths(scored: DataFrame) -> DataFrame:
    """(seg, weight, pieces, ids, score) of ``scored(seg, weight, ed)``."""
    n = F.length("seg")
    out = evaluated(evaluated(scored, _table=best_steps(F.col("ed"), n)), _path=trace_back(F.col("_table"), n))
    return out.select("seg", "weight", pieces_of(F.col("_path"), F.col("seg")).alias("pieces"), F.transform("_path", lambda s: s["token_id"]).alias("ids"), F.get("_table", n)["s"].alias("score"))


def segment_segments(segments: DataFrame, vocab: DataFrame, max_length: int | None = None) -> DataFrame:
    """Best paths of ``segments(seg, weight)`` under ``vocab(token_id, token, lp)``."""
    if fits(vocab):
        return best_paths_by_trie(spread(segments), matcher(vocab, max_length, score="lp"))
    return best_paths(with_scores(edge_arrays(lattice(segments, vocab, max_length)), vocab))


def segment_corpus(lines: DataFrame, vocab: DataFrame, key: str = "line_id", text: str = "text", max_length: int | None = None) -> DataFrame:
    """(key, pieces, ids) of every line, word by word: with the vocabulary's trie each task solves the words of its lines;
    with a larger vocabulary distinct words are solved once and joined back."""
    if fits(vocab):
        spaced = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
        return word_segments_by_trie(lines.select(key, spaced.alias("words")), matcher(vocab, max_length, score="lp"), key)
    words = lines.select(key, F.posexplode(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).alias("i", "w")).withColumn("seg", F.concat(F.lit("▁"), "w"))
    solved = segment_segments(to_segments(lines, text), vocab, max_length).select("seg", "pieces", "ids")
    found = words.join(solved, "seg").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "pieces", "ids"))).alias("a"))
    return lines.select(key).join(found, key, "left").select(key, F.coalesce(F.flatten("a.pieces"), F.array().cast("array<string>")).alias("pieces"), F.coalesce(F.flatten("a.ids"), F.array().cast("array<int>")).alias("ids"))


def segment_long_lines(lines: DataFrame, vocab: DataFrame, key: str = "line_id", text: str = "text") -> DataFrame:
    """(key, pieces, ids) of whole lines, blanks as head marks, for any length; null and blank lines have none."""
    stripped = strip(F.col(text))
    segs = lines.select(key, F.when(stripped != "", normalize_for_model(stripped)).alias("seg"))
    return best_paths_by_trie(segs, matcher(vocab, score="lp"), keep=key).select(key, "pieces", "ids")


# --- sums over paths ---------------------------------------------------------------------------


def forward(ed: Column, length: Column) -> Column:
    """alpha by position."""
    step = lambda a, i: F.array_append(a, log_sum_exp(F.transform(edges_at(ed, i), lambda x: x["lp"] + F.get(a, x["e"] - x["l"]))))
    return F.aggregate(ends(length), F.array(F.lit(0.0)), step)


def backward(ed: Column, length: Column) -> Column:
    """beta by distance from the end."""
    leaving = lambda k: F.filter(ed, lambda x: x["e"] - x["l"] == length - k)
    step = lambda b, k: F.array_append(b, log_sum_exp(F.transform(leaving(k), lambda x: x["lp"] + F.get(b, length - x["e"]))))
    return F.aggregate(ends(length), F.array(F.lit(0.0)), step)


def token_counts(ed: Column, alpha: Column, length: Column) -> Column:
    """The expected number of tokens by position; 0 where no path arrives."""
    share = lambda x: F.exp(x["lp"] + F.get(alpha, x["e"] - x["l"]) - F.get(alpha, x["e"]))
    reach = lambda i: F.filter(edges_at(ed, i), lambda x: F.get(alpha, x["e"] - x["l"]) > minus_infinity())
    total = lambda c, i: F.aggregate(reach(i), F.lit(0.0), lambda s, x: s + (1 + F.get(c, x["e"] - x["l"])) * share(x))
    return F.aggregate(ends(length), F.array(F.lit(0.0)), lambda c, i: F.array_append(c, total(c, i)))


def line_sums(scored: DataFrame) -> DataFrame:
    """(seg, weight, loglik, expected_tokens) of ``scored``, for who needs no sums by position."""
    return sums_of_edges(scored)


def path_sums(scored: DataFrame) -> DataFrame:
    """``scored`` with alpha, beta, the log-likelihood and the expected number of tokens."""
    n = F.length("seg")
    both = evaluated(scored, alpha=forward(F.col("ed"), n), beta=backward(F.col("ed"), n))
    return evaluated(both, loglik=F.get("alpha", n), expected_tokens=F.get(token_counts(F.col("ed"), F.col("alpha"), n), n))


def posteriors(sums: DataFrame, normalize: str = "line") -> DataFrame:
    """(seg, weight, e, l, token_id, post): edge posteriors; with ``line`` each segment's sum to one."""
    n = F.length("seg")
    scale = F.log("expected_tokens") if normalize == "line" else F.lit(0.0)
    mass = lambda x: F.exp(F.get("alpha", x["e"] - x["l"]) + x["lp"] + F.get("beta", n - x["e"]) - F.col("loglik") - scale)
    rows = sums.where(F.col("loglik") > minus_infinity())
    parts = rows.select("seg", "weight", F.explode(F.transform("ed", lambda x: F.struct(x["e"].alias("e"), x["l"].alias("l"), x["token_id"].alias("token_id"), mass(x).alias("post")))).alias("x"))
    return parts.select("seg", "weight", "x.*")


# --- sampled and n best ------------------------------------------------------------------------


def sample_paths(scored: DataFrame, n: int, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(seg, weight, draw, pieces, ids): ``n`` paths, each drawn by forward filtering and backward sampling."""
    tempered = scored.withColumn("ed", F.transform("ed", lambda x: F.struct(x["e"].alias("e"), x["l"].alias("l"), x["token_id"].alias("token_id"), (x["lp"] * alpha).alias("lp"))))
    return samples_of_edges(tempered, n, seed)


def nbest_paths(scored: DataFrame, n: int) -> DataFrame:
    """(seg, weight, rank, pieces, score): the ``n`` best paths, exactly; equal scores by their token lengths."""
    return nbest_of_edges(scored, n)


def sample_from_nbest(scored: DataFrame, m: int, n: int, lam: float = 1.0, seed: int = 0) -> DataFrame:
    """``m`` of the ``n`` best paths without replacement, by weight exp(lam * score): the largest Gumbel keys."""
    best = nbest_paths(scored, n)
    if m == n == 1:
        return best
    key = F.col("score") * lam - F.log(-F.log(uniform_hash("seg", "rank", seed=seed)))
    return best.withColumn("_r", F.row_number().over(Window.partitionBy("seg").orderBy(key.desc()))).where(F.col("_r") <= m).drop("_r")


def pieces_to_ids(lines: DataFrame, vocab: DataFrame, key: str = "line_id") -> DataFrame:
    """(key, ids): unknown pieces get the unknown token's id; no piece is shuffled if the vocabulary's trie fits."""
    if fits(vocab):
        return ids_by_trie(lines.where("pieces is not null and size(pieces) > 0"), matcher(vocab), key)
    unk = vocab.where(F.col("token") == UNK).agg(F.max("token_id")).collect()[0][0]
    rows = lines.select(key, F.posexplode("pieces").alias("i", "token")).join(vocab.select("token", "token_id"), "token", "left")
    ids = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("token_id", F.lit(unk)).alias("id")))).alias("a"))
    return ids.select(key, F.col("a.id").alias("ids"))


def ids_to_pieces(lines: DataFrame, vocab: DataFrame, key: str = "line_id") -> DataFrame:
    rows = lines.select(key, F.posexplode("ids").alias("i", "token_id")).join(vocab.select("token", "token_id"), "token_id", "left")
    out = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("token", F.lit(UNK)).alias("t")))).alias("a"))
    return out.select(key, F.col("a.t").alias("pieces"))


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count("*").alias("vocab_size"))
