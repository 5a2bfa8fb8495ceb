"""Evaluation of vocabularies and segmentations: aggregates and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import SPACE


def tokens_of(lines: DataFrame, ids: str = "ids") -> DataFrame:
    return lines.select(F.explode(ids).alias("token_id"))


def encoding_stats(lines: DataFrame, ignored: dict[str, int]) -> DataFrame:
    """One row: tokens, tokens without the ignored ids, the count of each ignored kind, distinct ids (all of them)."""
    t = tokens_of(lines)
    kinds = [F.count_if(F.col("token_id") == i).alias(f"n_{k}") for k, i in ignored.items()]
    kept = F.count_if(~F.col("token_id").isin(*ignored.values())) if ignored else F.count("*")
    return t.agg(F.count("*").alias("n_tokens"), kept.alias("n_kept"), *kinds, F.countDistinct("token_id").alias("n_types"))


def perplexity_model(lines: DataFrame, vocab: DataFrame, ignored: tuple[int, ...] = ()) -> DataFrame:
    """exp of minus the mean score ``lp`` of the tokens. Counted per token first, so the join sees types."""
    t = tokens_of(lines).where(~F.col("token_id").isin(*ignored)) if ignored else tokens_of(lines)
    counts = t.groupBy("token_id").agg(F.count("*").alias("n")).join(vocab.select("token_id", "lp"), "token_id")
    return counts.agg(F.exp(-F.sum(F.col("n") * F.col("lp")) / F.sum("n")).alias("perplexity"))


def perplexity_new_unigram(lines: DataFrame, ignored: tuple[int, ...] = ()) -> DataFrame:
    """exp of the entropy of the observed distribution: exp(ln N - sum(n ln n) / N), in one pass over types."""
    t = tokens_of(lines).where(~F.col("token_id").isin(*ignored)) if ignored else tokens_of(lines)
    counts = t.groupBy("token_id").agg(F.count("*").alias("n"))
    return counts.agg(F.exp(F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")).alias("perplexity"))


def loglik_per_token(paths: DataFrame) -> DataFrame:
    """Log-likelihood per token of best paths ``(weight, ids, score)``."""
    return paths.agg((F.sum(F.col("score") * F.col("weight")) / F.sum(F.size("ids") * F.col("weight"))).alias("loglik_per_token"))


def chars_per_token(lines: DataFrame, by: str = "lang", chars: str = "n_chars", tokens: str = "n_tokens") -> DataFrame:
    """Characters over tokens by group; higher is better."""
    return lines.groupBy(by).agg(F.sum(chars).alias("n_chars"), F.sum(tokens).alias("n_tokens"), (F.sum(chars) / F.sum(tokens)).alias("chars_per_token"))


def bi_string(text: Column) -> Column:
    """A tag per non-blank character: B begins a word, I is inside one."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.lit("B"), F.repeat(F.lit("I"), F.length(w) - 1))), "")


def bi_tags(lines: DataFrame, key: str = "line_id", text: str = "text") -> DataFrame:
    """(key, char_pos, tag)."""
    tags = F.filter(F.split(bi_string(F.col(text)), ""), lambda c: c != "")
    return lines.select(key, F.posexplode(tags).alias("char_pos", "tag"))


def tag_counts(gold: DataFrame, pred: DataFrame, key: str = "line_id") -> DataFrame:
    """(gold, pred, n), over lines that have the same characters on both sides."""
    size = lambda df, name: df.select(key, bi_string(F.col("text")).alias(name))
    both = size(gold, "g").join(size(pred, "p"), key).where(F.length("g") == F.length("p"))
    pairs = F.explode(F.zip_with(F.split("g", ""), F.split("p", ""), lambda a, b: F.struct(a.alias("gold"), b.alias("pred"))))
    return both.where(F.length("g") > 0).select(pairs.alias("x")).where("x.gold <> ''").groupBy("x.gold", "x.pred").agg(F.count("*").alias("n"))


def unequal_lines(gold: DataFrame, pred: DataFrame, key: str = "line_id") -> DataFrame:
    """Lines that cannot be compared: missing on one side, or with other characters."""
    one = lambda df, name: df.select(key, F.length(bi_string(F.col("text"))).alias(name))
    return one(gold, "g").join(one(pred, "p"), key, "full_outer").where(~F.col("g").eqNullSafe(F.col("p"))).select(key)


def segmentation_report(counts: DataFrame, digits: int = 3) -> DataFrame:
    """(label, precision, recall, f1, support) of B and I, then accuracy, macro and weighted means."""
    cell = lambda g, p: F.coalesce(F.sum(F.when((F.col("gold") == g) & (F.col("pred") == p), F.col("n"))), F.lit(0)).cast("double")
    c = counts.agg(*[cell(g, p).alias(g + p) for g in "BI" for p in "BI"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    for t, o in ("BI", "IB"):
        c = c.withColumns({f"{t}_p": ratio(F.col(t + t), F.col(t + t) + F.col(o + t)), f"{t}_r": ratio(F.col(t + t), F.col(t + t) + F.col(t + o)), f"{t}_n": F.col(t + t) + F.col(t + o)})
        c = c.withColumn(f"{t}_f", ratio(2 * F.col(f"{t}_p") * F.col(f"{t}_r"), F.col(f"{t}_p") + F.col(f"{t}_r")))
    n = F.col("B_n") + F.col("I_n")
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("label"), F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1"), s.cast("long").alias("support"))
    right = ratio(F.col("BB") + F.col("II"), n)
    macro = [(F.col(f"B_{k}") + F.col(f"I_{k}")) / 2 for k in "prf"]
    weighted = [ratio(F.col(f"B_{k}") * F.col("B_n") + F.col(f"I_{k}") * F.col("I_n"), n) for k in "prf"]
    rows = [row(t, *[F.col(f"{t}_{k}") for k in "prf"], F.col(f"{t}_n")) for t in "BI"]
    rows += [row("accuracy", right, right, right, n), row("macro avg", *macro, n), row("weighted avg", *weighted, n)]
    return c.select(F.inline(F.array(*rows)))


def compare_segmentations(a: DataFrame, b: DataFrame, texts: DataFrame | None = None, key: str = "line_id") -> DataFrame:
    """(key, same_pieces, same_ids[, round_trip]): two segmentations, line by line; a missing line differs."""
    from lexiforge.functions.text import decode_pieces

    left = a.select(key, F.col("pieces").alias("p1"), F.col("ids").alias("i1"))
    right = b.select(key, F.col("pieces").alias("p2"), F.col("ids").alias("i2"))
    both = left.join(right, key, "full_outer")
    same = lambda x, y: F.col(x).isNotNull() & F.col(x).eqNullSafe(F.col(y))
    out = both.select(key, same("p1", "p2").alias("same_pieces"), same("i1", "i2").alias("same_ids"), "p1")
    if texts is not None:
        out = out.join(texts.select(key, F.col("text").alias("_t")), key, "left").withColumn("round_trip", F.coalesce(decode_pieces(F.col("p1")) == F.col("_t"), F.lit(False))).drop("_t")
    return out.drop("p1")
