"""Recipes: compositions of the operators into whole vocabulary builds and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import split_sentences, split_symbols
from lexiforge.operators import metrics, ngrams, segment, train, vocab as V


def merged_vocabulary(docs: DataFrame, size: int, languages: list[str], max_length: int = 8, epochs: int = 1) -> DataFrame:
    """Vocabularies per language from symbol-split sentences, prefix-stripped, merged behind the special rows and scored.

    (pos, token, score, piece_type).
    """
    parts = []
    for lang in languages:
        lines = docs.where(F.col("lang") == lang).select(F.explode(split_sentences(F.col("text"), stop="\\n")).alias("text"))
        lines = lines.select(split_symbols(F.col("text")).alias("text"))
        found = train.train_language_vocab(lines, size, max_length=max_length, min_freq=20)
        parts.append(V.strip_prefix_symbols(found.select(F.col("token_id").alias("pos"), "token")))
    special = V.special_rows(docs.sparkSession)
    merged = V.merge_vocabs(special, *parts)
    ordered = ngrams.index_vocab(merged.withColumn("_o", F.struct("file_no", "pos")).drop("pos"), "_o").select(F.col("token_id").alias("pos"), "token")
    scored = train.reestimate_scores(ordered, ngrams.to_segments(docs), epochs=epochs, max_length=max_length)
    return V.assign_piece_types(V.reset_special_scores(scored, special.count()), control=("<s>", "</s>", "<mask>", "<pad>", "<CLS>", "<SEP>", "<EOD>"))


def seeded_vocabulary(docs: DataFrame, dictionary: DataFrame, size: int, max_length: int = 8, min_freq: int = 50, top: int | None = None) -> DataFrame:
    """(token_id, token, theta): n-gram seeds and the dictionary words of the corpus, the commonest ``top`` of them if given,
    trained down to ``size``."""
    segments = train.checkpointed(ngrams.to_segments(docs))
    common = ngrams.top_tokens(ngrams.substring_freq(docs.select("text"), dictionary), top)
    given = train.checkpointed(common.select("token", F.lit(False).alias("is_fixed")))
    return train.train_from_ngrams(segments, given, size, max_length, min_freq)


def evaluation(lines: DataFrame, vocab: DataFrame, key: str = "doc_id", ticks: float | None = None) -> DataFrame:
    """One row: token counts and both perplexities of ``lines(key, text)`` under ``vocab(token_id, token, theta)``; best paths
    with scores in whole ``ticks``, if given."""
    coded = segment.segment_corpus(lines, train.with_lp(vocab, ticks), key).persist()
    unk = vocab.where(F.col("token") == "<unk>").select("token_id").collect()
    ignored = {"unk": unk[0][0]} if unk else {}
    scored = train.with_lp(vocab)
    stats = metrics.encoding_stats(coded, ignored)
    model = metrics.perplexity_model(coded, scored, tuple(ignored.values())).withColumnRenamed("perplexity", "ppl_model")
    new = metrics.perplexity_new_unigram(coded, tuple(ignored.values())).withColumnRenamed("perplexity", "ppl_new")
    return stats.join(F.broadcast(model)).join(F.broadcast(new))  # one row each
