"""Training over prefix trees, against a plain trainer that enumerates paths."""

import random

import pytest

from lexiforge.functions.patterns import UNK
from lexiforge.operators import forest, ngrams as N, train as M
from test_training_by_hand import counted, em, random_start, same, shrunk


def by_hand(segments, longest, least, given, size):
    theta = random_start(sorted({*counted(segments, longest, least), *given}))
    n = len(theta)
    while n > size:
        theta = em(em(theta, segments), segments)
        n = max(size, int(n * 0.8))
        fixed = {t: theta.pop(t) for t in given}
        kept = shrunk(theta, n - len(fixed))
        theta = random_start(sorted(kept | set(fixed)))
    return em(em(theta, segments), segments)


WORDS = {"▁banana": 3, "▁bandana": 2, "▁ban": 4, "▁an": 1, "▁na": 2, "▁a\x00b": 1, "▁nab▁cab": 5, "▁漢字é": 2, "▁bananas<Q>": 1, "▁" + UNK + "a": 1}


@pytest.mark.parametrize(("longest", "least"), [(4, 2), (7, 1)])
def test_as_a_plain_trainer(spark, longest, least):
    """F1 train_language_vocab: seeds, given tokens, shrinking and both steps of each round."""
    table = spark.createDataFrame([*WORDS.items(), ("", 3)], "seg string, weight long").repartition(3)
    given = spark.createDataFrame([("<Q>", True), ("xyz", True), ("", True)], "token string, is_fixed boolean")
    want = by_hand(WORDS, longest, least, ["<Q>", "xyz"], 30)
    got = M.train_from_ngrams(table, given, 30, longest, least)
    same(got, want)
    assert [r.token_id for r in got.orderBy("token").collect()] == list(range(30))
    assert {r.token for r in got.where("is_fixed").collect()} == {"<Q>", "xyz"}


def test_as_the_table_of_a_vocabulary(spark, monkeypatch):
    """Many words, several trees a task, and segments that are too long for a tree."""
    rng = random.Random(3)
    words = {"▁" + "".join(rng.choice("aabcdé") for _ in range(rng.randint(1, 14))): rng.randint(1, 9) for _ in range(400)}
    words |= {"▁" + "".join(rng.choice("abc") for _ in range(n)): 2 for n in (511, 513)}
    table = spark.createDataFrame(list(words.items()), "seg string, weight long").persist()
    given = spark.createDataFrame([("▁zz", False), ("abcdabcd", True)], "token string, is_fixed boolean")
    monkeypatch.setattr(forest, "WORDS", 50)
    got = M.train_from_ngrams(table, given, 120, 4, 20, max_epoch=1)
    monkeypatch.setattr(forest, "MAX_NGRAMS", 10)
    want = M.train_from_ngrams(table, given, 120, 4, 20, max_epoch=1)
    same(got, {r.token: r.theta for r in want.collect()})


def test_frequent_ngrams_are_those_of_one_pass(spark):
    rng = random.Random(5)
    words = {"▁" + "".join(rng.choice("ab漢") for _ in range(rng.randint(1, 9))): rng.randint(1, 4) for _ in range(200)} | {"ab" * 700: 3}
    table = spark.createDataFrame(list(words.items()), "seg string, weight long")
    found = forest.grow(forest.trees(table, 6), 6, 12).tokens().to_pylist()
    assert len(found) == len(set(found))
    assert set(found) == {r.token for r in N.count_ngrams(table, 6).where("length(token) = 1 or freq >= 12").collect()}


def test_more_tokens_than_one_place_adds_up(spark, monkeypatch):
    """F1 train_language_vocab: the vocabulary is no table of Spark while its n-grams fit, so no round collects rows of it."""
    monkeypatch.setattr(forest, "SLICE", 7)
    monkeypatch.setattr(M, "matcher", None)
    docs = spark.createDataFrame([("banana bandana ban an na nab 12 cab " * 3,)], "text string")
    out = M.train_language_vocab(docs, 280, 8, 2, byte_fallback=True)
    assert out.count() == 280 and out.where("is_fixed").count() == 256


def test_words_of_text_with_digits(spark):
    """Every character on its own, and in front of digits: the words are those of ``split_digits`` between Unicode white space."""
    from pyspark.sql import functions as F

    from lexiforge.functions.text import digits_apart, split_digits

    every = "".join(f"a{chr(c)}b1{chr(c)}23 " for c in range(1, 0x3100)) + "x\U0001d7d9 4\u202f٣5"
    docs = spark.createDataFrame([(every,), (None,), ("",), ("12a 3",)], "text string")
    plain = docs.select(F.explode(F.filter(F.split(split_digits(F.coalesce("text", F.lit(""))), r"(?U)\s+"), lambda w: w != "")).alias("w"))
    want = sorted(("▁" + r.w, r["count"]) for r in plain.groupBy("w").count().collect())
    assert sorted(map(tuple, N.to_segments(docs.withColumn("text", digits_apart(F.col("text")))).collect())) == want


def test_a_seeded_vocabulary_takes_every_dictionary_word(spark):
    """F2 recipe_seeded_vocabulary: dictionary words of any length and number are seeds, and n-grams of up to eight characters."""
    from collections import Counter

    from lexiforge.plans import queries as Q, recipes

    entries = sorted({f"{a}{b}{c}" for a in "abcdefghijk" for b in "abcdefghijk" for c in "abcdefghij"})[:1100]
    text = " ".join(entries * 3) + " bandanabanana" * 3 + " xy"
    docs = spark.createDataFrame([(text,)], "text string")
    words = spark.createDataFrame([(t,) for t in [*entries, "bandanabanana", "xy", "none"]], "token string")
    got = {r.token: r.theta for r in recipes.seeded_vocabulary(docs, words, 5000, min_freq=10_000).collect()}
    segments = Counter("▁" + w for w in text.split())
    assert set(got) == {*entries, "bandanabanana", *"".join(segments), UNK}
    same_theta = em(em(random_start(sorted(got)), segments), segments)
    assert all(got[t] == pytest.approx(same_theta[t], abs=1e-12) for t in got)
    assert "left" not in Q.QUERIES["recipe_seeded_vocabulary"].__code__.co_names
