"""Level-wise n-grams, entry counts, losses, tolerant decoding, words in place, and training over a stream."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.patterns import UNK
from lexiforge.functions.text import decode_pieces
from lexiforge.operators import levels, lines as W, ngrams as N, segment as S, train as M, vocab as V
from lexiforge.operators.trie import matcher
from lexiforge.streaming import training


def random_lines(rng, n, letters="abé漢", longest=30):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("least", [1, 3, 20])
def test_frequent_ngrams(spark, least):
    rng = random.Random(least)
    segments = Counter(random_lines(rng, 80))
    counts = Counter()
    for text, weight in segments.items():
        for i in range(len(text)):
            for n in range(1, 7):
                if i + n <= len(text):
                    counts[text[i : i + n]] += weight
    want = {t: c for t, c in counts.items() if len(t) == 1 or c >= least}
    table = spark.createDataFrame(list(segments.items()), "seg string, weight long")
    assert {r.token: r.freq for r in levels.frequent_ngrams(table, 6, least).collect()} == want
    assert levels.frequent_ngrams(table.limit(0), 6, least).count() == 0


def test_too_many_ngrams_are_counted_in_one_pass(spark, monkeypatch):
    table = spark.createDataFrame([("abab", 3), ("ba", 1)], "seg string, weight long")
    want = sorted(map(tuple, levels.frequent_ngrams(table, 4, 3).collect()))
    monkeypatch.setattr(levels, "MAX_TOKENS", 1)
    assert sorted(map(tuple, levels.frequent_ngrams(table, 4, 3).collect())) == want


def test_entries_are_counted_as_str_count_does(spark):
    rng = random.Random(4)
    lines = [*random_lines(rng, 60, "ab"), "a" * 501, "abababab" * 40, None, "  a a  "]
    entries = sorted({"a", "aa", "aaa", "aba", "abab", "b a", "ba", "zz", *(t[:4] for t in random_lines(rng, 20, "ab") if t)})
    docs = spark.createDataFrame([(t,) for t in lines], "text string").repartition(3)
    vocab = spark.createDataFrame([(t,) for t in [*entries, ""]], "token string")
    want = {e: sum((t or "").strip().count(e) for t in lines) for e in entries}
    assert {r.token: r.freq for r in N.substring_freq(docs, vocab).collect()} == want
    assert {r.token: r.freq for r in N.substring_freq(docs, vocab, max_length=9).collect()} == want  # by equal n-grams


def plain_losses(theta):
    def paths(text):
        if not text:
            return [(0.0, ())]
        return [(math.log(theta[text[:n]]) + s, (text[:n], *p)) for n in range(1, len(text) + 1) if theta.get(text[:n], 0) > 0 for s, p in paths(text[n:])]

    out = {}
    for token, t in theta.items():
        if token == UNK:
            out[token] = math.inf if t > 0 else 0.0
            continue
        best = sorted(paths(token), key=lambda p: -p[0])[:2]
        if t <= 0 or len(best[0][1]) > 1:
            out[token] = 0.0
        elif len(best) < 2:
            out[token] = math.inf
        else:
            n = len(best[1][1])
            moved = sum(math.log(theta[p] + t) for p in best[1][1]) - n * math.log(1 + t * (n - 1))
            out[token] = t * (math.log(t) - moved)
    return out


def test_losses_and_shrinking_by_them(spark):
    theta = {UNK: 0.05, "a": 0.2, "b": 0.13, "c": 0.01, "ab": 0.2, "abc": 0.15, "bc": 0.004, "ba": 0.1, "aba": 0.15, "cc": 0.006, "d": 0.0}
    vocab = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(theta.items())], "token_id int, token string, theta double")
    names, losses = list(theta), M.token_losses(vocab)
    got = {names[r.token_id]: r.loss for r in losses.collect()}
    want = plain_losses(theta)
    assert {t for t in want if math.isinf(want[t])} == {t for t in got if math.isinf(got[t])}
    assert all(got[t] == pytest.approx(want[t]) for t in want if not math.isinf(want[t]))
    kept = {r.token: r.theta for r in V.shrink_vocab_by_loss(vocab, losses, 8).collect()}
    others = sorted((t for t in theta if len(t) > 1 and t != UNK), key=lambda t: -want[t])[:3]
    assert set(kept) == {UNK, "a", "b", "c", "d", *others} and all(kept[t] == pytest.approx(theta[t]) for t in kept)
    with pytest.raises(ValueError, match="theta or loss"):
        M.train_vocab(vocab, vocab, 3, by="rank")


def test_training_by_loss_reaches_the_size(spark):
    segments = N.to_segments(spark.createDataFrame([("banana bandana ban an na nab " * 3,)], "text string"))
    start = N.init_theta_random(N.index_vocab(N.seed_vocab(levels.frequent_ngrams(segments, 4, 1), 1).select("token")))
    out = M.train_vocab(segments, start, 15, 0.6, 1, "em", keep_char=True, by="loss").collect()
    assert len(out) == 15 and sum(r.theta for r in out) == pytest.approx(1)


def test_malformed_bytes(spark):
    rng = random.Random(2)
    some = [0x41, 0x20, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0xFF, 0xE2, 0x96, 0x81]
    data = [bytes(rng.choice(some) if rng.random() < 0.8 else rng.randrange(256) for _ in range(rng.randint(0, 9))) for _ in range(500)]
    rows = spark.createDataFrame([(bytearray(b), [f"<0x{x:02X}>" for x in b]) for b in data], "b binary, p array<string>")
    for r in rows.select("b", decode_pieces(F.col("p")).alias("s")).collect():
        want = bytes(r.b).decode("utf-8", "replace")
        assert r.s == (want[1:] if want.startswith(" ") else want)
    one = spark.createDataFrame([(["<0xFF>", "b", "▁c", "<0xE6>", "<0xBC>", "<0xA2>", "<0xE6>"],)], "p array<string>")
    assert one.select(decode_pieces(F.col("p"))).first()[0] == "�b c漢�"


def test_words_are_solved_where_they_are(spark):
    v = spark.createDataFrame([(0, UNK, -9.0), (1, "▁", -2.0), (2, "▁ab", -1.0), (3, "a", -3.0)], "token_id int, token string, lp double")
    lines = spark.createDataFrame([(1, "ab a ab"), (2, None), (3, " "), (4, "xa ab")], "line_id long, text string")
    got = S.segment_corpus(lines, v)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.line_id: (r.pieces, r.ids) for r in got.collect()}
    assert rows == {1: (["▁ab", "▁", "a", "▁ab"], [2, 1, 3, 2]), 2: ([], []), 3: ([], []), 4: (["▁", "x", "a", "▁ab"], [1, 0, 3, 2])}
    odd = spark.createDataFrame([(1, ["a", None, "zz", "", "a"]), (2, [None]), (3, []), (4, None)], "line_id long, pieces array<string>")
    assert {r.line_id: r.ids for r in S.pieces_to_ids(odd, v).collect()} == {1: [3, 0, 0, 0, 3], 2: [0]}
    assert [r.ids for r in S.pieces_to_ids(odd, v.where("token_id > 0")).where("line_id = 1").collect()] == [[3, None, None, None, 3]]


def theta_of(df):
    return {r.token: pytest.approx(r.theta) for r in df.collect()}


def test_a_stream_trains_each_batch_once(spark, tmp_path):
    """Stopped after a batch, resumed with a half-written version in the way, the stream ends as the batches in order do."""
    vocab = N.init_theta_random(N.index_vocab(spark.createDataFrame([(t,) for t in ["a", "b", "ab", "ba", "▁", "▁a", UNK]], "token string")))
    texts = [["ab ab a"], ["ba b", "ab"], [" "], ["a a ba"]]
    source, folder, state = (str(tmp_path / x) for x in ("in", "versions", "state"))
    training.start_training(vocab, folder)
    want = training.version(spark, folder, -1)
    for batch, rows in enumerate(texts):
        segments = N.to_segments(spark.createDataFrame([(t,) for t in rows], "text string"))
        if not segments.isEmpty():
            with M.Trainer(segments, want) as held:
                want = M.checkpointed(M.stepped(want, M.token_counts_of(held.best(want)), batch, 0.8))

    def run():
        stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(source)
        query = training.streaming_training(stream, folder, state).start()
        query.processAllAvailable()
        query.stop()

    for batch, rows in enumerate(texts):
        spark.createDataFrame([(t,) for t in rows], "text string").coalesce(1).write.mode("append").parquet(source)
        if batch == 1:
            run()
            kept = theta_of(training.version(spark, folder, 1))
            assert training.version(spark, folder, 2) is None
            (tmp_path / "versions" / "version=2").mkdir()
            (tmp_path / "versions" / "version=2" / "part-0.parquet").write_bytes(b"half")
    training.start_training(vocab.limit(0), folder)  # a start is there: nothing happens
    run()
    assert {r.token: r.theta for r in training.version(spark, folder, 1).collect()} == kept
    assert {r.token: r.theta for r in training.version(spark, folder, 3).collect()} == theta_of(want)
    before = {r.token: r.theta for r in training.version(spark, folder, 3).collect()}
    training.train_on_batch(spark.createDataFrame([("other words",)], "text string"), 3, folder)  # again: left alone
    assert {r.token: r.theta for r in training.version(spark, folder, 3).collect()} == before
    with pytest.raises(RuntimeError, match="missing"):
        training.train_on_batch(spark.createDataFrame([("a",)], "text string"), 9, folder)
    assert W.line_sums(N.to_segments(spark.createDataFrame([("ab",)], "text string")), matcher(M.with_lp(training.version(spark, folder, 3)), score="lp")).count() == 1


def test_rounds_of_training_share_their_segments_and_levels_their_tries(spark, monkeypatch):
    """F1, F2, F16: segments are dealt out once for all rounds, and a level's trie holds that level only."""
    from lexiforge.operators import levels, ngrams, train

    segments = spark.createDataFrame([("▁abab", 9), ("▁abba", 7), ("▁baba", 5)], "seg string, weight long")
    sizes, dealt = [], []
    made, spread = levels.DoubleArray, ngrams.spread
    monkeypatch.setattr(levels, "DoubleArray", lambda tokens: sizes.append({len(t) for t in tokens}) or made(tokens))
    grams = levels.frequent_ngrams(segments, 4, 5)
    want = ngrams.count_ngrams(segments, 4).where("length(token) = 1 or freq >= 5")
    assert sorted(map(str, grams.collect())) == sorted(map(str, want.collect()))
    assert sizes == [{1}, {2}, {3}]
    vocab = train.checkpointed(ngrams.init_theta_random(ngrams.index_vocab(ngrams.seed_vocab(grams, 5).select("token"))))
    monkeypatch.setattr(ngrams, "spread", lambda s: dealt.append(1) or spread(s))
    out = train.train_vocab(segments, vocab, 6, max_epoch=1, keep_char=True)
    assert out.count() == 6 and len(dealt) == 1
