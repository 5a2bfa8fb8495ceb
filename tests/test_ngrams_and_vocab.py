from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.patterns import UNK
from lexiforge.operators import ngrams as N, vocab as V

TEXTS = ["ab ab abc", " b  abca ", "", None]


@pytest.fixture(scope="module")
def segments(spark):
    return N.to_segments(spark.createDataFrame([(t,) for t in TEXTS], "text string")).persist()


def test_segments_and_counts(spark, segments):
    words = [f"▁{w}" for t in TEXTS for w in (t or "").split()]
    assert {r.seg: r.weight for r in segments.collect()} == Counter(words)
    want = Counter(w[i : i + n] for w in words for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert {r.token: r.freq for r in N.count_ngrams(segments, 3).collect()} == want
    assert N.unigram_total(segments).first()[0] == sum(map(len, words))
    seeds = {r.token for r in N.seed_vocab(N.count_ngrams(segments, 3), 3).collect()}
    assert seeds == {t for t, c in want.items() if len(t) == 1 or c >= 3} | {UNK}


def test_index_is_code_point_order_with_any_partitions(spark):
    tokens = ["b", "a", "é", "😀", "漢", "▁", "zz", "Z"]
    for parts in (1, 5):
        df = spark.createDataFrame([(t,) for t in tokens], "token string").repartition(parts)
        assert [r.token for r in N.index_vocab(df).orderBy("token_id").collect()] == sorted(tokens)


def test_substring_freq_counts_like_str_count(spark):
    lines, vocab = ["aaaa ab", "banana", " aa "], ["aa", "a", "ana", "zz", "ab"]
    got = N.substring_freq(spark.createDataFrame([(x,) for x in lines], "text string"), spark.createDataFrame([(v,) for v in vocab], "token string"))
    assert {r.token: r.freq for r in got.collect()} == {v: sum(x.strip().count(v) for x in lines) for v in vocab}


def test_thetas(spark):
    scored = spark.createDataFrame([("a", -1.0), ("b", 0.0)], "token string, score double")
    got = {r.token: r.theta for r in N.vocab_from_scores(scored, spark.createDataFrame([("a",), ("b",), ("c",)], "token string")).collect()}
    assert got["a"] == pytest.approx(1, abs=1e-9) and got["b"] == got["c"]
    random_theta = N.init_theta_random(scored.select("token"), 3)
    assert random_theta.agg(F.sum("theta")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        N.vocab_uniform(spark.createDataFrame([(1, "a"), (2, "b")], "token_id int, token string"))
    assert [r.token for r in N.top_tokens(spark.createDataFrame([("a", 5), ("b", 2), ("c", 5), ("d", 9)], "token string, freq long"), 2).collect()] == ["d", "a"]
    assert N.top_tokens(spark.createDataFrame([("a", 5)], "token string, freq long"), 0).count() == 0


def table(spark, tokens, score=1.0):
    return spark.createDataFrame([(i, t, score) for i, t in enumerate(tokens)], "pos int, token string, score double")


def test_prefixes_and_merging(spark):
    v = table(spark, ["▁abc", "abc", "▁!", "▁▁", "▁", "<0x0A>"])
    bare = [(r.pos, r.token) for r in V.strip_prefix(v).orderBy("pos").collect()]
    assert bare == [(0, "abc"), (2, "!"), (3, ""), (4, "▁"), (5, "<0x0A>")]
    symbols = [(r.pos, r.token) for r in V.strip_prefix_symbols(v).orderBy("pos").collect()]
    assert symbols == [(0, "▁abc"), (1, "abc"), (2, "!"), (3, ""), (4, "▁"), (5, "<0x0A>")]
    merged = V.merge_vocabs(table(spark, ["b", "a"]), table(spark, ["a", "c", ""])).orderBy("file_no", "pos")
    assert [r.token for r in merged.collect()] == ["b", "a", "c"]


def test_types_and_pieces(spark):
    v = table(spark, ["<unk>", "<s>", "<0x41>", "x"], -3.0)
    kinds = V.assign_piece_types(v, ("<s>", "<0x41>"))
    assert [r.piece_type for r in kinds.orderBy("pos").collect()] == [V.UNKNOWN, V.CONTROL, V.BYTE, V.NORMAL]
    added = V.append_piece(kinds, "new", V.USER_DEFINED).orderBy("pos").collect()
    assert (added[-1].pos, added[-1].token, added[-1].score) == (4, "new", -3.0)
    with pytest.raises(ValueError):
        V.append_piece(V.assign_piece_types(table(spark, ["a", "b"])), "new", 4)
    assert [r.token for r in V.rename_special(kinds, "x").orderBy("pos").collect()] == ["<unk|x>", "<s|x>", "<0x41>", "x"]
    special = V.special_rows(spark).orderBy("pos").collect()
    assert len(special) == 289 and special[8].token == "▁" * 24 and special[31].token == "▁" and special[32].token == "\n" and special[-1].token == "<0xFF>"


def thetas(spark):
    rows = [(0, UNK, 0.01), (1, "a", 0.001), (2, "ab", 0.3), (3, "abc", 0.2), (4, "bc", 0.2), (5, "ca", 0.1)]
    return spark.createDataFrame(rows, "token_id int, token string, theta double")


def test_pruning_and_shrinking(spark):
    v = thetas(spark)
    pruned = {r.token: r.theta for r in V.prune_vocab(v, 0.15).collect()}
    assert pruned == {UNK: 0.15, "a": 0.15, "ab": 0.3, "abc": 0.2, "bc": 0.2, "ca": 0.0}
    with pytest.raises(ValueError):
        V.prune_vocab(v)
    assert V.shrink_vocab(v, 4, keep_char=True).count() == 4
    assert V.shrink_vocab(v, 4, hard_limit=False, keep_char=True).count() == 5
    with pytest.raises(ValueError):
        V.shrink_vocab(v, 1, keep_char=True)
    assert [tuple(r)[:2] for r in V.reindex(V.prune_vocab(v, 0.15)).orderBy("token_id").collect()] == [(0, UNK), (1, "a"), (2, "ab"), (3, "abc"), (4, "bc")]
    one = sorted(r.token for r in V.shrink_vocab(v.repartition(1), 4, keep_char=True).collect())
    assert one == sorted(r.token for r in V.shrink_vocab(v.repartition(6), 4, keep_char=True).collect())


def test_character_ids(spark):
    v = spark.createDataFrame([(0, "a"), (1, "b"), (2, "abz")], "token_id int, token string")
    assert {r.token_id: r.char_ids for r in V.token_char_ids(v, 4).collect()} == {0: [0, -1, -1, -1], 1: [1, -1, -1, -1], 2: [0, 1, -1, -1]}
