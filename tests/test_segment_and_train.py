import itertools
import math

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.patterns import UNK
from lexiforge.operators import lattice as L, ngrams as N, segment as S, train as M

THETA = {"a": 0.3, "b": 0.2, "ab": 0.2, "ba": 0.1, "aba": 0.1, "c": 0.1}
SEGMENTS = [("ababc", 2), ("abc", 1)]


@pytest.fixture(scope="module")
def vocab(spark):
    rows = [(i, t, THETA.get(t, 0.0)) for i, t in enumerate(sorted([*THETA, UNK]))]
    return spark.createDataFrame(rows, "token_id int, token string, theta double").persist()


@pytest.fixture(scope="module")
def arrays(spark, vocab):
    return L.edge_arrays(L.lattice(spark.createDataFrame(SEGMENTS, "seg string, weight long"), vocab)).persist()


@pytest.fixture(scope="module")
def scored(arrays, vocab):
    return L.with_scores(arrays, M.with_lp(vocab)).persist()


def all_paths(seg):
    """Every way to cut a segment into known tokens, with its log-probability."""
    out = []
    for cuts in itertools.product([0, 1], repeat=len(seg) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                parts.append(seg[at : i + 1])
                at = i + 1
        if all(p in THETA for p in parts):
            out.append((sum(math.log(THETA[p]) for p in parts), parts))
    return sorted(out, key=lambda x: -x[0])


def test_shuffled_vocabulary_and_joined_scores_agree_with_broadcast_and_constant_ones(spark, vocab, scored, monkeypatch):
    monkeypatch.setattr(L, "MAX_SCORE_ARRAY", 0)
    monkeypatch.setattr(L, "MAX_BROADCAST_TOKENS", 0)
    segments = spark.createDataFrame(SEGMENTS, "seg string, weight long")
    joined = L.with_scores(L.edge_arrays(L.lattice(segments, vocab)), M.with_lp(vocab))
    assert sorted(joined.collect()) == sorted(scored.collect())


def test_folds_are_no_part_of_later_projections(scored):
    """The forward fold stands once in the optimized plan, whatever reads its result."""
    plan = S.posteriors(S.path_sums(scored))._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "array_max" in line]
    assert len(sums) == 1 and "Generate inline" in sums[0]


def test_best_and_nbest_paths(scored):
    for r in S.best_paths(scored).collect():
        best = all_paths(r.seg)[0]
        assert r.pieces == best[1] and r.score == pytest.approx(best[0])
    for seg, rows in itertools.groupby(S.nbest_paths(scored, 4).orderBy("seg", "rank").collect(), key=lambda r: r.seg):
        rows = list(rows)
        assert [r.score for r in rows] == pytest.approx([p[0] for p in all_paths(seg)[:4]])
        assert all(sum(math.log(THETA[p]) for p in r.pieces) == pytest.approx(r.score) for r in rows)


def test_sums_over_paths(scored):
    for r in S.path_sums(scored).collect():
        weights = [math.exp(p[0]) for p in all_paths(r.seg)]
        assert r.loglik == pytest.approx(math.log(sum(weights)))
        assert r.expected_tokens == pytest.approx(sum(w * len(p[1]) for w, p in zip(weights, all_paths(r.seg))) / sum(weights))
    mass = S.posteriors(S.path_sums(scored)).groupBy("seg").agg(F.sum("post").alias("m")).collect()
    assert [r.m for r in mass] == pytest.approx([1.0, 1.0])
    assert {r.seg: round(r.expected_tokens, 6) for r in S.path_sums(scored).collect()} == {"ababc": 3.397436, "abc": 2.230769}


@pytest.mark.parametrize(
    ("repeats", "want"),
    [
        ("sum", {"a": 0.337411, "b": 0.463197, "ab": 0.998916, "ba": 0.037736, "aba": 0.125786, "c": 1.036955}),
        ("last", {"a": 0.201561, "b": 0.365083, "ab": 0.671872, "ba": 0.037736, "aba": 0.125786, "c": 1.036955}),
    ],
)
def test_expected_counts(arrays, vocab, repeats, want):
    names = {r.token_id: r.token for r in vocab.collect()}
    got = {names[r.token_id]: round(r.mass, 6) for r in M.em_counts(arrays, vocab, repeats).collect()}
    assert got == want


def test_likelihood_never_falls(spark, arrays, vocab):
    v, last = vocab, -math.inf
    for _ in range(4):
        loglik = S.path_sums(L.with_scores(arrays, M.with_lp(v))).agg(F.sum(F.col("loglik") * F.col("weight"))).first()[0]
        assert loglik >= last - 1e-9
        last, v = loglik, M.checkpointed(M.em_step(arrays, v, normalize="none"))
        assert v.agg(F.sum("theta")).first()[0] == pytest.approx(1)


def test_sampling(scored):
    rows = S.sample_paths(scored, 40).collect()
    assert all("".join(r.pieces) == r.seg for r in rows) and len({tuple(r.pieces) for r in rows}) > 2
    assert sorted(map(str, rows)) == sorted(map(str, S.sample_paths(scored.repartition(3), 40).collect()))
    few = S.sample_from_nbest(scored, 2, 3).groupBy("seg").count().collect()
    assert {r.seg: r["count"] for r in few} == {"ababc": 2, "abc": 2}


def test_unknown_characters_and_long_lines(spark):
    v = spark.createDataFrame([(0, UNK, -9.0), (1, "▁", -2.0), (2, "▁ab", -1.0), (3, "a", -3.0)], "token_id int, token string, lp double")
    lines = spark.createDataFrame([(1, "ab a"), (2, "xa"), (3, ""), (4, None)], "line_id long, text string")
    rows = {r.line_id: r for r in S.segment_corpus(lines, v).collect()}
    assert rows[1].pieces == ["▁ab", "▁", "a"] and rows[2].ids == [1, 0, 3] and rows[3].pieces == [] and rows[4].ids == []
    long = {r.line_id: r for r in S.segment_long_lines(lines, v).collect()}
    assert long[1].pieces == ["▁ab", "▁", "a"] and long[2].ids == [1, 0, 3] and long[4].pieces == []
    ids = S.pieces_to_ids(S.segment_corpus(lines, v).where("line_id = 2"), v).first().ids
    assert ids == [1, 0, 3]
    assert S.ids_to_pieces(spark.createDataFrame([(2, [1, 0, 3])], "line_id long, ids array<int>"), v).first().pieces == ["▁", UNK, "a"]


def test_continuation_pieces(spark):
    v = spark.createDataFrame([(0, UNK), (1, "ab"), (2, "##c"), (3, "c")], "token_id int, token string")
    edges = L.continuation_lattice(spark.createDataFrame([("abc", 1)], "seg string, weight long"), v)
    assert {(r.e, r.l, r.token_id) for r in edges.collect()} == {(1, 1, 0), (2, 1, 0), (2, 2, 1), (3, 1, 2)}


@pytest.mark.parametrize("mode", ["em", "viterbi"])
def test_training_to_a_size(spark, mode):
    docs = spark.createDataFrame([("banana bandana ban an na nab " * 3,)], "text string")
    segments = N.to_segments(docs)
    start = N.init_theta_random(N.index_vocab(N.seed_vocab(N.count_ngrams(segments, 4), 1).select("token")))
    out = M.train_vocab(segments, start, 15, 0.6, 1, mode, keep_char=True).collect()
    assert len(out) == 15 and sum(r.theta for r in out) == pytest.approx(1)
    assert sorted(r.token_id for r in out) == list(range(15))


def test_batches_and_steps(spark, vocab):
    segments = spark.createDataFrame(SEGMENTS, "seg string, weight long")
    for out in (M.train_viterbi_batch(segments, vocab, batch=1), M.train_viterbi_stepwise(segments, vocab, 2)):
        assert out.agg(F.sum("theta")).first()[0] == pytest.approx(1)
    scores = M.reestimate_scores(vocab.select(F.col("token_id").alias("pos"), "token"), segments, "em", 1)
    assert scores.count() == len(THETA) + 1 and scores.where("score is null").count() == 0
