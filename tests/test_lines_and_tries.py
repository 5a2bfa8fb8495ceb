"""The trie, paths and path sums over it, and the searches for n best paths, against enumerations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.functions.patterns import UNK
from lexiforge.operators import lattice as L, lines as W, nbest as B, ngrams as N, segment as S, train as M
from lexiforge.operators.trie import DoubleArray, code_points, matcher


def random_tokens(rng, letters, n, longest):
    return list({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)})


def test_trie_finds_every_occurrence():
    rng = random.Random(1)
    for _ in range(200):
        letters = "abcé漢😀"[: rng.randint(1, 6)]
        tokens = random_tokens(rng, letters, rng.randint(0, 60), 6)
        rng.shuffle(tokens)
        text = "".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 80)))
        trie = DoubleArray(tokens)
        got = sorted(zip(*(x.tolist() for x in trie.walk(trie.encode(code_points(text)))), strict=True))
        assert got == sorted((i, len(w), k) for i in range(len(text)) for k, w in enumerate(tokens) if text.startswith(w, i))


@pytest.fixture(scope="module")
def vocab(spark):
    rng = random.Random(7)
    tokens = sorted({*random_tokens(rng, "abc", 14, 4), "a", "b", UNK})
    rows = [(i, t, rng.uniform(0.01, 1.0)) for i, t in enumerate(tokens)]
    total = sum(r[2] for r in rows)
    return spark.createDataFrame([(i, t, x / total) for i, t, x in rows], "token_id int, token string, theta double").persist()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcé") for _ in range(rng.randint(1, 12))), rng.randint(1, 4)) for _ in range(60)]
    return spark.createDataFrame(sorted(dict(rows).items()), "seg string, weight long").persist()


def test_walk_makes_the_lattice_of_the_join(vocab, texts):
    tries = matcher(vocab, 3)
    want = L.edge_arrays(L.lattice(texts, vocab, 3))
    assert sorted(map(str, W.lattice_arrays(texts, tries).collect())) == sorted(map(str, want.collect()))
    want = L.edge_arrays(L.lattice(texts, vocab, use_unk=False))
    got = W.lattice_arrays(texts, matcher(vocab, use_unk=False)).where(F.size("ed") > 0)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_paths_equal_the_folds(vocab, texts):
    scored = M.with_lp(vocab, 3.0)  # coarse, so many paths tie
    folds = L.with_scores(L.edge_arrays(L.lattice(texts, scored)), scored)
    tries = matcher(scored, score="lp")
    want = sorted(map(str, S.best_paths(folds).collect()))
    assert sorted(map(str, W.best_paths_by_trie(texts, tries).collect())) == want
    for n in (1, 3, 9):
        assert sorted(map(str, B.nbest_astar(texts, tries, n).collect())) == sorted(map(str, S.nbest_paths(folds, n).collect()))


def test_point_search(vocab, texts):
    tries = matcher(M.with_lp(vocab), score="lp")
    exact = {(r.seg, tuple(r.pieces)): r.score for r in B.nbest_astar(texts, tries, 400).collect()}
    found = B.nbest_point(texts, tries, 5).collect()
    assert all(exact[r.seg, tuple(r.pieces)] == pytest.approx(r.score) for r in found)
    assert len({(r.seg, tuple(r.pieces)) for r in found}) == len(found)
    first = {r.seg: r.pieces for r in B.nbest_astar(texts, tries, 1).collect()}
    assert {r.seg: r.pieces for r in found if r.rank == 1} == first
    share = B.found_share(B.nbest_point(texts, tries, 5), B.nbest_astar(texts, tries, 5)).first()
    assert 0 < share.n_found <= share.n_exact


def test_point_search_moves_one_boundary_at_a_time():
    """The second path of ``far`` is two moves from the first, and what lies between is no path, so it is missed."""
    near = [[], [], [(2, -1.0)], [(1, -5.0), (3, -4.0)], [(2, -1.0), (1, -5.0)]]
    assert B.point_search(near, 9) == B.astar(near, 9) == [(-2.0, (2, 2)), (-9.0, (3, 1)), (-11.0, (2, 1, 1))]
    far = [[], [(1, -3.0)], [(2, -1.0)], [(2, -3.0)], [(2, -1.0), (1, -3.0)]]
    assert B.astar(far, 9) == [(-2.0, (2, 2)), (-9.0, (1, 2, 1))]
    assert B.point_search(far, 9) == [(-2.0, (2, 2))]


def test_searches_on_long_lines_end(spark, vocab):
    rng = random.Random(5)
    text = "".join(rng.choice("abc") for _ in range(10_000))
    lines = spark.createDataFrame([(text, 1), ("ab" * 6000, 1)], "seg string, weight long")
    tries = matcher(M.with_lp(vocab), score="lp")
    for rows in (B.nbest_astar(lines, tries, 4).collect(), B.nbest_point(lines, tries, 4).collect()):
        assert len(rows) == 8 and all("".join(r.pieces) == r.seg for r in rows)


@pytest.mark.parametrize("chunk", [1, 2, 5, 512])
def test_chunks_give_the_sums_of_whole_lines(vocab, texts, chunk):
    """However short the chunks: sums, expected tokens and masses are those of the folds over whole segments."""
    scored = M.with_lp(vocab)
    tries, folds = matcher(scored, score="lp"), L.edge_arrays(L.lattice(texts, vocab))
    sums = {r.k: (r.loglik, r.expected_tokens) for r in S.path_sums(L.with_scores(folds, scored)).select(F.sha2("seg", 256).alias("k"), "loglik", "expected_tokens").collect()}
    got = {r.seg_sha256: (r.loglik, r.expected_tokens) for r in W.line_sums(texts, tries, chunk=chunk).collect()}
    assert set(got) == set(sums) and all(got[k] == pytest.approx(sums[k]) for k in sums)
    for normalize in ("line", "none"):
        want = {r.token_id: r.mass for r in M.em_counts(folds, vocab, normalize=normalize).collect()}
        masses = {r.token_id: r.mass for r in W.em_counts_by_trie(texts, tries, normalize=normalize, chunk=chunk).collect()}
        assert all(masses.get(i, 0.0) == pytest.approx(want.get(i, 0.0), abs=1e-12) for i in {*want, *masses})


def plain_sums(text, scores, unk, longest):
    """Log-likelihood and expected tokens, a position after the other."""
    alpha, count = [0.0], [0.0]
    for e in range(1, len(text) + 1):
        ways = []
        for n in range(1, min(longest, e) + 1):
            s = scores.get(text[e - n : e], unk if n == 1 else None)
            if s is not None:
                ways.append((alpha[e - n] + s, count[e - n] + 1))
        top = max(w[0] for w in ways)
        alpha.append(top + math.log(sum(math.exp(w - top) for w, _ in ways)))
        count.append(sum(math.exp(w - alpha[-1]) * c for w, c in ways))
    return alpha[-1], count[-1]


def test_a_line_of_many_chunks(spark, vocab):
    rng = random.Random(11)
    text = "".join(rng.choice("abcé") for _ in range(20_000))
    scored = M.with_lp(vocab)
    rows = scored.collect()
    scores = {r.token: r.lp for r in rows if r.token != UNK}
    row = W.line_sums(spark.createDataFrame([(text, 1)], "seg string, weight long"), matcher(scored, score="lp")).first()
    unk = next(r.lp for r in rows if r.token == UNK)
    assert (row.loglik, row.expected_tokens) == pytest.approx(plain_sums(text, scores, unk, max(map(len, scores))))
    masses = W.em_counts_by_trie(spark.createDataFrame([(text, 3)], "seg string, weight long"), matcher(scored, score="lp"))
    assert masses.agg(F.sum("mass")).first()[0] == pytest.approx(3.0)


def test_lines_without_a_path_and_without_text(spark):
    v = spark.createDataFrame([(0, "ab", -1.0), (1, "b", None)], "token_id int, token string, lp double")
    lines = spark.createDataFrame([("abab", 1), ("aba", 2), ("", 3), (None, 4)], "seg string, weight long")
    tries = matcher(v, score="lp")
    got = {r.weight: r for r in W.best_paths_by_trie(lines, tries).collect()}
    assert got[1].pieces == ["ab", "ab"] and got[2].pieces == got[3].pieces == got[4].pieces == [] and got[2].score == -math.inf
    assert [(r.token_id, r.mass) for r in W.em_counts_by_trie(lines.where("seg <> ''"), tries, chunk=1).where("mass > 0").collect()] == [(0, pytest.approx(1.0))]
    assert W.line_sums(lines.limit(0), tries).count() == 0


def test_training_on_lines(spark, vocab):
    docs = spark.createDataFrame([("abc abb cab " * 400,), ("ba",), (None,)], "text string")
    lines = N.to_segments(docs, space_split=False)
    start = vocab.unionByName(spark.createDataFrame([(99, "▁", 0.1)], "token_id int, token string, theta double"))
    tries, last, v = matcher(start), -math.inf, start
    for _ in range(3):
        total = W.line_sums(lines, matcher(M.with_lp(v), score="lp")).agg(F.sum("loglik")).first()[0]
        assert total >= last - 1e-6
        last, v = total, M.train_em(lines, v, 1, normalize="none")
    assert v.agg(F.sum("theta")).first()[0] == pytest.approx(1)
    assert isinstance(tries.value.ids, np.ndarray)


def test_moves_with_completed_rests_miss_no_path(spark):
    """on ``far`` of the test above, and on random lattices with whole scores."""
    far = [[], [(1, -3.0)], [(2, -1.0)], [(2, -3.0)], [(2, -1.0), (1, -3.0)]]
    assert B.boundary_search(far, 9) == B.astar(far, 9)
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 7)
        edges = [[(k, float(-rng.randint(1, 4))) for k in range(1, min(e, 4) + 1) if rng.random() < 0.7] for e in range(n + 1)]
        for wanted in (1, 3, 50):
            assert B.boundary_search(edges, wanted) == B.astar(edges, wanted)


def test_lines_are_solved_by_words(spark):
    """F8-F10, F12: where no token reaches across a head mark, lines give what whole lines give without that knowledge."""
    words = ["▁ab", "▁a", "▁", "a", "b", "ab", "ba", "<unk>"]
    vocab = spark.createDataFrame([(i, t, float(-100 - 7 * i)) for i, t in enumerate(words)], "token_id int, token string, lp double")
    rows = [("▁ab▁abba▁▁a", 2), ("▁ab▁cab", 1), ("x▁ba", 3), ("▁" + "ab" * 40 + "▁b", 1), ("▁", 1)]
    lines = spark.createDataFrame(rows, "seg string, weight long")
    tries = matcher(vocab, score="lp")
    assert tries.value.heads
    whole = matcher(vocab, score="lp")
    whole.value.heads = False
    plain = spark.sparkContext.broadcast(whole.value)
    everything = lambda df: sorted(map(str, df.collect()))
    close = lambda df: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in sorted(df.collect())]
    by_words = [everything(W.best_paths_by_trie(lines, tries)), everything(B.nbest_astar(lines, tries, 3)), close(W.line_sums(lines, tries)), close(W.em_counts_by_trie(lines, tries))]
    assert by_words == [everything(W.best_paths_by_trie(lines, plain)), everything(B.nbest_astar(lines, plain, 3)), close(W.line_sums(lines, plain)), close(W.em_counts_by_trie(lines, plain))]
    assert close(W.line_sums(lines, tries, chunk=8)) == by_words[2] and close(W.em_counts_by_trie(lines, tries, chunk=8)) == by_words[3]
