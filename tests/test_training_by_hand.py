"""Trainings of several steps against a plain trainer that enumerates paths."""

import hashlib
import math

import pytest

from lexiforge.functions.patterns import UNK
from lexiforge.operators import ngrams as N, train as M

WORDS = ["banana", "bandana", "ban", "an", "na", "nab", "cab", "xa"]
SEGMENTS = {f"▁{w}": 1 + i % 3 for i, w in enumerate(WORDS)}


def unit(text, seed=0):
    return (int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def random_start(tokens, seed=0):
    total = sum(unit(t, seed) for t in tokens)
    return {t: unit(t, seed) / total for t in tokens}


def paths(seg, theta):
    """(log score, pieces as tokens) of every path; single characters that are no token are unknown."""
    if not seg:
        return [(0.0, ())]
    out = []
    for n in range(1, len(seg) + 1):
        token = seg[:n] if seg[:n] in theta else UNK if n == 1 else None
        if token is not None and theta.get(token, 0) > 0:
            out += [(math.log(theta[token]) + s, (token, *p)) for s, p in paths(seg[n:], theta)]
    return out


def best(seg, theta):
    """Of equal scores the shorter last tokens; scores are sums from the front, as a recurrence has them."""
    table = [(0.0, ())]
    for e in range(1, len(seg) + 1):
        ways = []
        for n in range(1, e + 1):
            token = seg[e - n : e] if seg[e - n : e] in theta else UNK if n == 1 else None
            if token is not None and theta.get(token, 0) > 0 and table[e - n] is not None:
                ways.append((table[e - n][0] + math.log(theta[token]), -n, (*table[e - n][1], token)))
        table.append(max(ways)[::2] if ways else None)
    return table[-1][1] if table[-1] else ()


def normalised(counts):
    total = sum(counts.values())
    return {t: c / total for t, c in counts.items()}


def em(theta, segments, prune=None):
    mass = dict.fromkeys(theta, 0.0)
    for seg, weight in segments.items():
        found = paths(seg, theta)
        if found:
            total = sum(math.exp(s) for s, _ in found)
            tokens = sum(math.exp(s) / total * len(p) for s, p in found)
            for s, p in found:
                for t in p:
                    mass[t] += weight * math.exp(s) / total / tokens
    return pruned(normalised({t: m + 1e-30 for t, m in mass.items()}), prune)


def viterbi(theta, segments, prune=None):
    counts = dict.fromkeys(theta, 0)
    for seg, weight in segments.items():
        for t in best(seg, theta):
            counts[t] += weight
    return pruned(normalised(counts), prune)


def pruned(theta, low):
    if low is None:
        return theta
    return {t: low if t == UNK else max(p, low) if len(t) == 1 else 0.0 if p < low else p for t, p in theta.items()}


def shrunk(theta, size):
    exempt = {t for t in theta if t == UNK or len(t) == 1}
    others = sorted((t for t in theta if t not in exempt), key=lambda t: (-(theta[t] + 1e-30), unit(t), t))
    return exempt | set(others[: size - len(exempt)])


def counted(segments, longest, least):
    grams = {}
    for seg, weight in segments.items():
        for i in range(len(seg)):
            for n in range(1, min(longest, len(seg) - i) + 1):
                grams[seg[i : i + n]] = grams.get(seg[i : i + n], 0) + weight
    return sorted({t for t, c in grams.items() if len(t) == 1 or c >= least} | {UNK})


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(list(SEGMENTS.items()), "seg string, weight long").persist()


@pytest.fixture(scope="module")
def start(spark):
    tokens = spark.createDataFrame([(t,) for t in counted(SEGMENTS, 4, 2)], "token string")
    return M.checkpointed(N.init_theta_random(N.index_vocab(tokens)))


def same(df, want):
    got = {r.token: r.theta for r in df.collect()}
    assert set(got) == set(want) and all(got[t] == pytest.approx(want[t], abs=1e-12) for t in want)


@pytest.mark.parametrize(("mode", "step"), [("em", em), ("viterbi", viterbi)])
def test_iterations_and_pruning(segments, start, mode, step):
    theta = random_start(counted(SEGMENTS, 4, 2))
    for prune in (None, 0.02):
        want = theta
        for _ in range(4):
            want = step(want, SEGMENTS, prune)
        same(M.TRAINERS[mode](segments, start, 4, prune=prune), want)


@pytest.mark.parametrize(("mode", "step"), [("em", em), ("viterbi", viterbi)])
def test_train_vocab_to_a_size(segments, start, mode, step):
    """Several rounds of training, shrinking, renumbering and restarting."""
    theta, size = random_start(counted(SEGMENTS, 4, 2)), 14
    n = len(theta)
    while n > size:
        theta = step(theta, SEGMENTS)
        n = max(size, int(n * 0.7))
        kept = shrunk(theta, n)
        # a token without probability goes when ids are closed up; shrinking has added a little to all
        theta = random_start(sorted(kept))
    same(M.train_vocab(segments, start, size, 0.7, 1, mode, keep_char=True), step(theta, SEGMENTS))


def test_train_corpus_in_many_rounds(spark):
    docs = spark.createDataFrame([(" ".join(w for w, n in zip(WORDS, SEGMENTS.values(), strict=True) for _ in range(n)),)], "text string")
    low = 0.5 / sum(len(s) * n for s, n in SEGMENTS.items())
    for mode, step in (("em", em), ("viterbi", viterbi)):
        theta = random_start(counted(SEGMENTS, 4, 3))
        for _ in range(6):
            theta = step(theta, SEGMENTS, low)
        same(M.train_corpus(docs, 4, 3, 6, mode), normalised({t: p for t, p in theta.items() if p > 0}))


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_steps_over_batches(segments, start, batches):
    theta = random_start(counted(SEGMENTS, 4, 2))
    for step in range(batches):
        own = {s: w for s, w in SEGMENTS.items() if int(unit(s) * batches) == step}
        if own:
            rate, new = (step + 2) ** -0.8, viterbi(theta, own)
            theta = {t: theta[t] * (1 - rate) + new[t] * rate for t in theta}
    same(M.train_viterbi_stepwise(segments, start, batches), theta)


def test_mean_over_batches(segments, start):
    theta = random_start(counted(SEGMENTS, 4, 2))
    n = len(SEGMENTS) // 3
    for _ in range(2):
        shares = dict.fromkeys(theta, 0.0)
        for b in range(n):
            own = {s: w for s, w in SEGMENTS.items() if int(unit(s) * n) == b}
            if own:
                for t, p in viterbi(theta, own).items():
                    shares[t] += p / n
        theta = normalised(shares)
    same(M.train_viterbi_batch(segments, start, 2, batch=3), theta)


def test_reestimated_scores(spark, segments):
    tokens = [t for t in counted(SEGMENTS, 3, 2) if t != UNK]
    original = spark.createDataFrame([(i, t) for i, t in enumerate(reversed(tokens))], "pos int, token string")
    theta = dict.fromkeys([*tokens, UNK], 1 / (len(tokens) + 1))
    for _ in range(3):
        theta = em(theta, SEGMENTS)
    got = {r.token: r.score for r in M.reestimate_scores(original, segments, "em", 3).collect()}
    assert got == {t: pytest.approx(math.log(theta[t])) for t in tokens}
