"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks, trained on labelled sentences.

Kernel: two words are alike by the letter triples that both hold as subsequences, each weighted by
``DECAY`` per skipped letter, up to ``MAX_STEP - 1`` skipped between two letters. So a word with letters or signs put
in, or with another ending, stays close to the word that was learnt. Words spelt letter by letter are joined first.
Two sentences are alike by the sum over their pairs of words of this likeness to the power of ``POWER``, so that words
that share a few triples by chance add little.

Training: the labelled documents (a bounded, documented sample of ``TRAIN_ROWS``) are cut into sentences, as sets of
words; Spark cuts and deduplicates them, and at most ``TRAIN_SENTENCES`` of either label, drawn by hash, reach the
driver. A sentence of toxic and of clean documents is clean. A document is labelled, not each of its sentences, so
training goes in rounds: the first takes all sentences of toxic documents for positive, later ones those of each toxic
document that the machine before finds most toxic, if it puts them above nearly all clean ones. Landmarks are words of
the labelled sentences (one-word sentences): those that the positive ones hold beyond chance, and the clean ones nearest
to them. The features of a sentence are its kernel values against the landmarks, whitened; a linear machine with squared
hinge loss is fitted on them. The last round adds the clean sentences of the whole sample that were taken for toxic.

A sentence's kernel is a sum over its words, so each word has a share and a sentence's margin is the sum of its words'
shares and the bias. A document's evidence is the margins of its ``EVIDENCE`` most toxic sentences; a logistic curve
fitted on the training documents turns them into a score. Scoring is one Arrow pass over whole texts, without a
shuffle, in batches bounded by characters.

Defined cases: null, blank and letter-free texts have the lowest evidence; a sentence of more than ``RUN`` words is
taken in runs of that many, a word of more than ``LONG_WORD`` characters in pieces; without labels of both kinds every
score is the share of toxic labels (0 if there are none); repeated rows are scored alike; a document with both labels
is clean in training; columns named like a result are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import cut_lineage

TRAIN_ROWS = 20_000
TRAIN_SENTENCES = 25_000
HARD_SENTENCES = 8_000
N_LANDMARKS = 128
ROUNDS = 2
DECAY, MAX_STEP = 0.6, 3
PENALTY = 1e-4
POWER = 3
THRESHOLD = 0.7
CACHED_WORDS = 1_000_000
BATCH_CHARS = 1_000_000
EVIDENCE = 4
RUN = 8
LONG_WORD = 64
FLOOR = -2.0  # margins count from here to its opposite

LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåçéèêëíìîïñóòôöõúùûüßœæ"
LEET = dict(zip("013457@", "oieasta", strict=True))
START, END, OTHER = len(LETTERS) + 1, len(LETTERS) + 2, len(LETTERS) + 3
CLASSES = OTHER + 1

CODE = np.zeros(0x10000, dtype=np.int32)
for _c in range(0x80, 0x10000):
    CODE[_c] = OTHER if chr(_c).isalpha() else 0
for _i, _c in enumerate(LETTERS):
    CODE[ord(_c)] = _i + 1
for _c, _l in LEET.items():
    CODE[ord(_c)] = LETTERS.index(_l) + 1

BREAK = ""  # stands for the end of a line
SPELT = re.compile(r"(?<!\S)(?:[^\W\d_]\s+){2,}[^\W\d_](?!\S)")
LONG = re.compile(rf"\S{{{LONG_WORD + 1}}}")
PIECES = re.compile(rf"\S{{1,{LONG_WORD}}}")
STOPS = {*".!?…"}
CLOSING = "\"'»”’)]"
LAST = re.compile(r"[.!?…][\"'»”’)\]]*$|^[|]$")
NO_SIGNS = {c: None for c in [*range(33, 127), ord(BREAK)] if not chr(c).isalnum() and chr(c) not in LEET}


def is_last(word: str) -> bool:
    """Whether a word ends a sentence: the end of a line, or a match of ``LAST``."""
    return word == BREAK or word == "|" or word.rstrip(CLOSING)[-1:] in STOPS


def word_list(text: str) -> list[str]:
    """Lower-cased words, with a mark at each line's end; three or more single letters in a row follow as one word."""
    low = text.lower()
    found = (PIECES.findall if LONG.search(low) else str.split)(low.replace("\n", f" {BREAK} "))
    joined = [w for m in SPELT.finditer(low) for w in (BREAK, *PIECES.findall(re.sub(r"\s+", "", m[0])))]
    return found + joined if joined else found


def without_signs(words: list[str]) -> list[str]:
    return [w.translate(NO_SIGNS) for w in words]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, triple code, weight) of every gapped letter triple of the words; a word's weights have norm one."""
    return trimmed_triples(without_signs(words))


def trimmed_triples(trimmed: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`triples` of words without signs."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in trimmed).encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(trimmed)), [len(w) + 2 for w in trimmed])
    kinds = CODE[np.minimum(flat, 0xFFFF)]
    kinds[flat == 2], kinds[flat == 3] = START, END
    out = []
    for one in range(1, MAX_STEP + 1):
        for two in range(1, MAX_STEP + 1):
            n = len(kinds) - one - two
            if n <= 0:
                continue
            a, b, c = kinds[:n], kinds[one : one + n], kinds[one + two :]
            at = np.flatnonzero((a > 0) & (b > 0) & (c > 0) & (owner[:n] == owner[one + two :]))
            out.append((owner[at], (a[at] * CLASSES + b[at]) * CLASSES + c[at], np.full(len(at), DECAY ** (one + two - 2), dtype=np.float32)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    owner, code, weight = (np.concatenate(p) for p in zip(*out, strict=True))
    norm = np.sqrt(np.bincount(owner, weights=weight.astype(np.float64) ** 2, minlength=len(trimmed)))
    return owner, code, (weight / norm[owner]).astype(np.float32)


def runs(ends: np.ndarray) -> np.ndarray:
    """Where sentences begin, from flags of their last words; after ``RUN`` words a new one begins."""
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    first = np.r_[True, ends[:-1]]
    start = np.flatnonzero(first)
    at = np.arange(len(ends)) - np.repeat(start, np.diff(np.r_[start, len(ends)]))
    return np.flatnonzero(at % RUN == 0)


class Landmarks:
    """Words against which the kernel is worked out: for every triple that some hold, which do and with what weight."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        owner, code, weight = triples(words)
        used, at = np.unique(code, return_inverse=True)
        self.place = np.full(CLASSES**3, -1, dtype=np.int32)
        self.place[used] = np.arange(len(used))
        pairs, back = np.unique(at.astype(np.int64) * len(words) + owner, return_inverse=True)
        self.of, self.weights = pairs % max(1, len(words)), np.bincount(back, weights=weight, minlength=len(pairs))
        self.starts = np.searchsorted(pairs, np.arange(len(used) + 1) * len(words))

    def kernel(self, words: list[str]) -> np.ndarray:
        """A row per word, a column per landmark. Triples that no landmark holds add nothing; signs make no difference."""
        number: dict[str, int] = {}
        rows = [number.setdefault(w, len(number)) for w in without_signs(words)]
        known, n = list(number), len(self.words)
        out = np.zeros((len(known), n), dtype=np.float32)
        for first in range(0, len(known), 4096):  # bounds the triples in memory
            part = known[first : first + 4096]
            owner, code, weight = trimmed_triples(part)
            at = self.place[code]
            keep = np.flatnonzero(at >= 0)
            begins = self.starts[at[keep]]
            times = self.starts[at[keep] + 1] - begins
            held = np.repeat(begins - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            cells = np.repeat(owner[keep] * n, times) + self.of[held]
            likeness = np.bincount(cells, weights=np.repeat(weight[keep], times) * self.weights[held], minlength=len(part) * n)
            out[first : first + len(part)] = (likeness**POWER if POWER != 3 else likeness * likeness * likeness).reshape(len(part), n)
        return out if len(known) == len(words) else out[rows]


@dataclass
class Model:
    landmarks: Landmarks | None
    weights: np.ndarray | None = None  # per landmark
    bias: float = 0.0
    slopes: tuple[float, ...] = (0.0,) * EVIDENCE
    shift: float = 0.0

    def shares(self, words: list[str]) -> np.ndarray:
        """What each word adds to its sentence's margin."""
        return (self.landmarks.kernel(words) @ self.weights).astype(np.float64)

    def margins(self, sentences: list[list[str]]) -> np.ndarray:
        flat = [w for s in sentences for w in s]
        owner = np.repeat(np.arange(len(sentences)), list(map(len, sentences)))
        known = list(dict.fromkeys(flat))
        share = dict(zip(known, self.shares(known).tolist(), strict=True))
        return np.bincount(owner, weights=[share[w] for w in flat], minlength=len(sentences)) + self.bias

    def probability(self, evidence: Column) -> Column:
        return 1 / (1 + F.exp(-sum((F.lit(s) * evidence[i] for i, s in enumerate(self.slopes)), F.lit(self.shift))))


class Scorer:
    """The evidence of texts; the shares of words are kept from text to text."""

    def __init__(self, model: Model) -> None:
        self.model, self.place = model, {}
        self.share, self.last = np.zeros(1024), np.zeros(1024, dtype=bool)

    def learn(self, new: list[str]) -> None:
        n = len(self.place)
        if n + len(new) > len(self.share):
            size = 2 * (n + len(new))
            self.share, self.last = (np.concatenate([x[:n], np.zeros(size - n, dtype=x.dtype)]) for x in (self.share, self.last))
        self.share[n : n + len(new)] = self.model.shares(new)
        self.last[n : n + len(new)] = [is_last(w) for w in new]
        self.place.update(zip(new, range(n, n + len(new)), strict=True))

    def of(self, texts: list[str | None]) -> list[list[float]]:
        lists = [word_list(t) if t else [] for t in texts]
        if len(self.place) > CACHED_WORDS:
            self.place = {}
        new = set().union(*lists).difference(self.place)
        if new:
            self.learn(sorted(new))
        get, out = self.place.__getitem__, []
        for words in lists:
            at = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
            margin = np.zeros(0)
            if len(at):
                sentence = np.cumsum(np.bincount(runs(self.last[at]), minlength=len(at))) - 1
                pairs = np.unique(sentence * len(self.share) + at)  # a word counts once a sentence
                margin = np.bincount(pairs // len(self.share), weights=self.share[pairs % len(self.share)])
                margin = np.clip(margin + self.model.bias, FLOOR, -FLOOR)
            top = np.sort(np.partition(margin, len(margin) - EVIDENCE)[-EVIDENCE:] if len(margin) > EVIDENCE else margin)[::-1]
            out.append([*top.tolist(), *[FLOOR] * (EVIDENCE - len(top))])
        return out


def bounded(texts: list[str | None], most: int = BATCH_CHARS) -> Iterator[list[str | None]]:
    """``texts`` in lists of at most 256 of them and, if more than one, ``most`` characters."""
    held, size = [], 0
    for t in texts:
        n = len(t or "")
        if held and (len(held) == 256 or size + n > most):
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def sentences_of(text: str) -> list[str]:
    """The sentences as scoring sees them: their distinct words, joined by blanks."""
    words = word_list(text)
    if not words:
        return []
    starts = runs(np.array([is_last(w) for w in words], dtype=bool)).tolist()
    return [" ".join(sorted({w for w in words[a:b] if w != BREAK})) for a, b in zip(starts, [*starts[1:], len(words)], strict=True)]


def labelled_sentences(rows: DataFrame) -> DataFrame:
    """(s, toxic, doc): the distinct sentences of ``rows(doc_id, text, toxic)``; of both labels they are clean."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for doc, text, toxic in frame.itertuples(index=False):
                found = list({s for s in sentences_of(text) if s})
                yield pd.DataFrame({"s": found, "toxic": [toxic] * len(found), "doc": [doc] * len(found)})

    cuts = rows.select("doc_id", "text", "toxic").mapInPandas(cut, "s string, toxic long, doc long")
    return cuts.groupBy("s").agg(F.min("toxic").alias("toxic"), F.min("doc").alias("doc"))


# --- fitting, on the bounded sample ------------------------------------------------------------


def fit_machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows within the margin."""
    z = np.hstack([z, np.ones((len(z), 1), dtype=z.dtype)])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], PENALTY)
    ridge[-1] = 1e-9
    before = None
    for _ in range(15):
        active = y * (z @ w.astype(z.dtype)) < 1
        if before is not None and not (active != before).any():
            break
        before = active
        za = z[active]
        weighted = za * cost[active, None].astype(z.dtype)
        w = np.linalg.solve((za.T @ weighted).astype(np.float64) + np.diag(ridge), (weighted.T @ y[active].astype(z.dtype)).astype(np.float64))
    return w[:-1], float(w[-1])


class Sample:
    """Sentences as word numbers."""

    def __init__(self, sentences: list[str]) -> None:
        split = [s.split() for s in sentences]
        self.words = sorted({w for s in split for w in s})
        number = {w: i for i, w in enumerate(self.words)}
        self.flat = np.array([number[w] for s in split for w in s], dtype=np.int64)
        self.starts = np.cumsum([0, *map(len, split)])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def times(self, rows: np.ndarray) -> np.ndarray:
        """In how many of the rows each word is."""
        return np.bincount(np.concatenate([self.flat[self.starts[i] : self.starts[i + 1]] for i in rows]), minlength=len(self.words))

    def summed(self, per_word: np.ndarray) -> np.ndarray:
        """Sums over the words of every sentence."""
        parts = [np.add.reduceat(per_word[self.flat[self.starts[i] : self.starts[j]]], self.starts[i:j] - self.starts[i], axis=0) for i in range(0, len(self), 4096) for j in [min(i + 4096, len(self))]]
        return np.concatenate(parts)

    def fit(self, marks: list[int], rows: np.ndarray, y: np.ndarray) -> tuple[Model, np.ndarray]:
        """The machine on ``rows`` with labels ``y``, and the words' shares. Either label weighs one half."""
        landmarks = Landmarks([self.words[i] for i in marks])
        per_word = landmarks.kernel(self.words)
        values, vectors = np.linalg.eigh(per_word[marks].astype(np.float64))
        keep = values > 1e-5 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        w, bias = fit_machine(self.summed(per_word)[rows] @ whiten.astype(np.float32), y, cost)
        model = Model(landmarks, (whiten @ w).astype(np.float32), bias)
        return model, per_word @ model.weights

    def margins(self, shares: np.ndarray, bias: float) -> np.ndarray:
        return self.summed(shares) + bias


def train_sentences(sentences: list[tuple[str, int, int | None]], n_landmarks: int = N_LANDMARKS, rounds: int = ROUNDS, hard: list[str] | None = None, start: Model | None = None) -> Model | None:
    """The machine from (sentence, toxic, document) rows; None without sentences of both labels.

    With ``start`` the rounds go on from that model.
    """
    rows = sorted({r for r in sentences if r[0].strip()}, key=lambda r: (r[1], r[0])) + [(s, 0, None) for s in sorted(hard or []) if s.strip()]
    toxic = np.array([r[1] for r in rows], dtype=bool)
    if not toxic.any() or toxic.all():
        return None
    sample = Sample([r[0] for r in rows])
    bad, good = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    document = np.array([-1 if r[2] is None else r[2] for r in rows])
    in_bad, in_good = sample.times(bad), sample.times(good)
    positive, model = bad, start
    if start is not None:
        shares = start.shares(sample.words)
    for turn in range(rounds):
        if turn or start is not None:
            margins = sample.margins(shares, model.bias)
            order = bad[np.lexsort((-margins[bad], document[bad]))]
            first = np.flatnonzero(np.r_[True, document[order][1:] != document[order][:-1]])
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            found = order[(place < EVIDENCE) & (margins[order] > np.quantile(margins[good], 0.98))]
            positive = found if len(found) else positive
            in_bad = sample.times(positive)
        # Landmarks: words that are in more of the positive sentences than chance has it, then those like them that are clean.
        rate_bad, rate_good = in_bad / len(positive), in_good / len(good)
        excess = (rate_bad - rate_good) / np.sqrt(rate_bad / len(positive) + rate_good / len(good) + 1e-12)
        marks = [i for i in np.argsort(-excess, kind="stable")[: n_landmarks * 2 // 3].tolist() if excess[i] > 0]
        near = Landmarks([sample.words[i] for i in marks]).kernel(sample.words).max(axis=1) * (in_good > 0)
        near[marks] = 0
        marks += np.argsort(-near, kind="stable")[: n_landmarks - len(marks)].tolist()
        model, shares = sample.fit(sorted(set(marks)), np.r_[positive, good], np.r_[np.ones(len(positive)), -np.ones(len(good))])
    return model


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, steps: int = 80) -> tuple[tuple[float, ...], float]:
    """Slopes and shift of a logistic curve by damped Newton steps."""
    z = np.c_[evidence, np.ones(len(evidence))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + 1e-2 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hessian, z.T @ (p - toxic) + 1e-2 * w), -2, 2)
        w[:-1] = np.maximum(w[:-1], 0.0)  # more evidence never lowers a score
    return tuple(w[:-1].tolist()), float(w[-1])


# --- Spark operators ---------------------------------------------------------------------------


def with_evidence(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``evidence``: the margins of the whole text's most toxic sentences, highest first."""

    @F.pandas_udf("array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([e for part in bounded(texts.tolist()) for e in scorer.of(part)], index=texts.index, dtype=object)

    return docs.withColumn("evidence", evidence(F.col(text)))


def hardest(sentences: DataFrame, model: Model, rows: int = HARD_SENTENCES) -> list[str]:
    """The clean sentences that the model takes for the most toxic."""

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                yield frame.assign(margin=model.margins([s.split() for s in frame["s"]]))[["s", "margin"]]

    scored = sentences.where("toxic = 0").select("s").mapInPandas(margins, "s string, margin double")
    return [r[0] for r in scored.where("margin > -1").orderBy(F.desc("margin"), "s").limit(rows).collect()]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, sentences: int = TRAIN_SENTENCES) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` that are not held out."""
    known = labels.where(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("toxic").cast("long").alias("toxic"))
    sample = cut_lineage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # bounded by parameter
    rows_ = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.col("text").isNotNull())
    found = cut_lineage(labelled_sentences(rows_))
    of = lambda toxic: found.where(F.col("toxic") == toxic).orderBy(F.xxhash64("s"), "s").limit(sentences)
    picked = [tuple(r) for r in of(1).union(of(0)).select("s", "toxic", "doc").collect()]  # bounded by parameter
    model = train_sentences(picked)
    if model is None:
        share = sample.agg(F.avg("toxic")).collect()[0][0]
        return Model(None, shift=float(np.log((share + 1e-6) / (1 - share + 1e-6))) if share else -14.0)
    model = train_sentences(picked, rounds=1, hard=hardest(found, model), start=model) or model
    pairs = with_evidence(rows_, model).select("evidence", "toxic").collect()  # a few numbers a sampled row
    model.slopes, model.shift = fit_curve(np.array([r[0] for r in pairs]), np.array([r[1] for r in pairs], dtype=float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    flat = F.array(*[F.lit(FLOOR)] * EVIDENCE)
    scored = docs.withColumn("evidence", flat) if model.landmarks is None else with_evidence(docs, model, text)
    return scored.withColumn("score", model.probability(F.col("evidence"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop("evidence")


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
