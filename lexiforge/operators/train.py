"""Training a unigram model: expectation-maximisation and best-path variants, and shrinking to a size.

A ``Trainer`` holds the distinct segments: beside the vocabulary's trie, or, where that would be too large, as edge arrays
built once per vocabulary. An iteration scans them and adds up by token id (partial and final hash aggregate). Probabilities
are written to the shared checkpoint folder after each iteration, so neither lineage nor a lost executor grows the work.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.patterns import UNK
from lexiforge.functions.text import digits_apart
from lexiforge.operators import forest, ngrams, vocab as V
from lexiforge.operators.lattice import edge_arrays, lattice, with_scores
from lexiforge.operators.levels import frequent_ngrams
from lexiforge.operators.lines import CHUNK, best_paths_by_trie, em_counts_by_trie, lattice_arrays, masses_of_edges
from lexiforge.operators.nbest import nbest_astar
from lexiforge.operators.segment import best_paths, path_sums, posteriors
from lexiforge.operators.trie import MAX_TOKENS, fits, matcher, with_scores_of

TINY = 1e-30


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset a local session (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexiforge-"))
    return df.checkpoint()


def with_lp(vocab: DataFrame, ticks: float | None = None) -> DataFrame:
    """ln(theta) as ``lp``; null where theta is 0.

    With ``ticks`` it is rounded to whole multiples of 1 / ticks and given in them: sums of scores are exact then, so
    equal paths tie on every machine.
    """
    log = F.log("theta") if ticks is None else F.round(F.log("theta") * ticks)
    return vocab.withColumn("lp", F.when(F.col("theta") > 0, log))


def em_counts(arrays: DataFrame, vocab: DataFrame, repeats: str = "sum", normalize: str = "line") -> DataFrame:
    """(token_id, mass): the E-step. ``repeats='last'`` counts a token once a segment, at its last place."""
    scored = with_scores(arrays, with_lp(vocab))
    if repeats == "sum" and normalize == "line":
        return masses_of_edges(scored)
    post = posteriors(path_sums(scored), normalize)
    if repeats == "last":
        post = post.groupBy("seg", "weight", "token_id").agg(F.max_by("post", "e").alias("post"))
    return post.groupBy("token_id").agg(F.sum(F.col("post") * F.col("weight")).alias("mass"))


class Trainer:
    """The segments of a training run under a vocabulary whose tokens stay the same; persisted ones are dealt out already
    and stay persisted."""

    def __init__(self, segments: DataFrame, vocab: DataFrame, max_length: int | None = None, repeats: str = "sum") -> None:
        self.repeats, self.tries, self.shared = repeats, None, segments.storageLevel.useMemory
        if repeats == "sum" and fits(vocab):
            self.tries = matcher(vocab, max_length)
            self.rows = segments if self.shared else ngrams.spread(segments).persist()
        else:
            self.shared = False
            self.rows = edge_arrays(lattice(segments, vocab, max_length)).persist()

    def masses(self, vocab: DataFrame, normalize: str = "line") -> DataFrame:
        """(token_id, mass): the E-step."""
        if self.tries is None:
            return em_counts(self.rows, vocab, self.repeats, normalize)
        return em_counts_by_trie(self.rows, self.tries, with_scores_of(with_lp(vocab), self.tries), normalize)

    def best(self, vocab: DataFrame, ticks: float | None = None, rows: DataFrame | None = None) -> DataFrame:
        """(seg, weight, pieces, ids, score): best paths of all segments, or of some ``rows`` of them."""
        rows = self.rows if rows is None else rows
        if self.tries is None:
            return best_paths(with_scores(rows, with_lp(vocab, ticks)))
        return best_paths_by_trie(rows, self.tries, with_scores_of(with_lp(vocab, ticks), self.tries))

    def __enter__(self) -> Trainer:
        return self

    def __exit__(self, *_: object) -> None:
        if not self.shared:
            self.rows.unpersist()


def maximised(vocab: DataFrame, counts: DataFrame, prune: float | None = None) -> DataFrame:
    """``vocab`` with new theta from ``counts(token_id, mass)``; ``prune`` is a threshold for prune_vocab.

    The masses, a row per token, are written once: their sum and the quotients would each run the E-step.
    """
    rest = [c for c in vocab.columns if c not in ("theta", "lp")]
    joined = vocab.select(*rest).join(checkpointed(counts), "token_id", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)) + TINY)
    new = ngrams.normalized(joined, "mass").drop("mass")
    return new if prune is None else V.prune_vocab(new, prune)


def em_step(arrays: DataFrame, vocab: DataFrame, repeats: str = "sum", normalize: str = "line", prune: float | None = None) -> DataFrame:
    """``vocab`` with new theta, from edge arrays."""
    return maximised(vocab, em_counts(arrays, vocab, repeats, normalize), prune)


def train_em(segments: DataFrame, vocab: DataFrame, max_iter: int = 2, repeats: str = "sum", normalize: str = "line", prune: float | None = None, max_length: int | None = None) -> DataFrame:
    """Expectation-maximisation over words or whole lines of any length."""
    with Trainer(segments, vocab, max_length, repeats) as held:
        for _ in range(max_iter):
            vocab = checkpointed(maximised(vocab, held.masses(vocab, normalize), prune))
    return vocab


def token_counts_of(paths: DataFrame) -> DataFrame:
    """(token_id, n) of best paths, by weight."""
    return paths.select(F.explode("ids").alias("token_id"), "weight").groupBy("token_id").agg(F.sum("weight").alias("n"))


def _relative(vocab: DataFrame, counts: DataFrame, n: str) -> DataFrame:
    """``vocab`` with theta from ``counts``, a row per token, which are written once as they are read twice."""
    rest = [c for c in vocab.columns if c not in ("theta", "lp")]
    joined = vocab.select(*rest).join(checkpointed(counts), "token_id", "left").withColumn(n, F.coalesce(n, F.lit(0)).cast("double"))
    return ngrams.normalized(joined, n).drop(n)


def train_viterbi(segments: DataFrame, vocab: DataFrame, max_iter: int = 2, prune: float | None = None, max_length: int | None = None, ticks: float | None = None) -> DataFrame:
    """Hard EM: relative counts on best paths, without smoothing; unseen tokens get 0."""
    with Trainer(segments, vocab, max_length) as held:
        for _ in range(max_iter):
            vocab = _relative(vocab, token_counts_of(held.best(vocab, ticks)), "n")
            vocab = checkpointed(vocab if prune is None else V.prune_vocab(vocab, prune))
    return vocab


def batched(segments: DataFrame, batches: int, seed: int = 0) -> DataFrame:
    """``segments`` with a batch number by hash."""
    return segments.withColumn("batch", F.floor(ngrams.uniform_hash("seg", seed=seed) * batches).cast("int"))


def batch_shares(paths: DataFrame, batches: int, seed: int = 0) -> DataFrame:
    """(batch, token_id, share): relative counts of each batch's best paths."""
    counts = batched(paths, batches, seed).select("batch", F.explode("ids").alias("token_id"), "weight").groupBy("batch", "token_id").agg(F.sum("weight").alias("n"))
    totals = counts.groupBy("batch").agg(F.sum("n").alias("total"))
    return counts.join(totals, "batch").select("batch", "token_id", (F.col("n") / F.col("total")).alias("share"))


def train_viterbi_batch(segments: DataFrame, vocab: DataFrame, max_iter: int = 1, batch: int = 256, seed: int = 0, max_length: int | None = None, ticks: float | None = None) -> DataFrame:
    """The mean of the batches' relative counts, all batches against the same probabilities."""
    n = max(1, segments.count() // batch)
    with Trainer(segments, vocab, max_length) as held:
        for _ in range(max_iter):
            mean = batch_shares(held.best(vocab, ticks), n, seed).groupBy("token_id").agg((F.sum("share") / n).alias("share"))
            vocab = checkpointed(_relative(vocab, mean, "share"))
    return vocab


def stepped(vocab: DataFrame, counts: DataFrame, step: int, decay: float) -> DataFrame:
    """``vocab`` moved towards the relative ``counts(token_id, n)`` by (step + 2) ** -decay."""
    rate = (step + 2) ** -decay
    part = _relative(vocab, counts, "n").select("token_id", F.col("theta").alias("_new"))
    mixed = vocab.join(part, "token_id").withColumn("theta", F.col("theta") * (1 - rate) + F.col("_new") * rate)
    return mixed.select(*vocab.columns)


def train_viterbi_stepwise(segments: DataFrame, vocab: DataFrame, batches: int = 4, decay: float = 0.8, seed: int = 0, max_length: int | None = None, ticks: float | None = None) -> DataFrame:
    """Online: theta moves towards each batch's relative counts; a Spark job per batch."""
    with Trainer(segments, vocab, max_length) as held:
        for step in range(batches):
            own = batched(held.rows, batches, seed).where(F.col("batch") == step).drop("batch")
            if not own.isEmpty():  # a batch without segments teaches nothing
                vocab = checkpointed(stepped(vocab, token_counts_of(held.best(vocab, ticks, own)), step, decay))
    return vocab


TRAINERS = {"em": train_em, "viterbi": train_viterbi, "viterbi_batch": train_viterbi_batch, "viterbi_stepwise": train_viterbi_stepwise}


def trainer_options(mode: str, epochs: int, ticks: float | None = None) -> dict:
    """Keyword arguments of a trainer: the online form has no epochs, and only best paths have ties."""
    return ({} if mode == "viterbi_stepwise" else {"max_iter": epochs}) | ({} if mode == "em" else {"ticks": ticks})


def train_vocab(segments: DataFrame, vocab: DataFrame, size: int, shrink_ratio: float = 0.8, max_epoch: int = 2, mode: str = "em", keep_char: bool = False, seed: int = 0, max_length: int | None = None, ticks: float | None = None, by: str = "theta") -> DataFrame:
    """Trains, keeps the best ``shrink_ratio``, renumbers and restarts until ``size`` tokens are left; then trains.

    ``by``: the best are those of the largest ``theta``, or those without which most likelihood is lost (``loss``).
    """
    if by not in ("theta", "loss"):
        raise ValueError("by is theta or loss")
    options = trainer_options(mode, max_epoch, ticks) | {"max_length": max_length}
    n = vocab.count()
    segments = ngrams.spread(segments).persist()  # once for all rounds
    try:
        return _shrunk(segments, vocab, n, size, shrink_ratio, mode, keep_char, seed, by, options)
    finally:
        segments.unpersist()


def _shrunk(segments: DataFrame, vocab: DataFrame, n: int, size: int, shrink_ratio: float, mode: str, keep_char: bool, seed: int, by: str, options: dict) -> DataFrame:
    while n > size:
        trained = TRAINERS[mode](segments, vocab, **options)
        n = max(size, int(n * shrink_ratio))
        kept = V.shrink_vocab(trained, n, True, keep_char, seed) if by == "theta" else V.shrink_vocab_by_loss(trained, checkpointed(token_losses(trained)), n, keep_char, seed)
        shrunk = checkpointed(V.reindex(kept))
        vocab = checkpointed(ngrams.init_theta_random(shrunk.drop("theta"), seed))
    return TRAINERS[mode](segments, vocab, **options)


def token_losses(vocab: DataFrame, ticks: float | None = None) -> DataFrame:
    """(token_id, loss) of ``vocab(token_id, token, theta)``, from the two best paths of every token's own string."""
    scored = with_lp(vocab, ticks)
    own = scored.where(F.col("token") != UNK).select(F.col("token").alias("seg"), F.lit(1).cast("long").alias("weight"))
    paths = nbest_astar(own, matcher(scored, score="lp", use_unk=False), 2)
    return V.token_losses(vocab, paths.withColumnRenamed("seg", "token"))


def reestimate_scores(original: DataFrame, segments: DataFrame, mode: str = "em", epochs: int = 2, max_length: int | None = None, ticks: float | None = None) -> DataFrame:
    """(pos, token, score): new ln(theta) for a fixed vocabulary ``original(pos, token)``, in its order."""
    start = ngrams.vocab_uniform(original.select("token").union(original.sparkSession.range(1).select(F.lit(UNK).alias("token"))).distinct())
    return V.scores_in_order(original, TRAINERS[mode](segments, checkpointed(start), max_length=max_length, **trainer_options(mode, epochs, ticks)))


def retrain_wordpiece_vocab(vocab: DataFrame, segments: DataFrame, max_iter: int = 1, prefix: str = "##") -> DataFrame:
    """EM over a fixed vocabulary with continuation pieces; ids stay."""
    from lexiforge.operators.lattice import continuation_lattice

    if fits(vocab):
        arrays = lattice_arrays(segments, matcher(vocab, prefix=prefix)).persist()
    else:
        arrays = edge_arrays(continuation_lattice(segments, vocab, prefix)).persist()
    out = ngrams.normalized(vocab.drop("theta"), F.lit(1.0))
    for _ in range(max_iter):
        out = checkpointed(em_step(arrays, out))
    arrays.unpersist()
    return out


def train_corpus(docs: DataFrame, max_length: int = 5, min_freq: int = 50, max_epoch: int = 2, mode: str = "em", text: str = "text", ticks: float | None = None) -> DataFrame:
    """Seeds from the corpus, training with pruning, renumbered: (token_id, token, theta)."""
    segments = checkpointed(ngrams.to_segments(docs, text))
    seeds = ngrams.seed_vocab(ngrams.count_ngrams(segments, max_length), min_freq)
    vocab = checkpointed(ngrams.init_theta_random(ngrams.index_vocab(checkpointed(seeds.select("token")))))
    total = ngrams.unigram_total(segments).collect()[0][0]
    trained = TRAINERS[mode](segments, vocab, prune=0.5 / max(1, total), max_length=max_length, **trainer_options(mode, max_epoch, ticks))
    return V.reindex(ngrams.normalized(trained, "theta"))


def train_from_ngrams(segments: DataFrame, given: DataFrame, size: int, max_length: int, min_freq: int, max_epoch: int = 2, seed: int = 0, by: str = "theta") -> DataFrame:
    """(token_id, token, is_fixed, theta) of ``size`` tokens: ``train_vocab`` from the frequent n-grams of ``segments`` and the
    tokens ``given(token, is_fixed)``, over prefix trees. Single characters stay.

    Shrinking by loss, and more tokens than the driver may hold, take the vocabulary as a table.
    """
    given = given.where(F.col("token") != "").groupBy("token").agg(F.max("is_fixed").alias("is_fixed"))
    some = given.limit(MAX_TOKENS + 1).collect()
    if by == "theta" and len(some) <= MAX_TOKENS:
        wood = forest.trees(segments, max_length)
        try:
            grams = forest.grow(wood, max_length, min_freq)
            if grams is not None:
                held = forest.Forest(segments.sparkSession, wood, grams, sorted({UNK, *(r.token for r in some)}), {r.token for r in some if r.is_fixed})
                try:
                    return held.train(size, 0.8, max_epoch, True, seed, TINY, _masses_of_long(segments))
                finally:
                    held.release()
        finally:
            wood.unpersist()
    tokens = ngrams.seed_vocab(frequent_ngrams(segments, max_length, min_freq), min_freq).select("token")
    tokens = ngrams.with_fixed_seeds(tokens.union(given.where("not is_fixed").select("token")), given.where("is_fixed"))
    vocab = checkpointed(ngrams.init_theta_random(ngrams.index_vocab(checkpointed(tokens)), seed))
    return train_vocab(segments, vocab, size, max_epoch=max_epoch, keep_char=True, seed=seed, by=by)


def _masses_of_long(segments: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
    """The E-step over the segments that are too long for a prefix tree, if there are any."""
    long = segments.where(F.length("seg") > CHUNK)
    if long.isEmpty():
        return None

    def masses(vocab: DataFrame) -> DataFrame:
        with Trainer(long, vocab) as held:
            return checkpointed(held.masses(vocab))

    return masses


def train_language_vocab(docs: DataFrame, size: int, max_length: int = 16, min_freq: int = 2, digits: bool = True, user_symbols: tuple[str, ...] = (), text: str = "text", byte_fallback: bool = False, by: str = "theta") -> DataFrame:
    """A vocabulary of ``size`` tokens of one language, with digits split and user symbols kept.

    With ``byte_fallback`` the 256 byte pieces are kept too.
    """
    lines = docs.withColumn(text, digits_apart(F.col(text))) if digits else docs
    segments = checkpointed(ngrams.to_segments(lines, text))
    kept = [*user_symbols, *(f"<0x{i:02X}>" for i in range(256) if byte_fallback)]
    given = docs.sparkSession.createDataFrame([(s, True) for s in kept], "token string, is_fixed boolean")
    return train_from_ngrams(segments, given, size, max_length, min_freq, by=by)
