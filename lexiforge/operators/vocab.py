"""Vocabulary tables: cleaning, merging, typing, pruning. ``pos`` carries a table's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions.patterns import HEAD, LETTERS, LONGEST_RUN, SPECIALS, UNK
from lexiforge.functions.text import has_script, has_symbol
from lexiforge.operators.ngrams import index_vocab, normalized, uniform_hash

#: Piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def first_occurrences(vocab: DataFrame, *order: str) -> DataFrame:
    """The first row of each token: a min over the order, no sort."""
    first = vocab.groupBy("token").agg(F.min(F.struct(*order)).alias("_o"))
    return first.select(*[F.col(f"_o.{o}").alias(o) for o in order], "token", F.lit(0.0).alias("score"))


def strip_prefix(vocab: DataFrame) -> DataFrame:
    """(pos, token, score 0): tokens that begin with the head mark lose all head marks; the first of equals stays."""
    bare = F.when(F.startswith("token", F.lit(HEAD)) & (F.col("token") != HEAD), F.replace("token", F.lit(HEAD), F.lit(""))).otherwise(F.col("token"))
    return first_occurrences(vocab.select("pos", bare.alias("token")), "pos")


def strip_prefix_symbols(vocab: DataFrame) -> DataFrame:
    """The same where the head mark stands before a symbol only; the head mark is a symbol itself."""
    bare = F.when(F.col("token").rlike(f"^{HEAD}[^{LETTERS}]"), F.replace("token", F.lit(HEAD), F.lit(""))).otherwise(F.col("token"))
    return first_occurrences(vocab.select("pos", bare.alias("token")), "pos")


def merge_vocabs(*vocabs: DataFrame) -> DataFrame:
    """(file_no, pos, token, score 0): the union in file order; the first occurrence of a token stays."""
    out = None
    for i, v in enumerate(vocabs):
        part = v.select(F.lit(i).alias("file_no"), "pos", "token").where("token <> ''")
        out = part if out is None else out.union(part)
    return first_occurrences(out, "file_no", "pos")


def reset_special_scores(vocab: DataFrame, n: int, space_negative_one: bool = False) -> DataFrame:
    """The first ``n`` rows get score 0, or -1 if wished and the token has a head mark."""
    special = F.when(F.lit(space_negative_one) & F.contains("token", F.lit(HEAD)), -1.0).otherwise(0.0)
    return vocab.withColumn("score", F.when(F.col("pos") < n, special).otherwise(F.col("score")))


def assign_piece_types(vocab: DataFrame, control: tuple[str, ...] = (), unk: str = UNK) -> DataFrame:
    """``piece_type``: byte pieces, then the unknown token, then controls, else normal."""
    token = F.col("token")
    kind = F.when(token.rlike(r"(?s)^<0x.*>$"), BYTE).when(token == unk, UNKNOWN).when(token.isin(*control) if control else F.lit(False), CONTROL).otherwise(NORMAL)
    return vocab.withColumn("piece_type", kind)


def append_piece(vocab: DataFrame, piece: str, piece_type: int, score: float | None = None) -> DataFrame:
    """Adds a piece behind the last; without a score it gets that of row 1, which must be ``<s>``."""
    ends = vocab.agg(F.max("pos").alias("last"), F.max(F.when(F.col("pos") == 1, F.struct("token", "score"))).alias("second"))
    if score is None:
        second = ends.select("second.*").collect()[0]
        if second["token"] != "<s>":
            raise ValueError("row 1 must be <s>")
        score = second["score"]
    new = ends.select((F.col("last") + 1).cast("int").alias("pos"), F.lit(piece).alias("token"), F.lit(float(score)).alias("score"), F.lit(piece_type).alias("piece_type"))
    return vocab.select("pos", "token", "score", "piece_type").union(new)


def filter_by_script(tokens: DataFrame) -> DataFrame:
    return tokens.where(has_script(F.col("token"))).select("token").distinct()


def script_ratio(vocab: DataFrame) -> DataFrame:
    n, hits = F.count("*"), F.count_if(has_script(F.col("token")))
    return vocab.agg(n.alias("size"), hits.alias("script_size"), (hits / n).alias("script_ratio"))


def symbol_ratio(vocab: DataFrame) -> DataFrame:
    script, symbol = has_script(F.col("token")), has_symbol(F.col("token"))
    return script_ratio(vocab.select("token")).join(F.broadcast(vocab.agg(F.count_if(symbol).alias("symbol_size"), F.count_if(script & symbol).alias("both_size"))))  # one row each


def check_core_seeds(vocab: DataFrame, seeds: DataFrame, keyword: str, only_non_core: bool = False) -> DataFrame:
    """(token, is_core): tokens with a keyword and whether the core list has them; or those that it lacks."""
    hits = vocab.select("token").where(F.contains("token", F.lit(keyword)))
    core = seeds.select("token").distinct()
    if only_non_core:
        return hits.join(core, "token", "left_anti").withColumn("is_core", F.lit(False))
    return hits.join(core.withColumn("_c", F.lit(True)), "token", "left").select("token", F.coalesce("_c", F.lit(False)).alias("is_core"))


def _fixed(vocab: DataFrame) -> Column:
    return F.coalesce("is_fixed", F.lit(False)) if "is_fixed" in vocab.columns else F.lit(False)


def prune_vocab(vocab: DataFrame, thre: float | None = None, unigram_total: int | None = None) -> DataFrame:
    """Sets theta: unknown to ``thre``, fixed to 1, characters at least ``thre``, others below it to 0."""
    if thre is None:
        if unigram_total is None:
            raise ValueError("pruning needs a threshold or the corpus size")
        thre = 0.5 / unigram_total
    theta = F.col("theta")
    kept = F.when(F.col("token") == UNK, thre).when(_fixed(vocab), 1.0).when(F.length("token") == 1, F.greatest(theta, F.lit(thre))).when(theta < thre, 0.0).otherwise(theta)
    return vocab.withColumn("theta", kept)


def shrink_vocab(vocab: DataFrame, size: int, hard_limit: bool = True, keep_char: bool = False, seed: int = 0) -> DataFrame:
    """Down to ``size`` tokens by theta. Unknown, fixed and (if wished) single characters are exempt.

    Soft: every token that ties with the last one stays. Hard: ties are broken by hash and the size is exact.
    """
    exempt = (F.col("token") == UNK) | _fixed(vocab) | (F.lit(keep_char) & (F.length("token") == 1))
    rows = vocab.withColumn("theta", F.col("theta") + 1e-30).withColumn("_x", exempt)
    n, free = rows.agg(F.count("*"), F.count_if(~F.col("_x"))).collect()[0]
    k = size - (n - free)
    if k < 0:
        raise ValueError(f"{n - free} tokens are exempt, more than {size}")
    others = rows.where(~F.col("_x"))
    if hard_limit:
        best = others.orderBy(F.desc("theta"), uniform_hash("token", seed=seed), "token").limit(k)
    else:
        last = others.orderBy(F.desc("theta")).limit(k).agg(F.min("theta").alias("_t"))
        best = others.join(F.broadcast(last)).where(F.col("theta") >= F.col("_t")).drop("_t")  # one row
    return rows.where("_x").unionByName(best).drop("_x")


def token_losses(vocab: DataFrame, second: DataFrame) -> DataFrame:
    """(token_id, loss): how much log-likelihood goes, a token of the corpus, if a token is cut up as ``second`` does.

    ``second(token, rank, pieces)``: the two best paths of the token's own string. A token whose best path is not itself
    has loss 0; one without another path has an infinite loss. Its probability moves to the pieces of its second path.
    """
    own = vocab.select("token_id", "token", "theta")
    first = second.where((F.col("rank") == 1) & (F.size("pieces") > 1)).select("token", F.lit(True).alias("_spare"))
    other = second.where("rank = 2").select("token", F.size("pieces").alias("_n"), F.explode("pieces").alias("_piece"))
    parts = other.join(own.select(F.col("token").alias("_piece"), F.col("theta").alias("_part")), "_piece").join(own.select("token", "theta"), "token")
    moved = parts.groupBy("token").agg(F.sum(F.log(F.col("_part") + F.col("theta"))).alias("_log"), F.first("_n").alias("_n"))
    rows = own.join(first, "token", "left").join(moved, "token", "left")
    loss = F.col("theta") * (F.log("theta") - F.col("_log") + F.col("_n") * F.log(1 + F.col("theta") * (F.col("_n") - 1)))
    return rows.select("token_id", F.when(F.col("_spare") | (F.col("theta") <= 0), 0.0).when(F.col("_n").isNull(), float("inf")).otherwise(loss).alias("loss"))


def shrink_vocab_by_loss(vocab: DataFrame, losses: DataFrame, size: int, keep_char: bool = True, seed: int = 0) -> DataFrame:
    """Down to ``size`` tokens by the loss of ``losses(token_id, loss)``, ties by hash; exempt as in shrink_vocab."""
    ranked = vocab.join(losses, "token_id").withColumn("_theta", F.col("theta")).withColumn("theta", F.col("loss")).drop("loss")
    kept = shrink_vocab(ranked, size, True, keep_char, seed)
    return kept.withColumn("theta", F.col("_theta") + 1e-30).drop("_theta")


def shrink_vocab_by_total(vocab: DataFrame, size: int) -> DataFrame:
    """The older variant: a threshold from the ranks of all thetas, then prune_vocab."""
    k = size - vocab.where(F.length("token") == 1).count()
    if k < 0:
        raise ValueError("fewer places than characters")
    top = [r[0] for r in vocab.select("theta").orderBy(F.desc("theta")).limit(k + 2).collect()]  # thetas only
    if k >= len(top):
        return prune_vocab(vocab, 0.0)
    thre = top[k]
    if k + 1 < len(top) and top[k + 1] == thre:
        above = vocab.where(F.col("theta") > thre).agg(F.min("theta")).collect()[0][0]
        thre = thre if above is None else above
    return prune_vocab(vocab, thre)


def reindex(vocab: DataFrame) -> DataFrame:
    """Drops tokens with theta 0 and closes the ids up in their old order."""
    kept = vocab.where("theta > 0")
    rest = [c for c in kept.columns if c != "token_id"]
    return index_vocab(kept.withColumnRenamed("token_id", "_old"), "_old").select("token_id", *rest)


def ids_by_length(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy(F.length("token").alias("len")).agg(F.sort_array(F.collect_set("token_id")).alias("ids"))


def many_hot(vocab: DataFrame) -> DataFrame:
    """(len, token_id) pairs: the non-zero cells of the length indicator matrix."""
    return vocab.select(F.length("token").alias("len"), "token_id")


def character_vocab(vocab: DataFrame) -> DataFrame:
    """(char_id, ch): the tokens of length one, in order."""
    chars = vocab.where(F.length("token") == 1).select(F.col("token").alias("ch")).distinct()
    return index_vocab(chars, "ch").withColumnRenamed("token_id", "char_id")


def token_char_ids(vocab: DataFrame, max_length: int) -> DataFrame:
    """(token_id, char_ids): each token's characters as ids, filled up with -1; -1 also for unknown ones."""
    spelt = vocab.select("token_id", F.posexplode(F.filter(F.split("token", ""), lambda c: c != "")).alias("i", "ch"))
    ids = spelt.join(character_vocab(vocab), "ch", "left").groupBy("token_id").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("char_id", F.lit(-1)).alias("c")))).alias("a"))
    fill = F.array_repeat(F.lit(-1), F.greatest(F.lit(0), F.lit(max_length) - F.size("a")))
    return ids.select("token_id", F.concat(F.col("a.c"), fill).alias("char_ids"))


def char_token_ids(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.length("token") == 1).select("token_id")


def vocab_diff(vocab: DataFrame, other: DataFrame) -> DataFrame:
    return vocab.select("token").join(other.select("token").distinct(), "token", "left_anti")


def scores_in_order(original: DataFrame, model: DataFrame) -> DataFrame:
    """(pos, token, score): ln(theta) in the original order; tokens that the model lacks get the unknown token's."""
    scores = model.where("theta > 0").select("token", F.log("theta").alias("score"))
    unk = scores.where(F.col("token") == UNK).agg(F.max("score").alias("_unk"))
    return original.select("pos", "token").join(scores, "token", "left").join(F.broadcast(unk)).select("pos", "token", F.coalesce("score", "_unk").alias("score"))  # one row


def rename_special(vocab: DataFrame, suffix: str) -> DataFrame:
    """Special pieces ``<x>`` become ``<x|suffix>``."""
    t = F.col("token")
    special = F.col("piece_type").isin(UNKNOWN, CONTROL, USER_DEFINED, UNUSED) & F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">"))
    return vocab.withColumn("token", F.when(special, F.concat(F.left(t, F.length(t) - 1), F.lit(f"|{suffix}"), F.right(t, F.lit(1)))).otherwise(t))


def special_rows(spark: SparkSession) -> DataFrame:
    """(pos, token, score 0): specials, runs of head marks from long to short, newline, byte tokens."""
    n, runs = len(SPECIALS), LONGEST_RUN
    i = F.col("id")
    token = (
        F.when(i < n, F.get(F.array(*[F.lit(s) for s in SPECIALS]), i.cast("int")))
        .when(i < n + runs, F.expr(f"repeat('{HEAD}', cast({n + runs} - id as int))"))
        .when(i == n + runs, F.lit("\n"))
        .otherwise(F.format_string("<0x%02X>", i - (n + runs + 1)))
    )
    return spark.range(n + runs + 1 + 256).select(i.cast("int").alias("pos"), token.alias("token"), F.lit(0.0).alias("score"))


def vocab_sizes(vocab: DataFrame, variant: str = "variant") -> DataFrame:
    return vocab.groupBy(variant).agg(F.countDistinct("token").alias("size"))


def tempered(vocab: DataFrame, lam: float) -> DataFrame:
    """theta to the power of ``lam``, normalised again."""
    return normalized(vocab, F.pow("theta", F.lit(lam)))


def ranked_ids(vocab: DataFrame, by: str = "theta") -> DataFrame:
    """``vocab`` with its rank by ``by``: for vocabulary-sized tables."""
    return vocab.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "token")))
