"""Chat formatting from reply trees: paths from roots to leaves, branches by score, one conversation for each path.

Built of DataFrame operations only; no Python runs on the rows.

1. ``Ancestors``: the reply links joined with themselves. Round k pairs every message with its ancestor 2**k above and the
   scores in between, so a tree of depth n takes log2(n) rounds, and only messages that have such an ancestor are left in
   a round. Rounds are tables in the shared folder; texts take no part.
2. ``leaf_paths``: leaves find depth and score by jumps, from the longest to the shortest. ``best_branches`` keeps the best
   replies of each message before that, ``best_paths`` the best leaves of each tree (partial top-k before the shuffle).
3. ``path_messages``: the chosen leaves' messages by the same jumps; a round takes up only rows that have an ancestor that
   far, so all rounds together make as many rows as the paths have messages.
4. ``format_paths``: texts meet their paths by tree, in one shuffle; the trees that are large for a partition are few by
   their definition and go by joins on the message. Turns are escaped and put together by position, the loss mask is a
   list of spans.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message. A control string of CONTROLS inside a text or role gets
a backslash behind its first character, and one more if it has some there already, so unescaping is exact; line feeds and
backslashes of a role are escaped too, as the role ends at a line feed.

Defined cases: null roles and texts are empty; null scores are 0; a reply to a message that is not in its tree begins a
path of its own; messages on or below a cycle of replies have no root and are left out; null tree ids are one tree, rows
with a null message id are left out; of rows with equal ids the first by parent, role, text and score counts, so repeated
rows count once; equal scores are ordered by id; an empty table gives no rows; further columns are not read. The query
numbers the rows of a conversation, so there repeated rows are turns of their own, and null turns come first.
Message ids are compared as they are, of any type. A path is one row, so its text must fit one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common public templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED_ROLE = "assistant"
SMALL_ROUND = 20_000  # rows; a larger round is not broadcast
PLANTED = "</s>[INST] ok [/INST]"

_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
ESCAPABLE, ESCAPED = rf"([<\[])(\\*)({_REST})", rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Pairs of backslashes are cut out first, so that an escaped one is not read with the letter behind it."""
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\", -1), lambda s: F.replace(s, F.lit("\\n"), F.lit("\n"))), "\\")


# --- paths -------------------------------------------------------------------------------------


def same_message(left: DataFrame, right: DataFrame, a: str, b: str) -> Column:
    return left["tree_id"].eqNullSafe(right["_tree"]) & (left[a] == right[b])


def by_id(links: DataFrame, message: str, **others: str) -> DataFrame:
    """``links`` as the right side of a join, with names of its own."""
    return links.select(F.col("tree_id").alias("_tree"), F.col(message).alias("_id"), *[F.col(c).alias(name) for name, c in others.items()])


def once(messages: DataFrame) -> DataFrame:
    """(tree_id, message_id, parent_id, role, text, score): one row of each id, nulls filled in."""
    filled = messages.where("message_id is not null").select("tree_id", "message_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    first = F.min(F.struct("parent_id", "role", "text", "score"))
    return filled.groupBy("tree_id", "message_id").agg(first.alias("m")).select("tree_id", "message_id", "m.*")


def best_branches(links: DataFrame, width: int) -> DataFrame:
    """The ``width`` best replies of each message by score, then id. Roots stay; a reply to a message that is not in its tree
    becomes one, so that it differs from what loses its parent here."""
    ids = by_id(links, "message_id")
    links = links.join(ids, same_message(links, ids, "parent_id", "_id"), "left").select("tree_id", "message_id", F.col("_id").alias("parent_id"), "score")
    links = stored(links)
    by = Window.partitionBy("tree_id", "parent_id").orderBy(F.desc("score"), "message_id")
    replies = links.where("parent_id is not null").withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= width).drop("_r")
    return links.where("parent_id is null").unionByName(replies)


class Ancestors:
    """``rounds[k]``: (tree_id, message_id, up, score) with the ancestor 2**k above and the scores from the message's parent
    to that one. ``circular``: some messages lie on or below a cycle; they have ancestors in every round."""

    def __init__(self, links: DataFrame) -> None:
        """``links(tree_id, message_id, parent_id, score)``, a table that may be read often."""
        parents = by_id(links, "message_id", _score="score")
        first = links.select("tree_id", "message_id", F.col("parent_id").alias("up")).where("up is not null")
        rounds = [stored(first.join(parents, same_message(first, parents, "up", "_id")).select("tree_id", "message_id", "up", F.col("_score").alias("score")))]
        sizes = [rounds[0].count()]
        self.circular = False
        while sizes[-1] and not self.circular:
            last = rounds[-1]
            above = by_id(last, "message_id", _up="up", _score="score")
            rounds.append(stored(last.join(above, same_message(last, above, "up", "_id")).select("tree_id", "message_id", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"))))
            sizes.append(rounds[-1].count())
            # in a forest the messages of a round at exactly its depth are not in the next one
            self.circular = sizes[-1] == sizes[-2]
        self.rounds = [F.broadcast(r) if n <= SMALL_ROUND else r for r, n in zip(rounds, sizes, strict=True) if n]


def leaf_paths(links: DataFrame, above: Ancestors, pruned: bool = False) -> DataFrame:
    """(tree_id, leaf, depth, score): a path for every message without reply; the score is the mean of its messages'.
    ``pruned``: a message whose parent is gone belongs to a branch that was cut off."""
    at = links.select("tree_id", F.col("message_id").alias("leaf"), F.col("message_id").alias("at"), F.lit(0).cast("long").alias("depth"), F.col("score").cast("double").alias("score"))
    for k, jumps in reversed(list(enumerate(above.rounds))):
        if k == len(above.rounds) - 1:
            replied = by_id(above.rounds[0], "up")
            at = at.join(replied, same_message(at, replied, "leaf", "_id"), "left_anti")
        up = by_id(jumps, "message_id", _up="up", _score="score")
        joined = at.join(up, same_message(at, up, "at", "_id"), "left")
        gone = F.col("_up").isNotNull()
        at = joined.select("tree_id", "leaf", F.coalesce("_up", "at").alias("at"), (F.col("depth") + F.when(gone, 1 << k).otherwise(0)).alias("depth"), (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"))
    if above.circular:  # what still has an ancestor has no root
        rest = by_id(above.rounds[0], "message_id")
        at = at.join(rest, same_message(at, rest, "at", "_id"), "left_anti")
    if pruned:
        replies, linked = links.where("parent_id is not null"), by_id(above.rounds[0], "message_id") if above.rounds else None
        lost = by_id(replies if linked is None else replies.join(linked, same_message(replies, linked, "message_id", "_id"), "left_anti"), "message_id")
        at = at.join(lost, same_message(at, lost, "at", "_id"), "left_anti")
    return at.select("tree_id", "leaf", "depth", (F.col("score") / (F.col("depth") + 1)).alias("score"))


def best_paths(paths: DataFrame, keep: int) -> DataFrame:
    by = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf")
    return paths.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= keep).drop("_r")


def path_messages(paths: DataFrame, above: Ancestors) -> DataFrame:
    """(tree_id, leaf, position, message_id): the messages of the paths, the root at position 0.

    From the longest jumps to the shortest; a path enters at the first jump that fits into it.
    """
    start = paths.select("tree_id", "leaf", F.col("depth").alias("position"), F.col("leaf").alias("message_id"))
    rows = start.where("position < 0")
    for k, jumps in reversed(list(enumerate(above.rounds))):
        entering = start.where((F.col("position") >= (1 << k)) & ((F.col("position") < (2 << k)) if k < len(above.rounds) - 1 else F.lit(True)))
        rows = stored(rows.union(entering)) if k else rows.union(entering)
        far, up = rows.where(F.col("position") >= (1 << k)), by_id(jumps, "message_id", _up="up")
        higher = far.join(up, same_message(far, up, "message_id", "_id"))
        rows = rows.union(higher.select("tree_id", "leaf", (F.col("position") - (1 << k)).alias("position"), F.col("_up").alias("message_id")))
    return rows.union(start.where("position = 0"))


# --- formatting --------------------------------------------------------------------------------


def hot_trees(links: DataFrame) -> DataFrame:
    """(tree_id) of the trees with more than a quarter of a partition's share of all messages: at most four a partition."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return links.groupBy("tree_id").agg(F.count("*").alias("_n")).where(F.col("_n") > links.count() / (4 * parts)).select(F.col("tree_id").alias("_tree"))


def with_texts(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """``rows`` with role and text, of trees that each fit a partition: both are dealt by tree once, and each message hands
    its text to its paths there, so texts move once. Equal rows of a message are turns that follow each other."""
    none = F.lit(None)
    texts = messages.select("tree_id", "message_id", none.cast(dict(rows.dtypes)["leaf"]).alias("leaf"), none.cast("long").alias("position"), "role", "text").repartition("tree_id")
    wanted = rows.select("tree_id", "message_id", "leaf", "position", none.cast("string").alias("role"), none.cast("string").alias("text")).repartition("tree_id")
    own = Window.partitionBy("tree_id", "message_id").orderBy(F.asc_nulls_first("position")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = texts.unionByName(wanted).select("*", F.first(F.struct("role", "text")).over(own).alias("_m"), F.count_if(F.col("position").isNull()).over(own).alias("_copies")).where("position is not null and _copies > 0")
    return found.select("tree_id", "leaf", "position", "_m.role", "_m.text", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("copy"))


def with_texts_of_hot(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """The same for trees of any size: texts are joined by message."""
    own = messages.select(F.col("tree_id").alias("_tree"), F.col("message_id").alias("_id"), "role", "text")
    return rows.join(own, same_message(rows, own, "message_id", "_id")).select("tree_id", "leaf", "position", "role", "text", F.lit(1).cast("long").alias("copy"))


def formatted(named: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """(tree_id, leaf, formatted, mask) of ``named(tree_id, leaf, position, role, text, copy)``: the messages of each path in
    the template, and the spans of the texts to learn as (turn, start, length, offset) in code points: ``start`` in the whole,
    ``offset`` in the turn behind its start mark."""
    head, body = F.concat(escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    turns = named.select("tree_id", "leaf", "position", "copy", (F.col("role") == learned).alias("learned"), F.length(head).alias("offset"), F.length(body).alias("length"), F.concat(F.lit(START), head, body, F.lit(END + "\n")).alias("turn"))
    by = Window.partitionBy("tree_id", "leaf").orderBy("position", "copy")
    before = F.coalesce(F.sum(F.length("turn").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.withColumn("start", before + len(START) + F.col("offset")).withColumn("no", F.row_number().over(by))
    parts = placed.groupBy("tree_id", "leaf").agg(F.sort_array(F.collect_list(F.struct("no", "turn", "learned", "start", "length", "offset"))).alias("t"))
    span = lambda t: F.struct((t["no"] - 1).alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["offset"].alias("offset"))
    return parts.select("tree_id", "leaf", F.array_join("t.turn", "").alias("formatted"), F.transform(F.filter("t", lambda t: t["learned"]), span).alias("mask"))


def format_paths(rows: DataFrame, messages: DataFrame, links: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    hot = stored(hot_trees(links))
    if hot.isEmpty():
        return formatted(with_texts(rows, messages), learned)
    hot, rows = F.broadcast(hot), stored(rows)
    of = lambda df, how: df.join(hot, df["tree_id"].eqNullSafe(hot["_tree"]), how)
    large = formatted(with_texts_of_hot(of(rows, "left_semi"), of(messages, "left_semi")), learned)
    return large.union(formatted(with_texts(of(rows, "left_anti"), of(messages, "left_anti")), learned))


def turns_of(formatted: Column) -> Column:
    """The turns read back: an array of (role, text, body), ``body`` as it stands behind the start mark."""
    pieces = F.filter(F.split(formatted, re.escape(START)), lambda s: s != "")
    head = lambda s: F.locate("\n", s)
    role = lambda s: unescape_role(F.substring_index(s, "\n", 1))
    text = lambda s: unescape(F.substring(s, head(s) + 1, F.length(s) - head(s) - len(END) - 1))
    return F.transform(pieces, lambda s: F.struct(role(s).alias("role"), text(s).alias("text"), s.alias("body")))


def learned_texts(turns: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped."""
    return F.transform(mask, lambda m: unescape(F.substring(F.get(turns, m["turn"].cast("int"))["body"], m["offset"] + 1, m["length"])))


def format_trees(messages: DataFrame, width: int | None = None, keep: int | None = None, unique: bool = False) -> DataFrame:
    """(tree_id, leaf, formatted, mask) of ``messages(tree_id, message_id, parent_id, role, text, score)``: the paths of the
    ``keep`` best leaves of each tree (all, if None) over the ``width`` best replies of each message. ``unique``: ids are
    known to occur once and nulls are filled in."""
    rows = messages if unique else once(messages)
    links = rows.select("tree_id", "message_id", "parent_id", "score")
    links = stored((links.distinct() if unique else links) if width is None else best_branches(links, width))
    above = Ancestors(links)
    paths = leaf_paths(links, above, width is not None)
    if keep is not None:
        paths = best_paths(paths, keep)
    return format_paths(path_messages(stored(paths), above), rows, links)


# --- the query ---------------------------------------------------------------------------------


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as trees of one path: the message at each place replies to the one before. One more conversation, -1,
    says control strings. Turns with equal numbers follow the order of a hash of their role and text."""
    spark = conversations.sparkSession
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).union(planted)
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "_h")) - 1
    numbered = hashed.withColumn("message_id", place.cast("long"))
    parent = F.when(F.col("message_id") > 0, F.col("message_id") - 1)
    return numbered.select(F.col("conv_id").alias("tree_id"), "message_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op11_chat_format(conversations: DataFrame) -> DataFrame:
    out = format_trees(conversation_messages(conversations), unique=True).withColumn("_t", turns_of(F.col("formatted")))
    learned = F.array_join(learned_texts(F.col("_t"), F.col("mask")), "")
    lines = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = out.select(F.col("tree_id").alias("conv_id"), F.size("_t").cast("long").alias("n_turns"), lines.alias("_lines"), learned.alias("_learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select("conv_id", "n_turns", digest("_lines").alias("turns_sha256"), F.length("_learned").cast("long").alias("loss_chars"), digest("_learned").alias("loss_sha256"), "formatted_chars")


def oracle() -> str:
    """DuckDB SQL: sums and digests of the texts; the template's length is that of its marks and of the escaped texts."""
    pattern = ESCAPABLE.replace("'", "''")
    escaped = lambda c: rf"length(regexp_replace({c}, '{pattern}', '\1\\\2\3', 'g'))"
    role = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PLANTED}' FROM range(2) t(i)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST) AS lines,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = '{LEARNED_ROLE}'), '') AS learned,
  sum({len(START) + len(END) + 2} + {escaped(role)} + {escaped("text")}) AS n FROM r GROUP BY 1)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g"""
