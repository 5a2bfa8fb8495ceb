"""Chat formatting, periodic runs and prefix tries against brute force, with the defined cases of each."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexiforge.llm import chats, runs, tries

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
MESSAGES = "tree_id long, message_id long, parent_id long, role string, text string, score double"
CONVERSATIONS = "conv_id long, turn long, role string, text string, formatted string, key string"


# --- periodic runs -----------------------------------------------------------------------------


def plain_runs(words, least=12):
    """All (start, length, period): every maximal stretch of every period, kept for its smallest period."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(least, 2 * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


def random_words(rng):
    n, letters = rng.choice([0, 1, 2, 5, 11, 12, 13, 24, 60, 150]), rng.choice([1, 2, 3, 8])
    words = [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        p, s = rng.randint(1, max(1, n // 2)), rng.randrange(n)
        for i in range(max(s, p), rng.randint(s, n)):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [random_words(rng) for _ in range(rng.randint(1, 12))]
        for words, (rows, kept) in zip(texts, runs.runs_of(texts), strict=True):
            want = plain_runs(words)
            assert [tuple(r) for r in rows.tolist()] == want
            assert kept == plain_collapsed(words, want)


def test_a_period_inside_a_longer_one():
    words = (b"a b a b a b a " * 2).split() * 1
    (rows, _), *_ = runs.runs_of([words])
    assert [tuple(r) for r in rows.tolist()] == plain_runs(words) == [(0, 14, 7)]


def test_range_successor():
    rng = random.Random(5)
    values = list(range(300))
    rng.shuffle(values)
    import numpy as np

    tree = runs.Wavelet(np.array(values, dtype=np.int32))
    asked = [(lo, rng.randint(lo, 300), rng.randrange(302)) for lo in (rng.randrange(300) for _ in range(400))]
    low, high, bound = (np.array(x, dtype=np.int32) for x in zip(*asked, strict=True))
    assert tree.successor(low, high, bound).tolist() == [min((v for v in values[a:b] if v >= c), default=300) for a, b, c in asked]


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query_and_defined_cases(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a " * 40, "x y " * 30000, "é 漢 " * 20, *(" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 400))) for _ in range(60))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, texts[7], None), (None, "b " * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = sorted(([r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256] for r in runs.op12_periodic_runs(docs).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        words = planted(doc_id, text)
        found = plain_runs(words) if len(words) < 5000 else [(0, len(words), 2 if doc_id == 5 else 1)]
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want.append([doc_id, len(found), s, n, q, 1000 * n // q if q else None, SHA(lines), SHA(b" ".join(plain_collapsed(words, found)).decode())])
    assert got == sorted(want, key=repr)
    assert runs.op12_periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at least"):
        runs.periodic_runs(docs, 5)


def test_runs_against_duckdb(spark, sf, against_duckdb):
    against_duckdb(runs.op12_periodic_runs(spark.read.parquet(f"{sf}/documents.parquet")).drop("exponent_milli", "start", "length", "period"), f"SELECT * EXCLUDE (exponent_milli, start, length, period) FROM ({runs.oracle()})", sf)


# --- prefix tries ------------------------------------------------------------------------------


def rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: tuple(t[2] for t in sorted(v)) for c, v in turns.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, ())[:h] + t[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    kids = {k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k] for k in members}
    out = []
    for k, ids in members.items():
        sub = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        ends = ",".join(str(c) for c in sorted(c for c in ids if convs[c] == k))
        out.append([min(ids), len(k), min(members[k[:-1]]) if k else None, len(ids), len(kids[k]), sum(not kids[x] for x in sub), saved, SHA(ends)])
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_trie_query_equals_brute_force(spark, parts):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é漢"])) for c in [*range(130), 250, 300, 301] for t in range(rng.choice([1, 1, 2, 3, 4, 7, 20]))]
    rows += [(400, None, "user", "null turn"), (400, 0, "user", "x"), (None, 0, "user", "no id"), (401, 0, "user", "long " * 5000)]
    rows += [(c, t, "user", "hot") for c in range(500, 900) for t in range(3)]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], CONVERSATIONS).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((list(r) for r in tries.op13_prefix_trie(table).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_trie(rebuilt(rows))


def test_trie_repeats_and_empty_tables(spark):
    rows = [(0, 0, "user", "a"), (0, 0, "user", "a"), (7, 0, "user", "a")]
    table = spark.createDataFrame([(*r, None, None) for r in rows], CONVERSATIONS)
    got = sorted((list(r) for r in tries.op13_prefix_trie(table).collect()), key=repr)
    assert got == plain_trie(rebuilt(rows))
    assert tries.op13_prefix_trie(table.limit(0)).count() == 0


def test_trie_against_duckdb(spark, sf, against_duckdb):
    against_duckdb(tries.op13_prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet")).drop("parent_conv_id"), f"SELECT * EXCLUDE (parent_conv_id) FROM ({tries.oracle()})", sf)


# --- chats -------------------------------------------------------------------------------------

HARD = ["", "\n", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", r"<\|im_start|> <\\/s> \[INST\] [\INST]", "<<<SYS>>", "[[INST]", "\\", "\\n", r"a\\nb", "é漢😀 $1 \\1"]


def test_escapes_are_reversible(spark):
    rng = random.Random(6)
    parts = [*chats.CONTROLS, "<", "[", "\\", "/s>", "INST]", "|im_end|>", "n", "\n", "x"]
    texts = HARD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    c = F.col("s")
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", chats.escape(c).alias("e"), chats.unescape(chats.escape(c)).alias("u"), chats.escape_role(c).alias("r"), chats.unescape_role(chats.escape_role(c)).alias("v")).collect()
    for r in rows:
        assert r.u == r.s == r.v and "\n" not in r.r
        assert not any(control in x for control in chats.CONTROLS for x in (r.e, r.r))


def plain_paths(rows, width=None, keep=None):
    """(tree, leaf): the messages from the root, of the chosen leaves."""
    of = {(t, m): (p, role, text, score or 0.0) for t, m, p, role, text, score in rows}
    kept = set(of)
    if width is not None:
        for t in {t for t, _ in of}:
            for parent in {of[k][0] for k in of if k[0] == t} - {None}:
                kids = sorted((k for k in of if k[0] == t and of[k][0] == parent), key=lambda k: (-of[k][3], k[1]))
                kept -= set(kids[width:])
    out = {}
    for t, m in kept:
        if any(k[0] == t and of[k][0] == m for k in kept):
            continue
        path, at = [], m
        while at is not None and (t, at) in kept and len(path) <= len(of):
            path.append(at)
            at = of[t, at][0]
        if len(path) <= len(of) and not (at is not None and (t, at) in of):
            out[t, m] = path[::-1]
    if keep is not None:
        mean = lambda k: sum(of[k[0], m][3] for m in out[k]) / len(out[k])
        for t in {t for t, _ in out}:
            for k in sorted((k for k in out if k[0] == t), key=lambda k: (-mean(k), k[1]))[keep:]:
                del out[k]
    return {k: [(of[k[0], m][1] or "", of[k[0], m][2] or "") for m in path] for k, path in out.items()}


def read_back(df):
    turns = chats.turns_of(F.col("formatted"))
    rows = df.withColumn("t", turns).withColumn("learned", chats.learned_texts(F.col("t"), F.col("mask"))).collect()
    for r in rows:  # the spans are those of the whole, too
        assert [r.formatted[m.start : m.start + m.length] for m in r.mask] == [r.t[m.turn].body[m.offset : m.offset + m.length] for m in r.mask]
        assert r.learned == [t.text for t in r.t if t.role == "assistant"]
    return {(r.tree_id, r.leaf): [(t.role, t.text) for t in r.t] for r in rows}


def random_trees(rng, trees, size):
    out = []
    for t in range(trees):
        for m in range(rng.randint(1, size)):
            parent = rng.choice([None, m - 1, m - 1, rng.randrange(max(m, 1))]) if m else None
            out.append((t, m, parent, rng.choice(["user", "assistant", "tool\nx", None]), rng.choice([*HARD, None]), rng.choice([None, 0.0, 0.5, 1.0, 2.0])))
    return out


@pytest.mark.parametrize(("width", "keep"), [(None, None), (1, None), (2, 2), (None, 1)])
def test_reply_trees_equal_brute_force(spark, width, keep):
    rows = random_trees(random.Random(8), 12, 40)
    rows += [(20, 0, 5, "user", "orphan", 1.0), (21, 1, 2, "user", "round", 1.0), (21, 2, 1, "user", "round", 1.0), (21, 3, 2, "user", "below", 9.0), (21, 4, None, "user", "whole", 0.0)]
    got = read_back(chats.format_trees(spark.createDataFrame(rows, MESSAGES).repartition(3), width, keep))
    assert got == plain_paths(rows, width, keep)


def test_deep_and_hot_trees(spark):
    """One tree holds nearly all messages; a path of 700 takes ten rounds."""
    rows = [(0, m, m - 1 if m else None, "user" if m % 2 else "assistant", str(m), 1.0) for m in range(700)] + [(t, 0, None, "user", "x", None) for t in range(1, 9)]
    messages = spark.createDataFrame(rows, MESSAGES)
    assert [r[0] for r in chats.hot_trees(messages).collect()] == [0]
    assert read_back(chats.format_trees(messages)) == plain_paths(rows)


def test_messages_with_equal_ids(spark):
    rows = [(0, 1, None, "user", "b", 0.0), (0, 1, None, "user", "a", 0.0), (0, 1, None, "user", "a", 0.0), (0, None, None, "user", "no id", 0.0), (None, 1, None, "user", "no tree", 0.0)]
    got = read_back(chats.format_trees(spark.createDataFrame(rows, MESSAGES)))
    assert got == {(0, 1): [("user", "a")], (None, 1): [("user", "no tree")]}


def test_chat_query_and_defined_cases(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([*HARD, None])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(40, None, "user", "null turn"), (40, 0, "assistant", "b"), (41, 0, "assistant", "long " * 30000), (42, 0, "user", "same"), (42, 0, "user", "same"), (None, 0, "user", "no id")]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], CONVERSATIONS).repartition(5)
    want = {}
    for c, turn, role, text in [*rows, (-1, 0, "user", chats.PLANTED), (-1, 1, "assistant", chats.PLANTED)]:
        want.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    got = chats.op11_chat_format(table).collect()
    assert len(got) == len(want)
    for r in got:
        turns = sorted(want[r.conv_id])
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), SHA("".join(f"{t[2]}\n{t[3]}\n" for t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), SHA(learned))
    assert [r.conv_id for r in chats.op11_chat_format(table.limit(0)).collect()] == [-1]


def test_chat_against_duckdb(spark, sf, against_duckdb):
    against_duckdb(chats.op11_chat_format(spark.read.parquet(f"{sf}/conversations.parquet")), chats.oracle(), sf)
