"""The prefix trie of conversations: every distinct sequence of first turns as a node, with its members and savings.

1. A turn becomes a digest and a length before anything is shuffled; a conversation is its array of turn digests in
   order. The digest of every prefix is chained from the one before (``chain``), so it names the node.
2. Equal conversations are one class (``classes``): partial sums per 4096 ids, then a stream of those, in which the
   ids are hashed in ascending order. Neither is larger in memory for a class that holds a third of all rows.
3. Classes are sorted by their chains over range partitions. In a partition (``Trie``) the common prefixes of neighbours
   are an LCP array with a sparse table of range minima. A row's candidates are the prefixes that the row before does not
   share; each candidate searches its left and its right end alone, by halving steps on the sparse table. Members,
   children, leaves and savings are then range sums over rows, or over nodes in pre-order. There is no stack.
4. Only prefixes of a partition's first or last class can reach into others. Their parts, at most two conversations a
   partition, are put together in one task (``merge_open``), and named to the nodes that hang below them by a join.

Memory: a partition's chains (16 bytes a turn), and one conversation's digests. Texts are read once and not shuffled.

Defined cases: rows without conv_id belong to no conversation; null turns come first; null roles and texts are empty;
turns with equal numbers follow the order of their digests; repeated rows are turns of their own; an empty table has no
node, not even the root; of the input only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import crc32_sql, cut_lineage

ROOT = b""
TURNS = "array<struct<turn:bigint,digest:binary,n:int>>"
CHUNK_BITS = 12  # ids of one partial list
BASE_EVERY, MOST_BASE_TURNS = 100, 5
CHAIN = "conv_id long, key binary, chain array<binary>, sizes array<int>"
CLASS = "chain array<binary>, sizes array<int>, weight long, least long, ends string"
NODE = "pid int, open boolean, key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_chars long, ends string"
NODE_TYPES = {"pid": pa.int32(), "open": pa.bool_(), "key": pa.binary(), "parent": pa.binary(), "ends": pa.string()}
NODE_NAMES = [part.split()[0] for part in NODE.split(", ")]


# --- conversations to classes ------------------------------------------------------------------


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the digests and lengths of a conversation's turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.length(text).cast("int").alias("n"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "n"))).alias("turns"))


def with_base_turns(own: DataFrame) -> DataFrame:
    """``own`` where the first turns of a conversation, by a hash of its id none to five, are those of its hundred's."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % (MOST_BASE_TURNS + 1)).cast("int")
    base = own.where(c % BASE_EVERY == 0).select(c.alias("_base"), F.slice("turns", 1, MOST_BASE_TURNS).alias("_first"))
    joined = own.withColumn("_b", c - c % BASE_EVERY).join(base, F.col("_b") == F.col("_base"), "left")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select(c, F.concat(F.slice(F.coalesce("_first", F.array().cast(TURNS)), F.lit(1), h), rest).alias("turns"))


def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, digests, sizes) to (conv_id, key, chain, sizes): digest d of a chain is that of the first d + 1 turns."""
    for batch in batches:
        chains = []
        for turns in batch.column(1).to_pylist():
            last, chain = ROOT, []
            for turn in turns:
                last = hashlib.md5(last + turn, usedforsecurity=False).digest()
                chain.append(last)
            chains.append(chain)
        columns = [batch.column(0), pa.array([c[-1] if c else ROOT for c in chains], pa.binary()), pa.array(chains, pa.list_(pa.binary())), batch.column(2)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "key", "chain", "sizes"])


def joined_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids, sorted by class and chunk, to a row per class; a class's ids are hashed as they stream by."""
    key, row, sha, out = None, None, None, []

    def flush() -> pa.RecordBatch:
        names = ["chain", "sizes", "weight", "least", "ends"]
        kinds = [pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    for batch in batches:
        for own, ids, weight, least, chain, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                if row:
                    out.append([*row, sha.hexdigest()])
                if len(out) >= 4096:
                    yield flush()
                    out.clear()
                key, row, sha = own, [chain, sizes, 0, least], hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
            row[2] += weight
    if row:
        out.append([*row, sha.hexdigest()])
    yield flush()


def classes(conversations: DataFrame) -> DataFrame:
    """(chain, sizes, weight, least, ends) of ``conversations(conv_id, turns)``: a row per distinct sequence of turns, with
    how many conversations are equal to it, the smallest, and the digest of all their ids."""
    rows = conversations.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.n").alias("sizes")).mapInArrow(chained, CHAIN)
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = rows.groupBy("key", chunk).agg(ids.alias("ids"), F.count("*").alias("weight"), F.min("conv_id").alias("least"), F.first("chain").alias("chain"), F.first("sizes").alias("sizes"))
    sorted_ = parts.repartition("key").sortWithinPartitions("key", "chunk")
    return sorted_.select("key", "ids", "weight", "least", "chain", "sizes").mapInArrow(joined_ids, CLASS)


# --- the trie of a sorted partition ------------------------------------------------------------


class SparseTable:
    """Minima of any range of an array, from minima of all ranges of 2**k."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            last, half = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minima of [low, high], which are not empty."""
        k = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), dtype=self.rows[0].dtype)
        for level, row in enumerate(self.rows):
            own = k == level
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << level) + 1])
        return out


class Trie:
    """The nodes of sorted classes, in pre-order. ``row``: the first class with a node's prefix; ``last``: the last one."""

    def __init__(self, chains: list[list[bytes]]) -> None:
        self.length = np.array(list(map(len, chains)), dtype=np.int64)
        start = np.cumsum(self.length) - self.length
        digests = np.frombuffer(b"".join(d for c in chains for d in c), dtype=np.uint64).reshape(-1, 2)
        m = len(chains)
        both = np.minimum(self.length[:-1], self.length[1:])
        owner = np.repeat(np.arange(m - 1), both)
        depth = np.arange(len(owner)) - np.repeat(np.cumsum(both) - both, both)
        equal = (digests[start[owner] + depth] == digests[start[owner + 1] + depth]).all(axis=1)
        self.lcp = np.bincount(owner, weights=equal, minlength=m - 1).astype(np.int64)[: m - 1]
        self.table = SparseTable(self.lcp)
        shared = np.r_[-1, self.lcp]  # the root begins at the first class
        own = self.length - shared
        self.first = np.r_[0, np.cumsum(own)]  # of each class, its first node
        self.row = np.repeat(np.arange(m), own)
        self.depth = np.arange(len(self.row)) - self.first[self.row] + shared[self.row] + 1
        self.shared = shared
        self.last = self.right_end(self.row, self.depth)
        up = np.maximum(self.depth - 1, 0)
        above = self.left_end(self.row, up)  # the class at which the parent begins
        self.parent = self.first[above] + up - shared[above] - 1
        self.parent[0] = -1

    def right_end(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last class that shares the first ``depth`` turns of ``row``."""
        at = row.copy()
        for k in range(len(self.table.rows) - 1, -1, -1):
            minima = self.table.rows[k]
            inside = at < len(minima)
            go = np.zeros(len(at), dtype=bool)
            go[inside] = minima[at[inside]] >= depth[inside]
            at[go] += 1 << k
        return at

    def left_end(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first class that shares the first ``depth`` turns of ``row``."""
        at = row.copy()
        for k in range(len(self.table.rows) - 1, -1, -1):
            minima = self.table.rows[k]
            before = at - (1 << k)
            inside = (before >= 0) & (before < len(minima))
            go = np.zeros(len(at), dtype=bool)
            go[inside] = minima[before[inside]] >= depth[inside]
            at[go] = before[go]
        return at

    def below(self, value: np.ndarray) -> np.ndarray:
        """Sums over the nodes of each subtree: from a node to the last one of its last class."""
        sums = np.r_[0, np.cumsum(value)]
        return sums[self.first[self.last + 1]] - sums[: len(value)]


def partition_nodes(pid: int, rows: list[tuple]) -> dict[str, object]:
    """The columns of NODE for a partition's classes. Prefixes of the first or last class are open: their counts, children,
    leaves and savings are those of the partition's closed nodes, or its members."""
    chains, sizes, weight, least, ends = zip(*rows, strict=True)
    trie = Trie(list(chains))
    row, depth, last = trie.row, trie.depth, trie.last
    open_ = (row == 0) | (last == len(chains) - 1)
    members = np.r_[0, np.cumsum(np.array(weight, dtype=np.int64))]
    n_convs = members[last + 1] - members[row]
    n_chars = np.array([sizes[r][d - 1] if d else 0 for r, d in zip(row.tolist(), depth.tolist(), strict=True)], dtype=np.int64)
    leaf = ~open_ & (row == last) & (depth == trie.length[row])
    child = np.bincount(trie.parent[~open_], minlength=len(row))
    conv_id = SparseTable(np.array(least, dtype=np.int64)).least(row, last)
    names = [chains[r][d - 1] if d else ROOT for r, d in zip(row.tolist(), depth.tolist(), strict=True)]
    known = ~open_ & ~open_[trie.parent]
    return {
        "pid": np.full(len(row), pid),
        "open": open_,
        "key": names,
        "parent": [names[p] if p >= 0 else None for p in trie.parent.tolist()],
        "conv_id": conv_id,
        "depth": depth,
        "parent_conv_id": pa.array(conv_id[trie.parent], mask=~known),
        "n_convs": n_convs,
        "n_children": child,
        "n_leaves": trie.below(leaf.astype(np.int64)),
        "saved_tokens": trie.below(np.where(open_, 0, (n_convs - 1) * n_chars)),
        "n_chars": n_chars,
        "ends": [ends[r] if n == d else None for r, n, d in zip(row.tolist(), trie.length[row].tolist(), depth.tolist(), strict=True)],
    }


def node_batch(columns: dict[str, object]) -> pa.RecordBatch:
    arrays = [columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], NODE_TYPES.get(name, pa.int64())) for name in NODE_NAMES]
    return pa.RecordBatch.from_arrays(arrays, names=NODE_NAMES)


def nodes_job(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    if rows:
        yield node_batch(partition_nodes(TaskContext.get().partitionId(), rows))


def merge_open(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of open nodes to whole nodes; a row for each part, so that its partition can look it up by ``pid``."""
    parts: dict[bytes, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            parts.setdefault(r["key"], []).append(r)
    whole = {}
    for key, own in parts.items():
        total = {c: sum(r[c] for r in own) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
        some = {c: own[0][c] for c in ("key", "parent", "depth", "n_chars")}
        whole[key] = some | total | {"conv_id": min(r["conv_id"] for r in own), "ends": next((r["ends"] for r in own if r["ends"]), None)}
    deepest = sorted(whole.values(), key=lambda r: -r["depth"])
    added = {key: [0, 0] for key in whole}  # leaves and savings of the open nodes of a subtree
    for r in deepest:
        if r["parent"] is not None:
            whole[r["parent"]]["n_children"] += 1
    for r in deepest:
        own = added[r["key"]]
        own[0] += not r["n_children"]
        own[1] += (r["n_convs"] - 1) * r["n_chars"]
        if r["parent"] is not None:
            up = added[r["parent"]]
            up[0], up[1] = up[0] + own[0], up[1] + own[1]
    out = []
    for key, own in parts.items():
        r = whole[key]
        r |= {"n_leaves": r["n_leaves"] + added[key][0], "saved_tokens": r["saved_tokens"] + added[key][1]}
        r["parent_conv_id"] = None if r["parent"] is None else whole[r["parent"]]["conv_id"]
        out += [r | {"pid": p["pid"], "open": k == 0} for k, p in enumerate(own)]
    if out:
        yield node_batch({name: [r[name] for r in out] for name in NODE_NAMES})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of ``conversations(conv_id, turns)``, whose turns have ``digest`` and ``n``: (key, parent, conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = classes(conversations).repartitionByRange(parts, "chain").sortWithinPartitions("chain")
    nodes = cut_lineage(sorted_.mapInArrow(nodes_job, NODE))  # read twice, and range partitions are drawn by sampling
    merged = cut_lineage(nodes.where("open").repartition(1).mapInArrow(merge_open, NODE))  # two conversations a partition
    closed = nodes.where(~F.col("open"))
    above = merged.select(F.col("pid").alias("_pid"), F.col("key").alias("_key"), F.col("conv_id").alias("_conv"))
    hanging = closed.where("parent_conv_id is null").join(above, (F.col("pid") == F.col("_pid")) & (F.col("parent") == F.col("_key")))
    named = hanging.withColumn("parent_conv_id", F.col("_conv")).select(*nodes.columns)
    out = merged.where("open").union(closed.where("parent_conv_id is not null")).union(named)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))


def op13_prefix_trie(conversations: DataFrame) -> DataFrame:
    own = cut_lineage(turn_arrays(conversations))
    return prefix_trie(with_base_turns(own)).drop("key", "parent")


def oracle() -> str:
    """DuckDB SQL: every prefix as a list, its members by grouping, its subtree by joining nodes with all their prefixes."""
    return f"""
WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
b AS (SELECT c.conv_id, c.t, coalesce(b.t, []) AS base, {crc32_sql("CAST(c.conv_id AS VARCHAR)")} % 6 AS h FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
r AS (SELECT conv_id, list_concat(base[1:h], t[h + 1:len(t)]) AS t FROM b),
p AS (SELECT conv_id, len(t) = d AS whole, d, t[1:d] AS k FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(length(any_value(k)[d].text), 0) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (whole), '')) AS ends FROM p GROUP BY k, d),
f AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
e AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (k)),
s AS (SELECT k[1:a] AS k, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum((n - 1) * chars) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM e) GROUP BY 1)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, e.n AS n_convs, e.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, e.ends AS ends_sha256
FROM e JOIN s USING (k) LEFT JOIN e u ON u.k = e.k[1:e.d - 1] AND u.d = e.d - 1"""
