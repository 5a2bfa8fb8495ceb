"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a given share or more, and their components.

1. One pass makes each document's set of hashed n-grams, its size and a 64-bit fingerprint. Equal sets are one
   class from here on, named by the fingerprint (a pre-aggregated group-by, so any number of copies is cheap).
2. Dealing to tasks. Sets that link differ in at most a known number of n-grams, so if the n-grams are dealt into one
   more part than that by a hash, some part is equal in both. Each class emits a hash per part (``part_signatures``);
   classes that share one are joined up, and the components of that are clusters. Every link lies in a cluster.
   Large clusters are split into blocks by ranges of set sizes, of which only neighbouring ones meet.
   A cluster's sets are then compared by sketches of a bit or so a token, the parities of their tokens by hash: two sets
   differ in at least as many tokens as their sketches do in bits, so what can't link is told apart without the texts,
   and only what is joined up by pairs that may link stays a cluster.
3. Signature trees. A cluster's sets, in blocks of bounded size, become the leaves of trees whose nodes hold the
   OR of the members' token bitmaps, their AND, and their size range. Two trees are walked together; a pair of
   nodes is left out when its largest possible overlap cannot reach the threshold. The sets of surviving leaf pairs
   are compared exactly; a class counts the documents that it links to, and a block reports a spanning forest.
4. The forests' components give each document the smallest doc_id that it reaches.

No pair table is built: a block sends at most two rows a member. Without counting (``count_links=False``) pairs whose
sets are linked up already are left out too.

Defined cases: a row is a document: rows with one doc_id and different texts are different documents, rows with a null
doc_id join others but name no component (null where a component has no other); null or blank texts have no n-gram,
size 0, no link, and are components of their own; fewer than ``gram`` words are one n-gram; repeated rows link; an empty
table gives no rows; of the input only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import cut_lineage
from lexiforge.llm.components import connected_components

GRAM = 3
PERCENT = 90
BITS = 2048
LEAF = 4
BLOCK_SETS = 8192
BLOCK_TOKENS = 2_000_000
SKETCH_SETS = 16_384
SKETCH_TOKENS = 64_000_000
SKETCH_BYTES = 8_000_000  # compared at once
FEW_PARTS = 12
CACHED_WORDS = 1_000_000
BITMAP_BITS = 32_768  # of one value of bitmap_construct_agg
MOST_BITMAPS = 1024  # 4 MB
BITS_A_KEY = 32

SIZES = "doc_id long, text_hash long, n_shingles long, node long, signatures array<long>, near array<long>, sketch binary"

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def scramble(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Shingles:
    """Hashed n-gram sets of texts; word hashes are kept from text to text."""

    def __init__(self, gram: int = GRAM) -> None:
        self.gram, self.known = gram, {}

    def of(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        short = len(words) < self.gram
        n = len(words) if short else self.gram
        out = scramble(h[: len(words) - n + 1], n if short else 0)
        for i in range(1, n):
            out = scramble(out ^ h[i : len(words) - n + 1 + i], i)
        return np.unique(out)


def fingerprint(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(scramble(scramble(tokens, 501).sum(dtype=np.uint64, keepdims=True), len(tokens)).view(np.int64)[0])


class Parts:
    """How sets are dealt into parts, for a threshold.

    Of two different sets that link, the smaller has n tokens and they differ in at most n * (100 - p) / p. Sizes form
    classes, each half as wide again as the one before; a set is dealt for its own class and, if a smaller set of the
    class below may link to it, for that one, so both sets are dealt for the class of the smaller, into a part more
    than their differences: some part has no difference.

    Empty parts say nothing and are left out. With few parts, a set that has empty ones is dealt again by another hash,
    until none is empty: at the first hash for which one of two sets has no empty part, the part without difference is
    not empty. With more parts, over a third of them has no difference; sets are dealt so often that all of these being
    empty is less likely than two equal 64-bit hashes.
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.smallest = -(-percent // (100 - percent))  # smaller sets link to equal ones only
        self.classes, low = [], self.smallest
        while low < 1 << 40:
            high = max(low, low * 3 // 2)
            parts = high * (100 - percent) // percent + 1
            # e^(-low / parts) is the share of empty parts, 0.37 that of parts without difference
            hashes = 0 if parts < FEW_PARTS else max(1, int(np.ceil(44.4 / (0.37 * low))))
            self.classes.append((high, parts, hashes))
            low = high + 1
        self.highs = np.array([c[0] for c in self.classes])

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if n < self.smallest:
            return np.zeros(0, dtype=np.int64)
        own = int(np.searchsorted(self.highs, n))
        out = []
        for c in (own, own - 1):
            high, parts, hashes = self.classes[c]
            if c < 0 or (c < own and self.percent * n > 100 * high):
                continue
            for seed in range(hashes or 64):
                mixed = scramble(tokens, seed + 1)
                part = (mixed >> np.uint64(16)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                sorted_ = part[order]
                first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                with np.errstate(over="ignore"):
                    sums = np.add.reduceat(scramble(mixed[order], 77), first)
                out.append(scramble(sums ^ scramble(sorted_[first], 1000 + 64 * c + seed)))
                if not hashes and len(first) == parts:
                    break
        return np.concatenate(out).view(np.int64)


# --- sketches ----------------------------------------------------------------------------------


def sketch(tokens: np.ndarray) -> bytes:
    """Whether an odd number of tokens has a hash, for 64 hashes or the next power of two from 3/4 of the tokens on."""
    bits = 1 << max(6, (3 * len(tokens) // 4 - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> bytes:
    """The sketch as it is with fewer hashes, of ``size`` bytes."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = (int.from_bytes(sketch[:half], "little") ^ int.from_bytes(sketch[half:], "little")).to_bytes(half, "little")
    return sketch


def sketch_forest(sizes: np.ndarray, sides: np.ndarray, sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may link; if ``sides`` has two values, of pairs with one of either."""
    order = np.argsort(sizes, kind="stable")
    n, side, label, cross = sizes[order], sides[order], np.arange(len(order)), len(np.unique(sides)) > 1
    ends, widths, edges = np.searchsorted(n, n * 100 // percent, side="right"), np.array([len(sketches[k]) for k in order.tolist()]), []
    for width in np.unique(widths).tolist():
        of = np.flatnonzero(widths == width)
        first, last = int(of[0]), int(ends[of[-1]])
        table = np.frombuffer(b"".join(folded(sketches[k], width) for k in order[first:last].tolist()), dtype=np.uint64).reshape(last - first, -1)
        for i in of.tolist():
            open_ = label[i + 1 : ends[i]] != label[i]
            if cross:
                open_ &= side[i + 1 : ends[i]] != side[i]
            others = np.flatnonzero(open_) + i + 1
            for at in range(0, len(others), max(1, SKETCH_BYTES // width)):
                some = others[at : at + max(1, SKETCH_BYTES // width)]
                # of linked sets of sizes a, b at most (100 - percent) * (a + b) / (100 + percent) tokens are in one only
                room = (n[i] + n[some]) * (100 - percent)
                half = max(1, table.shape[1] // 2)  # the first half tells most pairs apart
                near = np.flatnonzero(np.bitwise_count(table[some - first, :half] ^ table[i - first, :half]).sum(axis=1, dtype=np.int64) * (100 + percent) <= room)
                differ = np.bitwise_count(table[some[near] - first] ^ table[i - first]).sum(axis=1, dtype=np.int64)
                some = some[near][differ * (100 + percent) <= room[near]]
                labels, one = np.unique(label[some], return_index=True)
                for other, j in zip(labels.tolist(), some[one].tolist(), strict=True):
                    if other != label[i]:
                        label[label == other] = label[i]
                        edges.append((int(order[i]), int(order[j])))
    return edges


def sketch_links(percent: int):  # noqa: ANN201
    """An Arrow job over rows (cluster, i, j, node, block, n, sketch), sorted by the first three: (u, v) of the
    :func:`sketch_forest` of each (cluster, i, j), one block if i = j, else two."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def close() -> None:
            if rows:
                nodes, blocks, sizes, sketches = zip(*rows, strict=True)
                out.extend((nodes[a], nodes[b]) for a, b in sketch_forest(np.array(sizes), np.array(blocks), list(sketches), percent) if key[1] == key[2] or blocks[a] != blocks[b])
            rows.clear()

        for batch in batches:
            for cluster, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (cluster, i, j):
                    close()
                    key = (cluster, i, j)
                rows.append(row)
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in range(2)], names=["u", "v"])
                out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in range(2)], names=["u", "v"])

    return run


# --- signature trees ---------------------------------------------------------------------------


class Node:
    """``any``: OR of the members' bitmaps; ``all``: their AND; sizes; ``spare``: most tokens of a member beyond its bits."""

    __slots__ = ("all", "any", "high", "kids", "low", "members", "spare")

    def __init__(self, members: list[int], kids: list[Node], low: int, high: int, any_: int, all_: int, spare: int) -> None:
        self.members, self.kids, self.low, self.high, self.any, self.all, self.spare = members, kids, low, high, any_, all_, spare


def bitmap(tokens: np.ndarray) -> int:
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(tokens % np.uint64(BITS)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def signature_tree(sets: list[np.ndarray], members: list[int]) -> Node | None:
    """Leaves of LEAF sets that follow each other by size and smallest token; four nodes make one above."""
    if not members:
        return None
    order = sorted(members, key=lambda i: (len(sets[i]), int(sets[i][0])))
    nodes = []
    for at in range(0, len(order), LEAF):
        group = order[at : at + LEAF]
        maps = [bitmap(sets[i]) for i in group]
        any_, all_ = 0, maps[0]
        for m in maps:
            any_, all_ = any_ | m, all_ & m
        sizes = [len(sets[i]) for i in group]
        nodes.append(Node(group, [], min(sizes), max(sizes), any_, all_, max(s - m.bit_count() for s, m in zip(sizes, maps, strict=True))))
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), 4):
            kids = nodes[at : at + 4]
            any_, all_ = 0, kids[0].all
            for k in kids:
                any_, all_ = any_ | k.any, all_ & k.all
            above.append(Node([i for k in kids for i in k.members], kids, min(k.low for k in kids), max(k.high for k in kids), any_, all_, max(k.spare for k in kids)))
        nodes = above
    return nodes[0]


def may_link(x: Node, y: Node, percent: int = PERCENT) -> bool:
    """False only where no member of x can link to a member of y.

    Sizes: the smaller set is at least ``percent`` of the larger. Overlap: at most the common bits plus the tokens
    that share a bit, and at most a set's size less its bits that the other node lacks altogether.
    """
    if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low:
        return False
    most = min((x.any & y.any).bit_count() + min(x.spare, y.spare), x.high - (x.all & ~y.any).bit_count(), y.high - (y.all & ~x.any).bit_count())
    # linked sets of sizes a, b share at least percent * (a + b) / (100 + percent) tokens
    return (100 + percent) * most >= percent * (x.low + y.low)


class Block:
    """Sets of one block, or of two that are compared: links inside, or between the two."""

    def __init__(self, sets: list[np.ndarray], weights: list[int], percent: int = PERCENT) -> None:
        self.sets, self.percent, self.weights = sets, percent, np.array(weights, dtype=np.int64)
        self.sizes = np.array(list(map(len, sets)), dtype=np.int64)
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
        self.starts = np.cumsum([0, *self.sizes])
        self.mark = np.zeros(len(values), dtype=bool)
        self.root = list(range(len(sets)))
        self.links = np.zeros(len(sets), dtype=np.int64)  # by weight
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def survivors(self, left: list[int], right: list[int] | None) -> dict[int, list[Node]]:
        """For each leaf of the left tree (by its first member) the right leaves that may hold a link to it."""
        one = signature_tree(self.sets, left)
        two = one if right is None else signature_tree(self.sets, right)
        out: dict[int, list[Node]] = {}
        self.leaves: dict[int, Node] = {}
        stack = [(one, two)] if one and two else []
        while stack:
            x, y = stack.pop()
            if not may_link(x, y, self.percent):
                continue
            if not x.kids and not y.kids:
                self.leaves[x.members[0]] = x
                out.setdefault(x.members[0], []).append(y)
            elif x is y:
                stack += [(a, b) for k, a in enumerate(x.kids) for b in x.kids[k:]]
            elif x.kids and (not y.kids or len(x.members) >= len(y.members)):
                stack += [(a, y) for a in x.kids]
            else:
                stack += [(x, b) for b in y.kids]
        return out

    def compare(self, left: list[int], right: list[int] | None, count: bool) -> None:
        """Tests the pairs of surviving leaves; ``count`` is off: only those that are not linked up already."""
        for first, leaves in self.survivors(left, right).items():
            x = self.leaves[first]
            for k, i in enumerate(x.members):
                others = np.array([j for y in leaves for j in (x.members[k + 1 :] if y is x else y.members)], dtype=np.int64)
                if not count and len(others):
                    root = self.find(i)
                    others = others[[self.find(j) != root for j in others.tolist()]]
                most, least = np.maximum(self.sizes[others], self.sizes[i]), np.minimum(self.sizes[others], self.sizes[i])
                others = others[100 * least >= self.percent * most]
                if not len(others):
                    continue
                mine = self.flat[self.starts[i] : self.starts[i + 1]]
                self.mark[mine] = True
                for at in range(0, len(others), 1024):  # bounds what is gathered at once
                    some = others[at : at + 1024]
                    sizes = self.sizes[some]
                    offsets = np.cumsum(sizes) - sizes
                    tokens = np.arange(int(sizes.sum())) + np.repeat(self.starts[some] - offsets, sizes)
                    common = np.add.reduceat(self.mark[self.flat[tokens]].astype(np.int64), offsets)
                    hit = some[100 * common >= self.percent * (self.sizes[i] + sizes - common)]
                    self.links[i] += self.weights[hit].sum()
                    self.links[hit] += self.weights[i]
                    for j in hit.tolist():
                        a, b = self.find(i), self.find(j)
                        if a != b:
                            self.root[a] = b
                            self.edges.append((i, j))
                self.mark[mine] = False


LINKS = "u long, v long, links long"


def block_links(gram: int, percent: int, count: bool):  # noqa: ANN201
    """An Arrow job over rows (cluster, i, j, node, block, weight, text), sorted by the first three.

    Of each (cluster, i, j), one block if i = j, else two: (u, v) of a spanning forest of its links, and (u, links):
    the documents that a class links to in it. Texts that are not of their class (a doc_id may have several) are left
    out, and so are repeats.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out, make = None, {}, [], Shingles(gram)  # rows: node -> (block, weight, set)

        def close() -> None:
            nodes, found = list(rows), list(rows.values())
            block = Block([r[2] for r in found], [r[1] for r in found], percent)
            left = [k for k, r in enumerate(found) if r[0] == key[1]]
            block.compare(left, None if key[1] == key[2] else [k for k, r in enumerate(found) if r[0] == key[2]], count)
            out.extend((nodes[i], nodes[j], None) for i, j in block.edges)
            out.extend((node, None, n) for node, n in zip(nodes, block.links.tolist(), strict=True) if n and count)
            rows.clear()

        flush = lambda: pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in range(3)], names=["u", "v", "links"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for cluster, i, j, node, block, weight, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if key != (cluster, i, j):
                        if rows:
                            close()
                        key = (cluster, i, j)
                        if len(out) > 4096:
                            yield flush()
                            out.clear()
                    if node not in rows:
                        tokens = make.of(text)
                        if len(tokens) and fingerprint(tokens) == node:
                            rows[node] = (block, weight, tokens)
        if rows:
            close()
        yield flush()

    return run


# --- the join ----------------------------------------------------------------------------------


def document_sizes(gram: int, percent: int):  # noqa: ANN201
    """An Arrow job over (doc_id, text_hash, text): size, fingerprint and part signatures of each text's set.

    Of the rows of a batch that share a signature the first lists it and the others name its set in ``near``, so
    however many rows share a signature, few of them are sent on.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, parts = Shingles(gram), Parts(percent)
        for batch in batches:
            n, nodes, signatures, sketches = [], [], [], []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(2).slice(at, 256).to_pylist():
                    tokens = make.of(text)
                    n.append(len(tokens))
                    nodes.append(fingerprint(tokens) if len(tokens) else None)
                    signatures.append(parts.signatures(tokens))
                    sketches.append(sketch(tokens) if len(tokens) else None)
            if not n:
                continue
            flat, owner = np.concatenate(signatures), np.repeat(np.arange(len(n)), list(map(len, signatures)))
            values, first, back = np.unique(flat, return_index=True, return_inverse=True)
            ids = np.array([0 if x is None else x for x in nodes], dtype=np.int64)
            at = np.sort(first)
            others = ids[owner] != ids[owner[first][back]]
            pairs = np.unique(np.stack([owner[others], owner[first][back][others]]), axis=1)

            def lists(values: np.ndarray, of: np.ndarray) -> pa.ListArray:
                offsets = np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)  # noqa: B023
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), lists(flat[at], owner[at]), lists(ids[pairs[1]], pairs[0]), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "node", "signatures", "near", "sketch"])

    return run


def candidate_edges(sized: DataFrame) -> DataFrame:
    """(u, v) such that classes which share a part signature are joined up, of ``sized(node, signatures, near)``.

    Signatures are shuffled once, for the smallest class of each and for the join with it.
    """
    parts = sized.select(F.explode("signatures").alias("s"), "node").where("s is not null and node is not null").repartition("s")
    low = parts.groupBy("s").agg(F.min("node").alias("m"), F.max("node").alias("_high")).where("m <> _high").drop("_high")
    far = parts.join(low, "s").where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    return far.union(sized.select(F.col("node").alias("u"), F.explode("near").alias("v")))


def in_blocks(clusters: DataFrame, percent: int, most_sets: int, most_tokens: int) -> DataFrame:
    """``clusters(cluster, node, n_shingles)`` with each set's ``block`` and the ``pairs`` (i, j) of blocks that it is compared in.

    A cluster of more than a block is split by ranges of set sizes and then by hash; only blocks of the same range or of
    neighbouring ones meet.
    """
    blocks = F.greatest(F.ceil(F.count("*") / most_sets), F.ceil(F.sum("n_shingles") / most_tokens)).cast("int")
    # Sizes of sets that link are in one range or in neighbouring ones; a little wider, for the logarithm's rounding.
    span = F.floor(F.log("n_shingles") / (math.log(100 / percent) * 1.0001)).cast("int")
    large = clusters.groupBy("cluster").agg(blocks.alias("_b")).where("_b > 1").select("cluster")
    ranges = clusters.join(large, "cluster", "left_semi").groupBy("cluster", span.alias("_r")).agg(blocks.alias("_b"))
    layout = ranges.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_b"))).alias("_of"))  # some hundred ranges at most
    block = lambda r, k: r.cast("long") * (1 << 32) + k
    placed = clusters.withColumn("_r", span).join(layout, "cluster", "left").withColumn("_k", F.pmod(F.xxhash64("node"), F.coalesce(F.try_element_at("_of", F.col("_r")), F.lit(1))))
    placed = placed.withColumn("block", F.when(F.col("_of").isNull(), F.lit(0).cast("long")).otherwise(block(F.col("_r"), F.col("_k"))))
    in_range = lambda r: F.when(F.try_element_at("_of", r).isNull(), F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.try_element_at("_of", r) - 1), lambda k: block(r, k)))
    others = F.concat(*[in_range(F.col("_r") + d) for d in (-1, 0, 1)])
    pairs = F.transform(F.when(F.col("_of").isNull(), F.array(F.col("block"))).otherwise(others), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    return placed.withColumn("pairs", pairs).drop("_r", "_k", "_of")


def may_link_edges(clusters: DataFrame, percent: int) -> DataFrame:
    """(u, v) such that sets of ``clusters(cluster, node, n_shingles, sketch)`` which link are joined up: those whose sketches allow it."""
    placed = in_blocks(clusters, percent, SKETCH_SETS, SKETCH_TOKENS).withColumn("p", F.explode("pairs"))
    dealt = placed.select("cluster", "p.i", "p.j", "node", "block", "n_shingles", "sketch").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(sketch_links(percent), "u long, v long")


def may_hold(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``rows(key, ...)`` whose key is in ``keys(key, ...)``, and few others.

    Keys set bits by hash in bitmaps that every task gets, so other rows go before anything is shuffled. Bitmaps take
    4 MB at most: with too many keys for that more rows pass, none is lost.
    """
    bits = BITMAP_BITS * max(1, min(MOST_BITMAPS, -(-keys.count() * BITS_A_KEY // BITMAP_BITS)))
    bit = F.pmod(F.xxhash64("key"), F.lit(bits)) + 1  # numbers from 1 on have buckets from 1 on
    maps = keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), (F.bitmap_bucket_number(bit) == F.col("_bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1), "left_semi")


def links(docs: DataFrame, clusters: DataFrame, gram: int, percent: int, count: bool) -> DataFrame:
    """(u, v, links) of :func:`block_links` over ``clusters(cluster, node, key, weight, n_shingles)``.

    A class's text is found by ``key``: a doc_id, or the text's hash for rows without one, of which a text keeps one.
    Texts of no cluster, most of them in a usual corpus, are not shuffled (:func:`may_hold`).
    """
    placed = in_blocks(clusters, percent, BLOCK_SETS, BLOCK_TOKENS).select("key", "node", "cluster", "weight", "block", "pairs")
    texts = may_hold(docs.withColumn("key", F.coalesce("doc_id", F.xxhash64("text"))), clusters)
    unknown = texts.where("doc_id is null").groupBy("key").agg(F.first("text").alias("text"))
    rows = texts.where("doc_id is not null").select("key", "text").union(unknown).join(placed, "key")
    dealt = rows.select("cluster", "node", "block", "weight", "text", F.explode("pairs").alias("p")).select("cluster", "p.i", "p.j", "node", "block", "weight", "text")
    return dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(block_links(gram, percent, count), LINKS)


def jaccard_components(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, text_hash, component) of ``docs(doc_id, text)``, a row per row.

    ``n_links``: to how many other documents a document links; null without ``count_links``. ``component`` names the
    component by a hash (null for blank texts), where ``component_id`` names it by its smallest doc_id.
    """
    if not 50 <= percent < 100:
        raise ValueError("percent is at least 50 and below 100")
    docs = docs.select("doc_id", "text")
    sized = cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(document_sizes(gram, percent), SIZES))
    own = F.struct(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", "text_hash").alias("key"))
    per_class = sized.where("node is not null").groupBy("node")
    classes = cut_lineage(per_class.agg(F.min(own).alias("own"), F.min("doc_id").alias("least"), F.count("*").alias("weight"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    found = connected_components(candidate_edges(sized))
    wide = cut_lineage(found.select("node", F.col("component").alias("cluster")).join(classes.select("node", "n_shingles", "sketch"), "node"))
    found = connected_components(may_link_edges(wide, percent))
    clusters = cut_lineage(found.select("node", F.col("component").alias("cluster")).join(classes.select("node", F.col("own.key").alias("key"), "weight", "n_shingles"), "node"))
    out = cut_lineage(links(docs, clusters, gram, percent, count_links))
    joined = connected_components(out.where("v is not null").select("u", "v"))
    others = out.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("others"))
    named = classes.select("node", "least", "weight").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").join(others, "node", "left")
    n_links = (F.coalesce("others", F.lit(0)) + F.col("weight") - 1) if count_links else F.lit(None).cast("long")
    named = named.select("node", "component", "component_id", n_links.alias("n_links"))
    rows = sized.select("doc_id", "n_shingles", "node", "text_hash").join(named, "node", "left")
    blank = F.col("node").isNull()
    zero = F.lit(0 if count_links else None).cast("long")
    return rows.select("doc_id", "n_shingles", F.when(blank, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(blank, zero).otherwise(F.col("n_links")).alias("n_links"), "text_hash", "component")


def op9_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).drop("text_hash", "component")


def oracle() -> str:
    """DuckDB SQL: all pairs of documents that share a 3-gram, then the closure of their links."""
    upper, white = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\x20\x09-\x0D]+"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{white}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
k AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1), m AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links FROM documents d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""
