"""Training from the n-grams of a corpus over prefix trees of its words: what words share in front is counted and summed once.

Sorted words are dealt out by range. A task holds those of a block as a tree whose nodes are numbered by depth, in the order of
their parents. An n-gram that ends at a node is named by the two n-grams that are one shorter, at the parent and at the node, so
a level of n-grams is a table of pairs of numbers, and no substring is made. The n-grams that are left at a node are the edges
of every word that passes it. Sums up to a node serve all words below it; with the shares of a node's edges the masses run back
from the ends of words to the root. One block of arrays for each tree is kept from step to step.

The driver holds the tokens and their probabilities, as it does for a trie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.patterns import UNK
from lexiforge.operators.lines import CHUNK, NONE, chunks
from lexiforge.operators.trie import DoubleArray, code_points

#: Tokens that the driver holds, some 100 bytes each at the start; with more frequent n-grams the joins of lattice.py train.
MAX_NGRAMS = 4_000_000
WORDS = 1 << 17  # of a tree
BITS = 21  # of a character
SLICE = 1 << 16  # tokens whose masses are added up in one place
KINDS = {
    "sizes": np.int32,  # where the nodes of each depth begin; the root is node 0
    "parent": np.int32,
    "letter": np.int32,
    "passing": np.int64,  # weight of what passes or ends at a node, without context
    "ends": np.int32,  # the nodes of whole words
    "weight": np.float64,  # of whole words
    "node": np.int32,  # where n-grams end, ascending
    "above": np.int32,  # the place in ``node`` of the parent of each node, or -1
    "which": np.int32,  # the place of each node's n-gram in ``key``
    "key": np.int64,
    "freq": np.int64,
    "before": np.int32,  # of edges, by the nodes at which they end: the nodes at which they start
    "token": np.int32,
    "many": np.uint16,  # edges of each node
}
TREE = ("sizes", "parent", "letter", "passing", "ends", "weight")
STATE = ("above", "passing", "which", "key", "freq")
EDGES = ("sizes", "before", "token", "many", "ends", "weight")
Arrays = dict[str, np.ndarray]


def kept(names: tuple[str, ...], made: Arrays) -> Arrays:
    """Those of the arrays, in the types that are kept."""
    return {n: np.ascontiguousarray(made[n], dtype=KINDS[n]) for n in names}


def blocks(wood: RDD, made: tuple[str, ...], step: Callable[[Arrays], Arrays]) -> RDD:
    """``step`` on every block, persisted. Blocks are no table: a training has some hundred steps, whose plans the driver
    would hold."""
    return wood.map(lambda block: kept(made, step(block)), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)


# --- trees -------------------------------------------------------------------------------------


def tree(texts: pa.StringArray, weight: np.ndarray, left: np.ndarray, whole: np.ndarray) -> Arrays:
    """The tree of sorted ``texts``; ``left`` characters in front are context, which counts nowhere."""
    lengths = pc.utf8_length(texts).to_numpy().astype(np.int64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    points = code_points(str(texts.buffers()[2].slice(bounds[0], bounds[-1] - bounds[0]), "utf-8"))
    starts = np.cumsum(lengths) - lengths
    at, row, sizes = np.zeros(len(texts), dtype=np.int32), np.arange(len(texts)), [0, 1]
    parent, letter, passing = [np.zeros(1, np.int32)], [np.full(1, -1, np.int32)], [np.zeros(1, np.int64)]
    for depth in range(int(lengths.max(initial=0))):
        row = row[lengths[row] > depth]
        code, above = points[starts[row] + depth], at[row]
        new = np.r_[True, (code[1:] != code[:-1]) | (above[1:] != above[:-1])]
        at[row] = sizes[-1] + np.cumsum(new) - 1
        parent.append(above[new])
        letter.append(code[new].astype(np.int32))
        passing.append(np.add.reduceat(np.where(left[row] <= depth, weight[row], 0), np.flatnonzero(new)))
        sizes.append(sizes[-1] + int(new.sum()))
    return {"sizes": np.array(sizes), "parent": np.concatenate(parent), "letter": np.concatenate(letter), "passing": np.concatenate(passing), "ends": at[whole], "weight": weight[whole]}


def trees(segments: DataFrame, max_length: int) -> RDD:
    """The trees of ``segments(seg, weight)``; those of more than CHUNK characters are there in chunks, for their n-grams
    only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many >= WORDS:
                yield packed(held)
                held, many = [], 0
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        made = kept(TREE, tree(rows.column(0).combine_chunks(), *(rows.column(c).to_numpy() for c in (1, 2, 3))))
        return pa.RecordBatch.from_arrays([pa.array([made[n].tobytes()], pa.binary()) for n in TREE], names=list(TREE))

    spark, some = segments.sparkSession, segments.where("seg <> ''").select("seg", F.col("weight").cast("long").alias("weight"))
    many, longest = some.agg(F.count("*"), F.max(F.length("seg"))).collect()[0]
    # Every step runs a task for each part: no more of them than there are trees, if all cores have some.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, many // (2 * WORDS)))
    rows, long = some.select("seg", "weight", F.lit(0).alias("left_chars"), F.lit(True).alias("whole")), F.length("seg") > CHUNK
    if (longest or 0) > CHUNK:
        rows = rows.where(~long).union(chunks(some.where(long), max_length, CHUNK).select("text", "weight", "left_chars", F.lit(False)))
    made = rows.repartitionByRange(parts, "seg").sortWithinPartitions("seg").mapInArrow(run, ", ".join(f"{n} binary" for n in TREE))
    return made.rdd.map(lambda r: {n: np.frombuffer(r[n], dtype=KINDS[n]) for n in TREE}).persist(StorageLevel.MEMORY_AND_DISK)


# --- n-grams -----------------------------------------------------------------------------------


def grouped(node: np.ndarray, above: np.ndarray, passing: np.ndarray, key: np.ndarray) -> Arrays:
    keys, which = np.unique(key, return_inverse=True)
    freq = np.zeros(len(keys), dtype=np.int64)
    np.add.at(freq, which, passing)
    return {"node": node, "above": above, "passing": passing, "which": which, "key": keys, "freq": freq}


def characters(block: Arrays) -> Arrays:
    """The first level."""
    return grouped(np.arange(1, len(block["parent"])), block["parent"][1:] - 1, block["passing"][1:], block["letter"][1:].astype(np.int64))


def pairs(block: Arrays) -> Arrays:
    """N-grams of one and of two characters, as numbers."""
    parent, letter, first = block["parent"], block["letter"].astype(np.int64), int(block["sizes"][:3][-1])
    both = np.r_[letter[1:], (letter[parent[first:]] + 1 << BITS) + letter[first:]]
    none = np.zeros(0, dtype=np.int64)
    return grouped(none, none, np.r_[block["passing"][1:], block["passing"][first:]], both)


def triples(block: Arrays) -> Arrays:
    """The third level. Nearly all pairs are frequent, so none are left out before it."""
    parent, letter, sizes = block["parent"], block["letter"].astype(np.int64), block["sizes"]
    first = int(sizes[3]) if len(sizes) > 3 else len(parent)
    node = np.arange(first, len(parent))
    above = parent[first:]
    key = (letter[parent[above]] << 2 * BITS) + (letter[above] << BITS) + letter[first:]
    return grouped(node, np.maximum(above - first, -1), block["passing"][first:], key)


def places(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where ``keys`` stand in a sorted ``table``, or -1."""
    if not len(table):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def level(state: Arrays, table: np.ndarray) -> Arrays:
    """The n-grams that are one longer than those of ``state``, of which ``table`` are frequent. Only nodes at which both
    shorter ones end go on."""
    ids, above = places(state["key"], table)[state["which"]], state["above"]
    on = (ids >= 0) & (above >= 0)
    on &= ids[above] >= 0  # of -1 any place: decided
    place = np.where(on, np.cumsum(on) - 1, -1)
    rest = above[on]
    node = state["node"][on] if "node" in state else rest
    return grouped(node, place[rest], state["passing"][on], ids[rest] * len(table) + ids[on])


def frequent(state: RDD, parts: int, min_freq: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and frequencies of the n-grams of a level."""

    def dealt(block: Arrays) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        bucket = block["key"] % parts
        for b in np.unique(bucket).tolist():
            yield b, (block["key"][bucket == b], block["freq"][bucket == b])

    def summed(rows: Iterable[tuple[int, tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = [r for _, r in rows]
        if found:
            keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            freq = np.zeros(len(keys), dtype=np.int64)
            np.add.at(freq, which, np.concatenate([f for _, f in found]))
            yield keys[freq >= min_freq], freq[freq >= min_freq]

    rows = state.flatMap(dealt).partitionBy(parts, int).mapPartitions(summed).collect()
    keys, freq = (np.concatenate([np.zeros(0, np.int64), *(r[c] for r in rows)]) for c in (0, 1))
    order = np.argsort(keys)
    return keys[order], freq[order]


@dataclass
class Grams:
    """The frequent n-grams: those of one character are code points, of which ``often`` go on; the others are pairs of places
    in the table before."""

    chars: np.ndarray
    often: np.ndarray
    tables: list[np.ndarray]

    def tokens(self) -> pa.Array:
        """All of them, level by level."""
        parts, text = [strings(self.chars[:, None])], self.often[:, None].astype(np.uint32)
        for keys in self.tables:
            first, last = np.divmod(keys, max(1, len(text)))
            text = np.concatenate([text[first], text[last][:, -1:]], axis=1)
            parts.append(strings(text))
        return pa.concat_arrays(parts)


def strings(points: np.ndarray) -> pa.Array:
    """The rows of a table of code points, some at a time: strings of Python take ten times the room."""
    n, parts = points.shape[1], [pa.array([], pa.string())]
    for first in range(0, len(points), SLICE):
        text = points[first : first + SLICE].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        parts.append(pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string()))
    return pa.concat_arrays(parts)


def grow(wood: RDD, max_length: int, min_freq: int) -> Grams | None:
    """The frequent n-grams of ``trees``, or None if they are too many."""
    parts = max(1, min(64, wood.getNumPartitions()))
    keys, freq = frequent(wood.map(pairs), parts, 0)
    lone = keys < 1 << BITS
    chars, often = keys[lone], keys[lone & (freq >= min_freq)]
    out = Grams(chars, often, [])
    if max_length < 2:
        return out
    first, last = np.divmod(keys[~lone & (freq >= min_freq)], 1 << BITS)
    first -= 1
    out.tables.append(places(first, often) * len(often) + places(last, often))
    if max_length < 3:
        return out
    two, state = (first << BITS) + last, blocks(wood, STATE, triples)
    try:
        table, _ = frequent(state, parts, min_freq)
        out.tables.append(places(table >> BITS, two) * len(two) + places(table & (1 << 2 * BITS) - 1, two))
        for _ in range(4, max_length + 1):
            if not len(table):
                break
            known = wood.context.broadcast(table)
            longer = blocks(state, STATE, lambda b, known=known: level(b, known.value))
            table, _ = frequent(longer, parts, min_freq)
            state.unpersist()
            state = longer
            out.tables.append(table)
            if len(chars) + sum(map(len, out.tables)) > MAX_NGRAMS:
                return None
        return out
    finally:
        state.unpersist()


# --- edges -------------------------------------------------------------------------------------


def matches(block: Arrays, trie: DoubleArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(end, start, token) of the tokens of a trie along the paths of a tree, by length."""
    parent = block["parent"]
    bounds = np.searchsorted(parent[1:], np.arange(len(parent) + 1)) + 1  # parents ascend: the children of each node
    codes = trie.encode(block["letter"].view(np.uint32))
    node, start = np.arange(1, len(parent)), parent[1:]
    state = np.zeros(len(node), dtype=np.int64)
    for _ in range(trie.longest):
        code = codes[node]
        to = trie.base[state] + code
        ok = (code > 0) & (to >= 0)
        ok[ok] = trie.check[to[ok]] == state[ok]
        node, start, state = node[ok], start[ok], to[ok].astype(np.int64)
        token = trie.value[state]
        hit = token >= 0
        yield node[hit], start[hit], token[hit]
        many = bounds[node + 1] - bounds[node]
        first = np.repeat(bounds[node] - np.cumsum(many) + many, many)
        node, start, state = first + np.arange(len(first)), np.repeat(start, many), np.repeat(state, many)


def edges(block: Arrays, grams: Grams, numbers: list[np.ndarray], trie: DoubleArray, others: np.ndarray) -> Arrays:
    """The edges of a tree: ``numbers`` are the ids of the n-grams of each level, ``others`` those of the tokens of ``trie``."""
    parent = block["parent"]
    everything = np.arange(len(parent))
    start = parent.copy()
    ends, starts, tokens = [everything[1:]], [parent[1:]], [numbers[0][np.searchsorted(grams.chars, block["letter"][1:])]]
    state, table = characters(block), grams.often
    for own, number in zip(grams.tables, numbers[1:], strict=True):
        state = level(state, table)
        found, table, start = places(state["key"], own), own, parent[start]
        hit = found[state["which"]] >= 0
        ends.append(state["node"][hit])
        starts.append(start[ends[-1]])
        tokens.append(number[found[state["which"]][hit]])
    for end, begin, token in matches(block, trie):
        ends.append(end)
        starts.append(begin)
        tokens.append(others[token])
    end = np.concatenate(ends)
    by = np.argsort(end, kind="stable")
    return {"sizes": block["sizes"], "before": np.concatenate(starts)[by], "token": np.concatenate(tokens)[by], "many": np.bincount(end, minlength=len(parent)), "ends": block["ends"], "weight": block["weight"]}


def renumbered(block: Arrays, numbers: np.ndarray) -> Arrays:
    """Without the edges of tokens whose new number is -1."""
    token = numbers[block["token"]]
    keep = token >= 0
    node = np.repeat(np.arange(len(block["many"])), block["many"])[keep]
    return block | {"before": block["before"][keep], "token": token[keep], "many": np.bincount(node, minlength=len(block["many"]))}


def masses(block: Arrays, scores: np.ndarray) -> np.ndarray:
    """By edge, the expected number of times that it is taken; each word's are scaled to its weight."""
    sizes, before, many = block["sizes"], block["before"].astype(np.int64), block["many"].astype(np.int64)
    first = np.cumsum(many) - many
    bounds = np.r_[first, len(before)][sizes]
    score, share = scores[block["token"]], np.empty(len(before))
    total, tokens = np.zeros(len(many)), np.zeros(len(many))
    with np.errstate(divide="ignore", invalid="ignore"):
        for d in range(1, len(sizes) - 1):
            own, at = slice(sizes[d], sizes[d + 1]), slice(bounds[d], bounds[d + 1])
            begin, times, start = first[own] - bounds[d], many[own], before[at]
            reach = total[start] + score[at]
            top = np.maximum.reduceat(reach, begin)
            top[top == NONE] = 0.0
            reach -= np.repeat(top, times)
            np.exp(reach, out=reach)
            sums = np.add.reduceat(reach, begin)
            total[own] = top + np.log(sums)
            reach /= np.repeat(np.where(sums > 0, sums, 1.0), times)
            share[at] = reach
            tokens[own] = np.add.reduceat(reach * tokens[start], begin) + 1
    back = np.zeros(len(many))
    solved = total[block["ends"]] > NONE
    np.add.at(back, block["ends"][solved], block["weight"][solved] / tokens[block["ends"][solved]])
    for d in range(len(sizes) - 2, 0, -1):
        own, at = slice(sizes[d], sizes[d + 1]), slice(bounds[d], bounds[d + 1])
        share[at] *= np.repeat(back[own], many[own])
        np.add.at(back, before[at], share[at])
    return share


def added_masses(wood: RDD, scores: Broadcast, n: int) -> np.ndarray:
    """The E-step: the mass of each of ``n`` tokens."""

    def run(rows: Iterable[Arrays]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        total = np.zeros(n)
        for block in rows:
            total += np.bincount(block["token"], weights=masses(block, scores.value), minlength=n)
        at = np.flatnonzero(total)
        cuts = np.searchsorted(at, np.arange(0, n + SLICE, SLICE))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = at[cuts[b] : cuts[b + 1]]
            yield b, ((own - b * SLICE).astype(np.int32), total[own])

    def summed(rows: Iterable[tuple[int, tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[int, np.ndarray]]:
        found: dict[int, np.ndarray] = {}
        for b, (at, mass) in rows:
            found.setdefault(b, np.zeros(SLICE))[at] += mass
        yield from found.items()

    slices = -(-n // SLICE)
    out = np.zeros(slices * SLICE)
    for b, mass in wood.mapPartitions(run).partitionBy(slices, int).mapPartitions(summed).collect():
        out[b * SLICE : (b + 1) * SLICE] = mass
    return out[:n]


# --- training ----------------------------------------------------------------------------------


def unit_hashes(tokens: pa.Array, seed: int) -> np.ndarray:
    """``ngrams.uniform_hash`` of all tokens."""
    found, head = np.empty(len(tokens)), f"{seed}:"
    for first in range(0, len(tokens), SLICE):
        part = tokens.slice(first, SLICE).to_pylist()
        found[first : first + SLICE] = [int.from_bytes(md5((head + t).encode()).digest()[:7], "big") >> 4 for t in part]
    return (found + 0.5) / float(1 << 52)


class Forest:
    """The words of a corpus with the edges of ``tokens``, which are in order; what ``train`` keeps gets smaller."""

    def __init__(self, spark: SparkSession, wood: RDD, grams: Grams, given: list[str], fixed: set[str]) -> None:
        found = grams.tokens()
        there = set(found.filter(pc.is_in(found, value_set=pa.array(given, pa.string()))).to_pylist())
        more = [t for t in given if t not in there]
        found = pa.concat_arrays([found, pa.array(more, pa.string())])
        order = pc.sort_indices(found)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.spark, self.tokens = spark, found.take(order)
        del found, order
        self.fixed = pc.is_in(self.tokens, value_set=pa.array(sorted(fixed), pa.string())).to_numpy(zero_copy_only=False)
        self.single = pc.equal(pc.utf8_length(self.tokens), 1).to_numpy(zero_copy_only=False)
        self.unk = pc.index(self.tokens, UNK).as_py()
        numbers = np.split(place[: len(place) - len(more)], np.cumsum([len(grams.chars), *map(len, grams.tables)])[:-1])
        sent = spark.sparkContext.broadcast((grams, numbers, DoubleArray(more), place[len(place) - len(more) :]))
        self.blocks = blocks(wood, EDGES, lambda b: edges(b, *sent.value))
        self.known = np.arange(len(place), dtype=np.int32)  # the tokens that blocks have, by their numbers there

    def release(self) -> None:
        self.blocks.unpersist()

    def step(self, own: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """The masses of the tokens ``own``. A character that is none of them is unknown."""
        scores = np.full(len(self.tokens), NONE)
        scores[own] = np.log(theta)
        gone = self.single.copy()
        gone[own] = False
        scores[gone] = scores[self.unk]
        sent, n = self.spark.sparkContext.broadcast(scores[self.known]), len(self.known)
        scores.fill(0.0)
        found = scores
        found[self.known] = added_masses(self.blocks, sent, n)
        sent.destroy()
        found[self.unk] += found[gone].sum()
        return found[own]

    def shrink(self, own: np.ndarray) -> None:
        """Drops the edges of other tokens once they are some part of all."""
        if len(own) > 0.6 * len(self.known):
            return
        numbers = np.full(len(self.tokens), -1, dtype=np.int32)
        numbers[self.single] = np.searchsorted(own, self.unk)
        numbers[own] = np.arange(len(own))
        sent, older = self.spark.sparkContext.broadcast(numbers[self.known]), self.blocks
        self.blocks = blocks(older, EDGES, lambda b: renumbered(b, sent.value))
        self.blocks.foreach(lambda _: None)
        older.unpersist()
        self.known = own

    def frame(self, own: np.ndarray, theta: np.ndarray) -> DataFrame:
        """(token_id, token, is_fixed, theta)."""
        return self.spark.createDataFrame(pa.table({"token_id": pa.array(np.arange(len(own), dtype=np.int32)), "token": self.tokens.take(pa.array(own)), "is_fixed": pa.array(self.fixed[own]), "theta": pa.array(theta)}))

    def train(self, size: int, shrink_ratio: float, max_epoch: int, keep_char: bool, seed: int, tiny: float, long: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        """As ``train_vocab`` by expectation-maximisation. ``long``: (token_id, mass) of words that are in no tree."""
        start, own = unit_hashes(self.tokens, seed), np.arange(len(self.tokens), dtype=np.int32)
        exempt = self.fixed | (self.single if keep_char else False)
        exempt[self.unk] = True
        while True:
            theta = start[own] / start[own].sum()
            for _ in range(max_epoch):
                mass = self.step(own, theta)
                if long is not None:
                    for r in long(self.frame(own, theta)).collect():
                        mass[r.token_id] += r.mass
                mass += tiny
                theta = mass / mass.sum()
            if len(own) <= size:
                return self.frame(own, theta)
            free = np.flatnonzero(~exempt[own])
            wanted = max(size, int(len(own) * shrink_ratio)) - (len(own) - len(free))
            if wanted < 0:
                raise ValueError(f"{len(own) - len(free)} tokens are exempt, more than {size}")
            best = free[np.lexsort((start[own[free]], -(theta[free] + tiny)))[:wanted]]
            own = own[np.sort(np.r_[np.flatnonzero(exempt[own]), best])]
            self.shrink(own)
