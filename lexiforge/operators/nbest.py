"""N best paths of segments of any length by searches over a segment's edges.

``nbest_astar``: for all segments of a batch in step, from their ends (``Group.nbest``); ``astar`` is the same for one
segment by a search backwards along the suffix whose best whole path is best. ``nbest_point``: from the best path by moving
one boundary at a time; it sees neighbours only, so it may miss one of the n best, unless the rest behind a move is completed
exactly (``boundary_search``).

Equal scores are ordered by token lengths from the front, longer first, as the fold of segment.py has them.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.lines import Group, Words, line_paths, parts
from lexiforge.operators.ngrams import spread

FOUND = "seg string, weight long, rank int, pieces array<string>, score double"
Edges = list[list[tuple[int, float]]]
Path = tuple[float, tuple[int, ...]]


def parted(back: list[int], a: int, b: int) -> tuple[list[int], list[int]]:
    """The lengths of the best paths to two positions, from where they part on; last ones first."""
    one, two = [], []
    while a != b:
        if a > b:
            one.append(back[a])
            a -= back[a]
        else:
            two.append(back[b])
            b -= back[b]
    return one, two


class Suffix:
    """The rest of a path behind a position; its best whole path goes before others with the same score by its lengths."""

    __slots__ = ("at", "back", "length", "next", "value", "whole")

    def __init__(self, value: float, whole: float, at: int, length: int, rest: Suffix | None, back: list[int]) -> None:
        self.value, self.whole, self.at, self.length, self.next, self.back = value, whole, at, length, rest, back

    def lengths(self) -> Iterator[int]:
        node = self
        while node.next is not None:
            yield node.length
            node = node.next

    def __lt__(self, other: Suffix) -> bool:
        if self.whole != other.whole:
            return self.whole > other.whole
        one, two = parted(self.back, self.at, other.at)
        pairs = zip(chain(reversed(one), self.lengths()), chain(reversed(two), other.lengths()), strict=False)
        return next((a > b for a, b in pairs if a != b), False)


def lengths_to(back: list[int], at: int) -> tuple[int, ...]:
    return tuple(reversed(parted(back, at, 0)[0]))


def forward_best(edges: Edges) -> tuple[list[float], list[int]]:
    """By position the best score and the last length; of equal scores the path with the longer tokens in front."""
    best, back = [0.0], [0]
    for at in range(1, len(edges)):
        value, last = float("-inf"), 0
        for length, score in edges[at]:
            reach = best[at - length] + score
            if reach > value:
                value, last = reach, length
            elif reach == value and last:
                one, two = parted(back, at - length, at - last)
                if [*reversed(one), length] > [*reversed(two), last]:
                    last = length
        best.append(value)
        back.append(last)
    return best, back


def summed(edges: Edges, lengths: tuple[int, ...]) -> float:
    at, total = 0, 0.0
    for n in lengths:
        at += n
        total += next(s for length, s in edges[at] if length == n)
    return total


def astar(edges: Edges, n: int) -> list[Path]:
    """The ``n`` best paths as (score, lengths), best first; ``edges[e]``: (length, score) of the edges that end at e.

    A suffix that is taken up goes on to its own best whole path at once; what branches off waits, no more of it than paths
    are still wanted.
    """
    best, back = forward_best(edges)
    end, found = len(edges) - 1, []
    waiting = [Suffix(0.0, best[end], end, 0, None, back)] if best[end] > float("-inf") else []
    while waiting and len(found) < n:
        node, wanted = waiting.pop(0), n - len(found) - 1
        while node.at:
            own = node
            for length, score in edges[own.at]:
                before, value = own.at - length, score + own.value
                if length == back[own.at]:
                    node = Suffix(value, own.whole, before, length, own, back)
                elif wanted and (len(waiting) < wanted or best[before] + value >= waiting[-1].whole) and best[before] > float("-inf"):
                    insort(waiting, Suffix(value, best[before] + value, before, length, own, back))
                    del waiting[wanted:]
        lengths = tuple(node.lengths())
        found.append((summed(edges, lengths), lengths))
    return found


def point_search(edges: Edges, n: int) -> list[Path]:
    """Up to ``n`` paths as (score, lengths), best first: the best known path that was not taken up yet is taken up, and
    every path that differs from it in one boundary becomes known. No path is taken up twice."""
    best, back = forward_best(edges)
    end = len(edges) - 1
    if best[end] == float("-inf"):
        return []
    score_of = [dict(e) for e in edges]
    first = lengths_to(back, end)
    heap, known, found = [(-summed(edges, first), tuple(-x for x in first))], {first}, []
    while heap and len(found) < n:
        negative, key = heapq.heappop(heap)
        lengths = tuple(-x for x in key)
        found.append((summed(edges, lengths), lengths))
        at = 0
        for i, length in enumerate(lengths):
            ways = []  # (the lengths in place of those from i on, how many these are, what they add)
            own = score_of[at + length][length]
            for k in range(1, length):
                one, two = score_of[at + k].get(k), score_of[at + length].get(length - k)
                if one is not None and two is not None:
                    ways.append(((k, length - k), 1, one + two - own))
            if i + 1 < len(lengths):
                behind = lengths[i + 1]
                joined = score_of[at + length + behind].get(length + behind)
                if joined is not None:
                    ways.append(((length + behind,), 2, joined - own - score_of[at + length + behind][behind]))
            for new, gone, more in ways:
                other = (*lengths[:i], *new, *lengths[i + gone :])
                if other not in known:
                    known.add(other)
                    heapq.heappush(heap, (negative - more, tuple(-x for x in other)))
            at += length
    return sorted(found, key=lambda p: (-p[0], tuple(-x for x in p[1])))


def boundary_search(edges: Edges, n: int) -> list[Path]:
    """The ``n`` best paths as (score, lengths), best first, by flips of one boundary each, completed exactly.

    Each path stands for those that agree with it up to a place (``fixed``) and the best of them. What else is among these
    differs first at one place behind: there a boundary is set or taken away, and the best rest of such a path is known
    from a recurrence from the end. So no path is missed, whatever lies between two of them.
    """
    end = len(edges) - 1
    leaving: list[list[tuple[int, float]]] = [[] for _ in edges]
    for e, own in enumerate(edges):
        for length, score in own:
            leaving[e - length].append((length, score))
    low = float("-inf")
    rest, ahead = [low] * (end + 1), [0] * (end + 1)
    rest[end] = 0.0
    ways: list[list[tuple[float, int]]] = [[] for _ in edges]  # by start: (best score, length), longest first
    for at in range(end - 1, -1, -1):
        ways[at] = [(score + rest[at + length], length) for length, score in sorted(leaving[at], reverse=True) if rest[at + length] > low]
        for value, length in ways[at]:
            if value > rest[at]:
                rest[at], ahead[at] = value, length
    if not end or rest[0] == low:
        return []
    score_of = [dict(e) for e in edges]

    def completed(front: tuple[int, ...], at: int) -> tuple[int, ...]:
        more = []
        while at < end:
            more.append(ahead[at])
            at += ahead[at]
        return front + tuple(more)

    first = completed((), 0)
    heap, found = [(-rest[0], tuple(-x for x in first), 1)], []
    while heap and len(found) < n:
        _, key, fixed = heapq.heappop(heap)
        lengths = tuple(-x for x in key)
        found.append((summed(edges, lengths), lengths))
        at, before = 0, 0.0
        for i, length in enumerate(lengths):
            own = lengths[:i]
            for k in range(max(1, fixed - at), length):  # a boundary is set inside the token
                score = score_of[at + k].get(k)
                if score is not None and rest[at + k] > low:
                    path = completed((*own, k), at + k)
                    heapq.heappush(heap, (-(before + score + rest[at + k]), tuple(-x for x in path), at + k + 1))
            if at + length >= fixed and at + length < end:  # the boundary behind it is taken away
                value, best = max(((v, m) for v, m in ways[at] if m > length), default=(low, 0))
                if value > low:
                    path = completed((*own, best), at + best)
                    heapq.heappush(heap, (-(before + value), tuple(-x for x in path), at + length + 1))
            before += score_of[at + length][length]
            at += length
    return found


def searched(segments: DataFrame, tries: Broadcast, n: int, search: Callable[[Edges, int], list[Path]]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        for batch in batches:
            for own_rows in parts(batch.column(0).to_pylist(), 1 << 16):
                part = batch[own_rows]
                texts, weights, rows = part.column(0).to_pylist(), part.column(1).to_pylist(), []
                group = Group(texts, made).scored(made.scores)
                by = np.lexsort((group.length, group.end, group.row))
                bounds = np.searchsorted(group.row[by], np.arange(group.n + 1))
                for i, (text, weight) in enumerate(zip(texts, weights, strict=True)):
                    own = by[bounds[i] : bounds[i + 1]]
                    edges: Edges = [[] for _ in range(len(text) + 1)]
                    for e, length, score in zip(group.end[own].tolist(), group.length[own].tolist(), group.score[own].tolist(), strict=True):
                        edges[e].append((length, score))
                    for rank, (score, lengths) in enumerate(search(edges, n), 1):
                        stops = np.cumsum(lengths).tolist()
                        rows.append((text, weight, rank, [text[a - k : a] for a, k in zip(stops, lengths, strict=True)], score))
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["seg", "weight", "rank", "pieces", "score"])

    return spread(segments).select("seg", F.col("weight").cast("long")).mapInArrow(run, FOUND)


def nbest_astar(segments: DataFrame, tries: Broadcast, n: int) -> DataFrame:
    """(seg, weight, rank, pieces, score): the ``n`` best paths of ``segments(seg, weight)``, exactly: words by a recurrence from their
    ends, lines from their words where no token reaches across one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for own in parts(texts, 1 << 20):
                for line, rank, score, pieces in line_paths(Words(texts[own], made.heads), made, made.scores, n):
                    at = pa.array(line + own.start)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(rank.astype(np.int32)), pieces, pa.array(score)], names=["seg", "weight", "rank", "pieces", "score"])

    return spread(segments).select("seg", F.col("weight").cast("long")).mapInArrow(run, FOUND)


def nbest_point(segments: DataFrame, tries: Broadcast, n: int, exact: bool = False) -> DataFrame:
    """(seg, weight, rank, pieces, score): up to ``n`` good paths, the best one among them, by single moves of boundaries;
    with ``exact`` the rest behind a move is completed and no path of the ``n`` best is missed."""
    return searched(segments, tries, n, boundary_search if exact else point_search)


def found_share(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_found): how many of the exact n best paths a search has found."""
    both = exact.select("seg", "pieces").join(found.select("seg", "pieces").withColumn("_f", F.lit(1)), ["seg", "pieces"], "left")
    return both.agg(F.count("*").alias("n_exact"), F.count("_f").alias("n_found"))
