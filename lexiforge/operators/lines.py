"""Paths and path sums of segments of any length, over a trie that the executors hold.

A task takes the segments of a batch together: the trie is walked at all places at once, and the recurrences over end
positions run for all segments of a group in step, a short array operation for each position. Words and whole lines go the
same way.

Sums over the paths of a line are products of matrices: with tokens of at most L characters, what leads up to a position
depends on the L sums before it, so a stretch of the line maps L values to L values (logarithms of sums, and the expected
number of tokens beside them). Lines of more than CHUNK characters are cut into chunks, which are rows of their own:

1. ``chunk_matrices``: the banded matrix of every chunk, without its neighbours;
2. ``forward_vectors`` and ``backward_vectors``: the chunks of a line stream by in order, and in reverse, and each gets the
   vectors at its ends, the line's sum and its expected number of tokens; a task holds one vector a line;
3. the masses inside every chunk, from those vectors.

So a line of any length is spread over tasks, and no task holds more than a group of chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.patterns import HEAD
from lexiforge.operators.ngrams import spread
from lexiforge.operators.trie import Matcher, code_points

CHUNK = 512
BITS = 62  # of a number that is not negative
CELLS = 1 << 20  # of a group's table: segments, positions, lengths
PIECES = "pieces array<string>, ids array<int>, score double"
NONE = -np.inf


class Group:
    """Texts of similar length, side by side: ``row``, ``end``, ``length`` and ``token`` of every edge, by end.

    ``left``: characters of each text that are context only; edges end behind them. Positions count from 0, in front of
    the first character that is not context.
    """

    def __init__(self, texts: list[str], made: Matcher, left: np.ndarray | None = None, unknown: bool = True) -> None:
        self.n, self.band = len(texts), made.longest
        self.left = np.zeros(self.n, dtype=np.int64) if left is None else left
        whole = np.fromiter(map(len, texts), dtype=np.int64, count=self.n)
        self.size = whole - self.left
        self.last = int(self.size.max(initial=0))
        # A row of places for each position, so that the edges come almost in the order of their ends.
        row = np.repeat(np.arange(self.n), whole)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)) * self.n + row
        codes = np.zeros((int(whole.max(initial=0)) + 1) * self.n, dtype=np.int32)
        codes[place] = made.trie.encode(code_points("".join(texts)))
        state = None
        if made.behind:
            state = np.full(len(codes), made.behind, dtype=np.int64)
            state[: self.n] = 0
        start, length, token = made.trie.walk(codes, made.longest, max(1, self.n), state)
        if unknown and made.unk >= 0:
            lone = np.zeros(len(codes), dtype=bool)
            lone[place] = True
            lone[start[length == 1]] = False
            lone = np.flatnonzero(lone)
            start, length, token = np.r_[lone, start], np.r_[np.ones(len(lone), np.int64), length], np.r_[np.full(len(lone), made.unk), token]
        row = start % max(1, self.n)
        self._keep(row, start // max(1, self.n) - self.left[row] + length, length, token)

    def _keep(self, row: np.ndarray, end: np.ndarray, length: np.ndarray, token: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """Sorts the edges, of which shorter ones come first, by end and row."""
        keep = np.flatnonzero(end > 0)
        keep = keep[np.argsort(end[keep] * self.n + row[keep], kind="stable")]
        self.row, self.end, self.length, self.token = row[keep], end[keep], length[keep], token[keep]
        return keep

    @classmethod
    def of_edges(cls, size: np.ndarray, row: np.ndarray, end: np.ndarray, length: np.ndarray, token: np.ndarray, score: np.ndarray) -> Group:
        """From edges that are given, sorted by row, end and length."""
        group = cls.__new__(cls)
        group.n, group.size, group.left = len(size), size, np.zeros(len(size), dtype=np.int64)
        group.last, group.band = int(size.max(initial=0)), int(length.max(initial=1))
        group.order = group._keep(row, end, length, token)
        group.score = score[group.order]
        return group

    def scored(self, scores: np.ndarray) -> Group:
        """Leaves out edges without a score."""
        self.score = scores[self.token]
        ok = ~np.isnan(self.score)
        if not ok.all():
            self.row, self.end, self.length, self.token, self.score = (x[ok] for x in (self.row, self.end, self.length, self.token, self.score))
        return self

    def table(self, low: int, high: int, by_start: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(texts, positions, lengths): scores of the edges that end in (low, high], and their places; by start from
        ``low - band + 1`` on, if asked."""
        at = slice(*np.searchsorted(self.end, [low, high], side="right"))
        row, length = self.row[at], self.length[at] - 1
        place = self.end[at] - length - 1 - (low - self.band + 1) if by_start else self.end[at] - low - 1
        scores = np.full((self.n, high - low + (self.band if by_start else 0), self.band), NONE)
        edges = np.full(scores.shape if not by_start else (0,), -1, dtype=np.int64)
        scores[row, place, length] = self.score[at]
        if not by_start:
            edges[row, place, length] = np.arange(at.start, at.stop)
        return scores, edges

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of edges sorted by end: where those of each end begin, and the flat places of their starts and ends."""
        bounds = np.searchsorted(self.end, np.arange(self.last + 2))
        return bounds, (self.end - self.length) * self.n + self.row, self.end * self.n + self.row

    def tops(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, texts): the best score up to each position, and the edge that it ends with; of equal scores the
        shorter last token."""
        value, taken = np.full((self.last + 1, self.n), NONE), np.full((self.last + 1, self.n), -1, dtype=np.int64)
        value[0] = 0.0
        flat = value.reshape(-1)
        bounds, source, target = self.steps()
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else target
        many = np.diff(np.r_[first, len(target)])
        groups_at = np.searchsorted(first, bounds)
        for t in range(1, self.last + 1):
            low, high, g = bounds[t], bounds[t + 1], slice(groups_at[t], groups_at[t + 1])
            if low == high:
                continue
            reach = flat[source[low:high]] + self.score[low:high]
            top = np.maximum.reduceat(reach, first[g] - low)
            value[t, self.row[first[g]]] = top
            hit = low + np.flatnonzero(reach == np.repeat(top, many[g]))[::-1]
            taken[t, self.row[hit]] = hit  # the first of equal ones is written last
        taken[value == NONE] = -1
        return value, taken

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """The best score of each text, and the edges of its path in the order of ends. A text without a path has minus
        infinity and no edges."""
        value, taken = self.tops()
        score = value[self.size, np.arange(self.n)]
        at, chosen = np.where(score > NONE, self.size, 0), np.zeros(len(self.end), dtype=bool)
        while True:
            on = np.flatnonzero(at > 0)
            if not len(on):
                return score, np.flatnonzero(chosen)
            edge = taken[at[on], on]
            chosen[edge] = True
            at[on] -= self.length[edge]

    def shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best score, sum over its probability, weight of each edge): sums up to a position in units of its best path.

        So sums are plain numbers from 1 up to the number of paths, which for CHUNK characters is far from overflow.
        """
        top, _ = self.tops()
        bounds, source, target = self.steps()
        flat = top.reshape(-1)
        with np.errstate(invalid="ignore"):
            weight = np.exp(flat[source] + self.score - flat[target])
        weight[np.isnan(weight)] = 0.0
        value = np.zeros_like(top)
        value[0] = 1.0
        sums = value.reshape(-1)
        for t in range(1, self.last + 1):
            own = slice(bounds[t], bounds[t + 1])
            value[t] = np.bincount(self.row[own], weights=sums[source[own]] * weight[own], minlength=self.n)
        return top, value, weight

    def behind(self, weight: np.ndarray) -> np.ndarray:
        """(positions, texts): the sum from each position on, in the units of ``shares``."""
        bounds, source, _ = self.steps()
        value = np.zeros((self.last + 1, self.n))
        value[self.size, np.arange(self.n)] = 1.0
        sums = value.reshape(-1)
        for t in range(self.last, 0, -1):
            own = slice(bounds[t], bounds[t + 1])
            sums[source[own]] += weight[own] * value[t, self.row[own]]  # edges with one end have different starts
        return value

    def masses(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logarithm of the sum, expected tokens) of each whole text, and the probability of each edge."""
        top, before, weight = self.shares()
        after, (_, source, target), texts = self.behind(weight), self.steps(), np.arange(self.n)
        total = before[self.size, texts]
        with np.errstate(divide="ignore"):
            loglik = top[self.size, texts] + np.log(total)
        mass = before.reshape(-1)[source] * weight * after.reshape(-1)[target] / np.where(total > 0, total, 1.0)[self.row]
        return loglik, np.bincount(self.row, weights=mass, minlength=self.n).astype(np.float64), mass

    def nbest(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, score, number of edges) of the ``n`` best paths of each text, best first, equal scores with longer tokens
        in front first; and (path, edge) of all their edges, first to last.

        A path's boundaries are the bits of a number, the first ones the highest, so of two paths that with longer tokens
        in front has the smaller number. Texts with more characters than bits are searched one by one.
        """
        if self.last > BITS:
            return self._searched(n)
        texts, band = np.arange(self.n), self.band
        bounds, _, _ = self.steps()
        value, key = np.full((self.last + 1, self.n, n), NONE), np.zeros((self.last + 1, self.n, n), dtype=np.int64)
        value[0, :, 0] = 0.0
        choice = np.zeros((self.last + 1, self.n, n), dtype=np.int32)
        edge_at = np.full((self.last + 1, self.n, band), -1, dtype=np.int64)
        for t in range(1, self.last + 1):
            own = np.arange(bounds[t], bounds[t + 1])
            row, before = self.row[own], t - self.length[own]
            new = np.r_[True, row[1:] != row[:-1]][: len(row)]
            rows, place = row[new], np.cumsum(new) - 1
            reach, bits = np.full((len(rows), band, n), NONE), np.zeros((len(rows), band, n), dtype=np.int64)
            reach[place, self.length[own] - 1] = value[before, row] + self.score[own, None]
            bits[place, self.length[own] - 1] = key[before, row] | (1 << (BITS - t))
            reach, bits = reach.reshape(len(rows), -1), bits.reshape(len(rows), -1)
            pick = np.lexsort((bits, -reach), axis=-1)[:, :n]
            value[t, rows, : pick.shape[1]] = np.take_along_axis(reach, pick, axis=1)
            key[t, rows, : pick.shape[1]] = np.take_along_axis(bits, pick, axis=1)
            choice[t, rows, : pick.shape[1]] = pick
            edge_at[t, row, self.length[own] - 1] = own
        best = value[self.size, texts]
        text, rank = np.nonzero((best > NONE) & (self.size > 0)[:, None])
        score, at, many = best[text, rank], self.size[text].copy(), np.zeros(len(text), dtype=np.int64)
        paths, edges, on = [], [], np.arange(len(text))
        while len(on):
            taken = choice[at[on], text[on], rank[on]]
            edge = edge_at[at[on], text[on], taken // n]
            rank[on] = taken % n
            at[on] -= self.length[edge]
            many[on] += 1
            paths.append(on)
            edges.append(edge)
            on = on[at[on] > 0]
        path, edge = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in (paths, edges))
        by = np.argsort(path, kind="stable")
        return text, score, many, path[by], edge[by]

    def _searched(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        from lexiforge.operators.nbest import astar

        by = np.argsort(self.row, kind="stable")
        bounds = np.searchsorted(self.row[by], np.arange(self.n + 1))
        text, score, many, edges = [], [], [], []
        for i in np.flatnonzero(self.size > 0).tolist():
            own = by[bounds[i] : bounds[i + 1]]
            at: list[dict[int, int]] = [{} for _ in range(int(self.size[i]) + 1)]
            for edge, end, length in zip(own.tolist(), self.end[own].tolist(), self.length[own].tolist(), strict=True):
                at[end][length] = edge
            for total, lengths in astar([[(k, float(self.score[e])) for k, e in x.items()] for x in at], n):
                text.append(i)
                score.append(total)
                many.append(len(lengths))
                edges += [at[end][k] for end, k in zip(np.cumsum(lengths).tolist(), lengths, strict=True)]
        of = np.array(many, dtype=np.int64)
        return np.array(text, dtype=np.int64), np.array(score), of, np.repeat(np.arange(len(of)), of), np.array(edges, dtype=np.int64)

    def forward(self, start: np.ndarray, tokens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Logarithms of sums by position, columns ``band - 1`` on for positions 0 on; ``start`` (texts, band) for positions
        1 - band to 0. With ``tokens`` the expected number of tokens on the way, too. Both may have more rows a text."""
        times = len(start) // self.n
        scores = np.repeat(self.table(0, self.last)[0], times, axis=0) if times > 1 else self.table(0, self.last)[0]
        value = np.full((len(start), self.band + self.last), NONE)
        value[:, : self.band] = start
        count = None if tokens is None else np.zeros_like(value)
        if count is not None:
            count[:, : self.band] = tokens
        with np.errstate(divide="ignore", invalid="ignore"):
            for t in range(self.last):
                at = t + self.band
                reach = value[:, t:at][:, ::-1] + scores[:, t]
                top = reach.max(axis=1)
                share = np.exp(reach - np.where(top > NONE, top, 0.0)[:, None])
                total = share.sum(axis=1)
                value[:, at] = top + np.log(total)
                if count is not None:
                    count[:, at] = np.where(total > 0, (share * (count[:, t:at][:, ::-1] + 1)).sum(axis=1) / total, 0.0)
        return value, count

    def backward(self, end: np.ndarray) -> np.ndarray:
        """Logarithms of sums from each position on, columns as in ``forward``; ``end`` has the same columns, with what
        follows behind the text."""
        scores, value = self.table(0, self.last, by_start=True)[0], end.copy()
        with np.errstate(divide="ignore", invalid="ignore"):
            for at in range(value.shape[1] - 2, -1, -1):
                width = min(self.band, value.shape[1] - 1 - at)
                reach = value[:, at + 1 : at + 1 + width] + scores[:, at, :width]
                top = np.maximum(reach.max(axis=1), value[:, at])
                base = np.where(top > NONE, top, 0.0)
                value[:, at] = top + np.log(np.exp(reach - base[:, None]).sum(axis=1) + np.exp(value[:, at] - base))
        return value

    def last_columns(self) -> np.ndarray:
        """Of each text, the columns of the ``band`` positions up to its end."""
        return self.size[:, None] + np.arange(self.band)[None, :]

    def edge_masses(self, before: np.ndarray, after: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The probability of each edge, given the sums before and after each position and those of the whole lines."""
        at = self.end + self.band - 1
        with np.errstate(invalid="ignore"):
            mass = np.exp(before[self.row, at - self.length] + self.score + after[self.row, at] - total[self.row])
        return np.where(total[self.row] > NONE, mass, 0.0)

    def unit(self) -> tuple[np.ndarray, np.ndarray]:
        """The vectors at the ends of whole texts."""
        start, end = np.full((self.n, self.band), NONE), np.full((self.n, self.band + self.last), NONE)
        start[:, -1] = 0.0
        end[np.arange(self.n), self.band - 1 + self.size] = 0.0
        return start, end


def groups(texts: list[str], band: int) -> Iterator[list[int]]:
    """The texts by length, in groups whose tables have about CELLS cells."""
    own: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if own and (len(own) + 1) * (len(texts[own[0]]) + 1) * band > CELLS:
            yield own
            own = []
        own.append(i)
    if own:
        yield own


def scores_of(made: Matcher, scores: Broadcast | None) -> np.ndarray:
    return made.scores if scores is None else scores.value


def parts(texts: list[str], size: int = 1 << 22) -> Iterator[slice]:
    """Stretches of ``texts`` of about ``size`` characters."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text) + 1
        if total > size:
            yield slice(first, i + 1)
            first, total = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


class Words:
    """The distinct words of some lines, cut in front of every head mark where no token reaches across one (``heads``), and
    the words of each line, as their places; with ``blanks`` the words stand between blanks and get their head marks."""

    def __init__(self, lines: list[str], heads: bool, blanks: bool = False) -> None:
        cut = (lambda t: [HEAD + w for w in t.split(" ") if w]) if blanks else (lambda t: [*([p[0]] if (p := t.split(HEAD))[0] else []), *(HEAD + w for w in p[1:])]) if heads else (lambda t: [t] if t else [])
        known: dict[str, int] = {}
        place, many = [], []
        for line in lines:
            own = cut(line)
            many.append(len(own))
            place += [known.setdefault(w, len(known)) for w in own]
        self.texts, self.place, self.many = list(known), np.array(place, dtype=np.int64), np.array(many, dtype=np.int64)
        self.line = np.repeat(np.arange(len(lines)), self.many)

    def groups(self, made: Matcher, scores: np.ndarray) -> Iterator[tuple[list[int], Group]]:
        for own in groups(self.texts, 4):
            yield own, Group([self.texts[i] for i in own], made).scored(scores)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """By line, a value of each word."""
        return np.bincount(self.line, weights=values[self.place], minlength=len(self.many)).astype(np.float64)

    def best(self, made: Matcher, scores: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Pieces, ids and score of every line; no pieces where a word has no path."""
        score, order, found = np.zeros(len(self.texts)), [], ([pa.array([], pa.list_(pa.string()))], [pa.array([], pa.list_(pa.int32()))])
        for own, group in self.groups(made, scores):
            score[own], ends = group.best()
            for out, made_of in zip(found, piece_arrays([self.texts[i] for i in own], group, ends, score[own], made.ids), strict=True):
                out.append(made_of)
            order += own
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.arange(len(order))
        total = self.summed(score)
        solved = (total > NONE)[self.line]
        of_line = np.r_[0, np.cumsum(np.bincount(self.line[solved], minlength=len(self.many)))]
        pick, columns = pa.array(at[self.place[solved]]), []
        for chunks_of in found:
            taken = pa.concat_arrays(chunks_of).take(pick)
            of_word = np.r_[0, np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False))]
            columns.append(pa.ListArray.from_arrays(pa.array(of_word[of_line].astype(np.int32)), taken.flatten()))
        return columns[0], columns[1], total


def word_paths(lines: Words, made: Matcher, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The ``n`` best paths of each distinct word, those with longer tokens in front first: (words, n) their scores and
    their places, and of each place the score and the pieces."""
    value, place = np.full((len(lines.texts), n), NONE), np.zeros((len(lines.texts), n), dtype=np.int64)
    sums, pieces, made_so_far = [np.zeros(0)], [pa.array([], pa.list_(pa.string()))], 0
    for own, group in lines.groups(made, scores):
        text, score, many, path, edge = group.nbest(n)
        bits = np.zeros((len(text), group.last + 1), dtype=bool)
        bits[path, group.end[edge]] = True
        order = np.lexsort((*np.packbits(bits, axis=1).T[::-1], text))
        column = np.arange(len(text)) - np.searchsorted(text, text)  # texts are in order
        word = np.array(own, dtype=np.int64)[text]
        value[word, column], place[word, column] = score[order], made_so_far + order
        sums.append(score)
        pieces.append(path_pieces([lines.texts[i] for i in own], group, text, many, edge))
        made_so_far += len(text)
    return value, place, np.concatenate(sums), pa.concat_arrays(pieces)


def line_paths(lines: Words, made: Matcher, scores: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(line, rank, score, pieces) of the ``n`` best paths of each line, from those of its words.

    Words are joined from the last to the first: of equal scores the path goes first whose first word has the longer tokens
    in front, then that with the better rest.
    """
    value, place, sums, pieces = word_paths(lines, made, scores, n)
    by = np.argsort(-lines.many, kind="stable")
    by = by[lines.many[by] > 0]
    starts = np.cumsum(lines.many) - lines.many
    step = max(1, (CELLS << 1) // (n * n))
    for first in range(0, len(by), step):
        own = by[first : first + step]
        start, many = starts[own], lines.many[own]
        rest = np.full((len(own), n), NONE)
        rest[:, 0] = 0.0
        before = np.cumsum(many) - many
        choice = np.zeros((int(many.sum()), n), dtype=np.int32)
        for back in range(1, int(many[0]) + 1):
            on = int(np.searchsorted(-many, -back, side="right"))
            at = many[:on] - back
            reach = (value[lines.place[start[:on] + at]][:, :, None] + rest[:on, None, :]).reshape(on, -1)
            pick = np.argsort(-reach, axis=1, kind="stable")[:, :n]
            rest[:on] = np.take_along_axis(reach, pick, axis=1)
            choice[before[:on] + at] = pick
        rank = np.tile(np.arange(n), (len(own), 1))
        taken = np.zeros((len(choice), n), dtype=np.int64)
        for at in range(int(many[0])):
            on = int(np.searchsorted(-many, -at, side="left"))
            pick = np.take_along_axis(choice[before[:on] + at], rank[:on], axis=1)
            taken[before[:on] + at] = np.take_along_axis(place[lines.place[start[:on] + at]], pick // n, axis=1)
            rank[:on] = pick % n
        line, which = np.nonzero(rest > NONE)
        path = np.repeat(np.arange(len(line)), many[line])
        within = np.arange(len(path)) - np.repeat(np.cumsum(many[line]) - many[line], many[line])
        words = taken[before[line][path] + within, which[path]]
        found = pieces.take(pa.array(words))
        of_word = np.r_[0, np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))]
        offsets = of_word[np.r_[0, np.cumsum(many[line])]].astype(np.int32)
        score = np.bincount(path, weights=sums[words], minlength=len(line)).astype(np.float64)
        yield own[line], which + 1, score, pa.ListArray.from_arrays(pa.array(offsets), found.flatten())


def is_long(made: Matcher, size: int) -> F.Column:
    """Whether a segment has a stretch of more than ``size`` characters that has to be solved in one piece."""
    return F.col("seg").rlike(f"[^{HEAD}]{{{size}}}") if made.heads else F.length("seg") > size


# --- lattices and best paths -------------------------------------------------------------------


def lattice_arrays(segments: DataFrame, tries: Broadcast, scored: bool = False) -> DataFrame:
    """(seg, weight, ed) of ``segments(seg, weight)``: the edges (e, l, token_id) as ``edge_arrays`` of ``lattice`` has them,
    from a walk instead of a join; with ``scored`` their scores, too, as ``lp``, and no edge without one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        for batch in batches:
            group = Group(batch.column(0).to_pylist(), made)
            group = group.scored(made.scores) if scored else group
            by = np.argsort(group.row, kind="stable")
            offsets = np.searchsorted(group.row[by], np.arange(group.n + 1)).astype(np.int32)
            fields = [group.end[by].astype(np.int32), group.length[by].astype(np.int32), made.ids[group.token[by]]]
            fields += [group.score[by]] if scored else []
            edges = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["e", "l", "token_id", "lp"][: len(fields)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), edges)], names=["seg", "weight", "ed"])

    return spread(segments).select("seg", "weight").mapInArrow(run, f"seg string, weight long, ed array<struct<e:int,l:int,token_id:int{',lp:double' if scored else ''}>>")


def apart(group: Group) -> np.ndarray:
    """For each token of a group how often it occurs, of occurrences that overlap the first from the left."""
    start = group.end - group.length
    by = np.lexsort((start, group.row, group.token))
    token, start, length = group.token[by].astype(np.int64), start[by], group.length[by]
    span = group.last + group.band + 1
    place = (token * group.n + group.row[by]) * span + start  # ascending
    after = np.searchsorted(place, place + length)  # the next occurrence that does not overlap, if it has the same line
    same = np.r_[place // span, -1]
    after = np.where(same[after] == same[:-1], after, len(place))
    times, to = np.r_[np.ones(len(place), np.int64), 0], np.r_[after, len(place)]
    while (to < len(place)).any():
        times, to = times + times[to], to[to]
    first = np.flatnonzero(np.r_[True, same[1:-1] != same[:-2]]) if len(place) else np.zeros(0, np.int64)
    return np.bincount(token[first], weights=times[first]).astype(np.int64)


def entry_counts(lines: DataFrame, tries: Broadcast) -> DataFrame:
    """(token_id, freq): non-overlapping occurrences of every token in every line of ``lines(seg)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for own in groups(texts, 1):
                times = apart(Group([texts[i] for i in own], made))
                token = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array(made.ids[token]), pa.array(times[token])], names=["token_id", "freq"])

    return lines.select("seg").mapInArrow(run, "token_id int, freq long").groupBy("token_id").agg(F.sum("freq").alias("freq"))


def piece_arrays(texts: list[str], group: Group, ends: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Pieces and ids of the texts of a group: its pieces, end to end, are its texts, so only their offsets are computed."""
    edges = ends[np.lexsort((group.end[ends], group.row[ends]))]
    solved = np.flatnonzero(score > NONE)
    data = "".join(texts[i] for i in solved.tolist())
    points = code_points(data)
    width = np.cumsum(np.r_[0, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)])
    before = np.zeros(group.n, dtype=np.int64)
    before[solved] = np.cumsum(group.size[solved]) - group.size[solved]
    stops = width[before[group.row[edges]] + group.end[edges]]
    pieces = pa.StringArray.from_buffers(len(edges), pa.py_buffer(np.r_[0, stops].astype(np.int32).tobytes()), pa.py_buffer(data.encode()))
    offsets = pa.array(np.searchsorted(group.row[edges], np.arange(group.n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pieces), pa.ListArray.from_arrays(offsets, pa.array(ids[group.token[edges]]))


def best_paths_by_trie(segments: DataFrame, tries: Broadcast, scores: Broadcast | None = None, keep: str = "weight") -> DataFrame:
    """(seg, weight, pieces, ids, score) of ``segments(seg, weight)``, as ``best_paths`` has them, for any length; an empty
    or null segment has no pieces. ``keep``: the column that is handed on beside ``seg``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for own in parts(texts):
                pieces, ids, score = Words(texts[own], made.heads).best(made, scores_of(made, scores))
                yield pa.RecordBatch.from_arrays([pa.array(texts[own], pa.string()), batch.column(1)[own], pieces, ids, pa.array(score)], names=["seg", keep, "pieces", "ids", "score"])

    return segments.select("seg", keep).mapInArrow(run, f"seg string, {keep} {dict(segments.dtypes)[keep]}, {PIECES}")


def word_segments_by_trie(lines: DataFrame, tries: Broadcast, key: str) -> DataFrame:
    """(key, pieces, ids) of ``lines(key, words)``, words between blanks: the distinct words of a batch are solved once,
    where they are. No word is shuffled, so frequent ones load no task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        for batch in batches:
            lines = [t or "" for t in batch.column(1).to_pylist()]
            for own in parts(lines):
                pieces, ids, _ = Words(lines[own], made.heads, blanks=True).best(made, made.scores)
                yield pa.RecordBatch.from_arrays([batch.column(0)[own], pieces, ids], names=[key, "pieces", "ids"])

    kind = dict(lines.dtypes)[key]
    return lines.select(key, "words").mapInArrow(run, f"{key} {kind}, pieces array<string>, ids array<int>")


def ids_by_trie(lines: DataFrame, tries: Broadcast, key: str) -> DataFrame:
    """(key, ids) of ``lines(key, pieces)``; the distinct pieces of a batch are looked up once, where they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        unk = made.ids[made.unk] if made.unk >= 0 else -1
        for batch in batches:
            pieces = batch.column(1).flatten().dictionary_encode()
            texts = pieces.dictionary.to_pylist()
            found = np.full(len(texts), unk, dtype=np.int32)
            if texts:
                group = Group(texts, made, unknown=False)
                whole = group.length == group.size[group.row]
                found[group.row[whole]] = made.ids[group.token[whole]]
            offsets = np.r_[0, np.cumsum([x or 0 for x in batch.column(1).value_lengths().to_pylist()])].astype(np.int32)
            known = found[pieces.indices.to_numpy(zero_copy_only=False)]
            ids = pa.array(known, mask=known < 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=[key, "ids"])

    named = F.transform("pieces", lambda p: F.coalesce(p, F.lit("")))
    return lines.select(key, named.alias("pieces")).mapInArrow(run, f"{key} {dict(lines.dtypes)[key]}, ids array<int>")


# --- edge arrays -------------------------------------------------------------------------------


def edges_of(batch: pa.RecordBatch, size: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, Group]]:
    """Stretches of a batch (seg, weight, ed), of texts of similar length, with their edges."""
    lengths = np.array([len(t) for t in batch.column(0).to_pylist()], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    first = 0
    while first < len(order):
        many = max(1, size // max(1, int(lengths[order[first]])))
        part = batch.take(pa.array(order[first : first + many]))
        ed = part.column(2)
        flat = ed.flatten()
        field = lambda name: flat.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        row = np.repeat(np.arange(len(part)), ed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        whole = [field(name).astype(np.int64) for name in ("e", "l", "token_id")]
        yield part, Group.of_edges(lengths[order[first : first + many]], row, *whole, field("lp").astype(np.float64))
        first += many


def path_pieces(texts: list[str], group: Group, text: np.ndarray, many: np.ndarray, edge: np.ndarray) -> pa.Array:
    """The pieces of paths: of each path its text, its number of edges, and all their edges in order."""
    data = "".join(texts[i] for i in text.tolist())
    points = code_points(data)
    width = np.cumsum(np.r_[0, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)])
    stops = width[np.cumsum(group.length[edge])]
    pieces = pa.StringArray.from_buffers(len(edge), pa.py_buffer(np.r_[0, stops].astype(np.int32).tobytes()), pa.py_buffer(data.encode()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pieces)


def masses_of_edges(scored: DataFrame) -> DataFrame:
    """(token_id, mass): the E-step over ``scored(seg, weight, ed)``, each segment's masses scaled to its weight."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, group in edges_of(batch):
                _, tokens, mass = group.masses()
                scale = part.column(1).to_numpy(zero_copy_only=False) / np.where(tokens > 0, tokens, 1.0)
                token, at = np.unique(group.token, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(np.bincount(at, weights=mass * scale[group.row], minlength=len(token)).astype(np.float64))], names=["token_id", "mass"])

    return scored.select("seg", "weight", "ed").mapInArrow(run, "token_id int, mass double").groupBy("token_id").agg(F.sum("mass").alias("mass"))


def sums_of_edges(scored: DataFrame) -> DataFrame:
    """(seg, weight, loglik, expected_tokens) of ``scored(seg, weight, ed)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, group in edges_of(batch):
                loglik, tokens, _ = group.masses()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(loglik), pa.array(tokens)], names=["seg", "weight", "loglik", "expected_tokens"])

    return scored.select("seg", F.col("weight").cast("long"), "ed").mapInArrow(run, "seg string, weight long, loglik double, expected_tokens double")


def nbest_of_edges(scored: DataFrame, n: int) -> DataFrame:
    """(seg, weight, rank, pieces, score) of ``scored(seg, weight, ed)``: the ``n`` best paths."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, group in edges_of(batch):
                text, score, many, _, edge = group.nbest(n)
                rank = np.arange(len(text)) - np.searchsorted(text, text) + 1
                pieces = path_pieces(part.column(0).to_pylist(), group, text, many, edge)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(rank.astype(np.int32)), pieces, pa.array(score)], names=["seg", "weight", "rank", "pieces", "score"])

    return scored.select("seg", F.col("weight").cast("long"), "ed").mapInArrow(run, "seg string, weight long, rank int, pieces array<string>, score double")


def samples_of_edges(scored: DataFrame, n: int, seed: int) -> DataFrame:
    """(seg, weight, draw, pieces, ids) of ``scored(seg, weight, ed)``: ``n`` paths drawn backwards from the sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, group in edges_of(batch):
                texts = part.column(0).to_pylist()
                _, value, weight = group.shares()
                _, source, target = group.steps()
                flat = value.reshape(-1)
                share = flat[source] * weight / np.where(flat[target] > 0, flat[target], 1.0)
                table, edges = np.zeros((group.last + 1, group.n, group.band)), np.full((group.last + 1, group.n, group.band), -1, dtype=np.int64)
                table[group.end, group.row, group.length - 1] = share
                edges[group.end, group.row, group.length - 1] = np.where(flat[source] > 0, np.arange(len(source)), -1)
                text = np.repeat(np.arange(group.n), n)
                draw = np.tile(np.arange(1, n + 1), group.n)
                at = group.size[text].copy()
                at[flat.reshape(value.shape)[group.size, np.arange(group.n)][text] <= 0] = 0
                heads = [f"{seed}:{texts[t]}:{d}:".encode() for t, d in zip(text.tolist(), draw.tolist(), strict=True)]
                paths, found, on = [], [], np.flatnonzero(at > 0)
                while len(on):
                    u = np.array([(int(md5(heads[i] + str(a).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52) for i, a in zip(on.tolist(), at[on].tolist(), strict=True)])
                    own = edges[at[on], text[on]]
                    there = own >= 0
                    enough = there & (np.cumsum(table[at[on], text[on]], axis=1) >= u[:, None])
                    last = group.band - 1 - there[:, ::-1].argmax(axis=1)
                    pick = own[np.arange(len(on)), np.where(enough.any(axis=1), enough.argmax(axis=1), last)]
                    paths.append(on)
                    found.append(pick)
                    at[on] -= group.length[pick]
                    on = on[at[on] > 0]
                path, edge = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in (paths, found))
                edge = edge[np.argsort(path, kind="stable")]
                many = np.bincount(path, minlength=len(text))
                texts_of = np.where(many > 0, text, -1)
                pieces = path_pieces([*texts, ""], group, texts_of, many, edge)
                ids = pa.ListArray.from_arrays(pieces.offsets, pa.array(group.token[edge].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(draw.astype(np.int32)), pieces, ids], names=["seg", "weight", "draw", "pieces", "ids"])

    return scored.select("seg", F.col("weight").cast("long"), "ed").mapInArrow(run, "seg string, weight long, draw int, pieces array<string>, ids array<int>")


# --- sums over paths ---------------------------------------------------------------------------

MASS = "token_id int, mass double"
CUT = "k string, weight long, chunk long, last boolean, left_chars int, text string"
MATRIX = CUT + ", sums array<double>, counts array<double>"
FORWARD = MATRIX + ", start array<double>, total double, tokens double"
ENDS = CUT + ", start array<double>, end array<double>, total double, tokens double"


def token_masses(group: Group, mass: np.ndarray, made: Matcher) -> pa.RecordBatch:
    """(token_id, mass): the sums of a group, a row per token."""
    token, at = np.unique(group.token, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(made.ids[token]), pa.array(np.bincount(at, weights=mass, minlength=len(token)).astype(np.float64))], names=["token_id", "mass"])


def short_masses(segments: DataFrame, tries: Broadcast, scores: Broadcast | None, normalize: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        for batch in batches:
            texts, weights = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=np.float64)
            for own in parts(texts, 1 << 20):
                lines, found = Words(texts[own], made.heads), []
                tokens = np.zeros(len(lines.texts))
                ok = np.zeros(len(lines.texts))
                for place, group in lines.groups(made, scores_of(made, scores)):
                    loglik, tokens[place], mass = group.masses()
                    ok[place] = np.where(loglik > NONE, 0.0, NONE)
                    found.append((place, group, mass))
                scale = np.where(lines.summed(ok) > NONE, weights[own], 0.0)  # a line with a word that has no path has none
                if normalize == "line":
                    scale = scale / np.maximum(lines.summed(tokens), 1e-300)
                times = np.bincount(lines.place, weights=scale[lines.line], minlength=len(lines.texts))
                for place, group, mass in found:
                    yield token_masses(group, mass * times[place][group.row], made)

    return segments.select("seg", F.col("weight").cast("long")).mapInArrow(run, MASS)


def chunks(segments: DataFrame, band: int, size: int = CHUNK) -> DataFrame:
    """``segments(seg, weight)`` in rows of ``size`` characters, each with the ``band - 1`` characters before it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = range(0, len(text), size)
                rows = [(key, weight, n, at + size >= len(text), min(at, band - 1), text[max(0, at - band + 1) : at + size]) for n, at in enumerate(starts)]
                for first in range(0, len(rows), 1024):
                    part = rows[first : first + 1024]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate(kinds)], names=["k", "weight", "chunk", "last", "left_chars", "text"])

    return segments.select(F.sha2("seg", 256).alias("k"), "seg", F.col("weight").cast("long")).mapInArrow(run, CUT)


def doubles(rows: np.ndarray) -> pa.Array:
    """A list column of the rows of a table."""
    flat = np.ascontiguousarray(rows, dtype=np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * (flat.size // max(1, len(flat)))), pa.array(flat.reshape(-1)))


def table_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def chunk_groups(batch: pa.RecordBatch, made: Matcher, scores: Broadcast | None, times: int) -> Iterator[tuple[pa.RecordBatch, Group]]:
    texts, left = batch.column(5).to_pylist(), np.array(batch.column(4).to_pylist(), dtype=np.int64)
    for own in groups(texts, made.longest * times):
        yield batch.take(pa.array(own)), Group([texts[i] for i in own], made, left[own]).scored(scores_of(made, scores))


def chunk_matrices(cut: DataFrame, tries: Broadcast, scores: Broadcast | None) -> DataFrame:
    """``cut`` with each chunk's matrix of sums and of expected numbers of tokens: from the positions up to its start to
    those up to its end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        for batch in batches:
            for rows, group in chunk_groups(batch, made, scores, made.longest):
                n, band = group.n, group.band
                start = np.tile(np.where(np.eye(band) > 0, 0.0, NONE), (n, 1))
                value, count = group.forward(start, np.zeros_like(start))
                at = np.repeat(group.last_columns(), band, axis=0)
                pick = lambda table: np.take_along_axis(table, at, axis=1).reshape(n, band * band)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*rows.columns, doubles(pick(value)), doubles(pick(count))], names=[*rows.schema.names, "sums", "counts"])

    return cut.repartition("k", "chunk").mapInArrow(run, MATRIX)


def log_sums(values: np.ndarray) -> np.ndarray:
    """By columns; minus infinity where all are."""
    top = values.max(axis=0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(values - np.where(top > NONE, top, 0.0)).sum(axis=0))


def forward_vectors(matrices: DataFrame) -> DataFrame:
    """``matrices`` with the vector at each chunk's start; the last chunk of a line has its sum and its expected tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value, count = None, None, None
        for batch in batches:
            keys, starts, totals, tokens = batch.column(0).to_pylist(), [], [], []
            sums, counts = table_of(batch.column(6)), table_of(batch.column(7))
            band = int(round(sums.shape[1] ** 0.5)) if len(keys) else 1
            for k, s, c in zip(keys, sums, counts, strict=True):
                if k != key:
                    key, value, count = k, np.full(band, NONE), np.zeros(band)
                    value[-1] = 0.0
                starts.append(value)
                reach = value[:, None] + s.reshape(band, band)
                new = log_sums(reach)
                share = np.exp(reach - np.where(new > NONE, new, 0.0)[None, :])
                count = (share * (count[:, None] + c.reshape(band, band))).sum(axis=0)
                value = new
                totals.append(value[-1])
                tokens.append(count[-1])
            if keys:
                yield pa.RecordBatch.from_arrays([*batch.columns, doubles(np.array(starts)), pa.array(totals, pa.float64()), pa.array(tokens, pa.float64())], names=[*batch.schema.names, "start", "total", "tokens"])

    return matrices.repartition("k").sortWithinPartitions("k", "chunk").mapInArrow(run, FORWARD)


def backward_vectors(forward: DataFrame) -> DataFrame:
    """``forward`` with the vector at each chunk's end, and the line's sum and expected tokens in every chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value, total, tokens = None, None, None, None
        for batch in batches:
            keys, ends, totals, counts = batch.column(0).to_pylist(), [], [], []
            sums = table_of(batch.column(6))
            band = int(round(sums.shape[1] ** 0.5)) if len(keys) else 1
            for k, s, z, e in zip(keys, sums, batch.column(9).to_pylist(), batch.column(10).to_pylist(), strict=True):
                if k != key:
                    key, value, total, tokens = k, np.full(band, NONE), z, e
                    value[-1] = 0.0
                ends.append(value)
                totals.append(total)
                counts.append(tokens)
                value = log_sums((s.reshape(band, band) + value[None, :]).T)
            if keys:
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], batch.column(8), doubles(np.array(ends)), pa.array(totals, pa.float64()), pa.array(counts, pa.float64())], names=[*batch.schema.names[:6], "start", "end", "total", "tokens"])

    return forward.repartition("k").sortWithinPartitions("k", F.desc("chunk")).mapInArrow(run, ENDS)


def long_masses(segments: DataFrame, tries: Broadcast, scores: Broadcast | None, normalize: str, chunk: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        for batch in batches:
            for rows, group in chunk_groups(batch, made, scores, 1):
                start, given = table_of(rows.column(6)), table_of(rows.column(7))
                total, tokens = (np.array(rows.column(c).to_pylist(), dtype=np.float64) for c in (8, 9))
                end = np.full((group.n, group.band + group.last), NONE)
                np.put_along_axis(end, group.last_columns(), given, axis=1)
                mass = group.edge_masses(group.forward(start)[0], group.backward(end), total)
                scale = np.array(rows.column(1).to_pylist(), dtype=np.float64)
                if normalize == "line":
                    scale = scale / np.where(tokens > 0, tokens, 1.0)
                yield token_masses(group, mass * scale[group.row], made)

    cut = chunks(segments, tries.value.longest, chunk)
    ends = backward_vectors(forward_vectors(chunk_matrices(cut, tries, scores)))
    return ends.repartition("k", "chunk").mapInArrow(run, MASS)


def em_counts_by_trie(segments: DataFrame, tries: Broadcast, scores: Broadcast | None = None, normalize: str = "line", chunk: int = CHUNK) -> DataFrame:
    """(token_id, mass): the E-step over ``segments(seg, weight)`` of any length, words or lines.

    Each task sends one row for a token of a group; lines of more than ``chunk`` characters go in chunks.
    """
    long = is_long(tries.value, chunk)
    short = short_masses(segments.where(~long), tries, scores, normalize)
    long = long_masses(segments.where(long), tries, scores, normalize, chunk)
    return short.union(long).groupBy("token_id").agg(F.sum("mass").alias("mass"))


def line_sums(segments: DataFrame, tries: Broadcast, scores: Broadcast | None = None, chunk: int = CHUNK) -> DataFrame:
    """(seg_sha256, loglik, expected_tokens) of ``segments(seg, weight)`` of any length; empty ones are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tries.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for own in parts(texts):
                lines = Words(texts[own], made.heads)
                loglik, tokens = np.zeros(len(lines.texts)), np.zeros(len(lines.texts))
                for place, group in lines.groups(made, scores_of(made, scores)):
                    loglik[place], tokens[place], _ = group.masses()
                total = lines.summed(loglik)
                yield pa.RecordBatch.from_arrays([batch.column(0)[own], pa.array(total), pa.array(np.where(total > NONE, lines.summed(tokens), 0.0))], names=["seg_sha256", "loglik", "expected_tokens"])

    some, long = spread(segments), is_long(tries.value, chunk)
    short = some.where(~long).select(F.sha2("seg", 256).alias("k"), "seg").mapInArrow(run, "seg_sha256 string, loglik double, expected_tokens double")
    cut = chunks(some.where(long), tries.value.longest, chunk)
    ends = forward_vectors(chunk_matrices(cut, tries, scores)).where("last")
    return short.union(ends.select(F.col("k").alias("seg_sha256"), F.col("total").alias("loglik"), F.col("tokens").alias("expected_tokens")))
