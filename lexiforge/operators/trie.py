"""A vocabulary as a double-array trie: built once, sent to the executors once, walked once a position.

A state is a slot of two arrays; the slot of its child by character c is ``base[state] + c`` if ``check`` there names the
state. Tasks follow all places of all texts of a batch at the same time, a character a step, so no substring is made,
shuffled or joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.patterns import HEAD, UNK

#: A vocabulary is sent to the executors up to this size (some 60 bytes a token); larger ones take the joins of lattice.py.
MAX_TOKENS = 1_000_000
BLOCK = 512


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class DoubleArray:
    """Tokens by their place in ``tokens``, which are distinct and not empty."""

    def __init__(self, tokens: list[str]) -> None:
        order = sorted(range(len(tokens)), key=tokens.__getitem__)  # by code points
        lengths = np.array([len(tokens[i]) for i in order], dtype=np.int64)
        points = code_points("".join(tokens[i] for i in order))
        self.alphabet, codes = np.unique(points, return_inverse=True)
        self.longest = int(lengths.max()) if len(tokens) else 0
        starts = np.cumsum(lengths) - lengths
        parents, letters, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(tokens), dtype=np.int64)
        nodes, at = 1, np.zeros(len(tokens), dtype=np.int64)  # 0 is the root; at: the node of each token's prefix
        for depth in range(self.longest):
            row = np.flatnonzero(lengths > depth)
            code, above = codes[starts[row] + depth] + 1, at[row]
            new = np.r_[True, (code[1:] != code[:-1]) | (above[1:] != above[:-1])]
            at[row] = nodes + np.cumsum(new) - 1
            parents.append(above[new])
            letters.append(code[new])
            nodes += int(new.sum())
            ends[row[lengths[row] == depth + 1]] = at[row[lengths[row] == depth + 1]]
        self._place(nodes, np.concatenate(parents), np.concatenate(letters))
        self.value = np.full(len(self.check), -1, dtype=np.int32)
        self.value[self.slot[ends]] = order
        del self.slot

    def _place(self, nodes: int, parent: np.ndarray, letter: np.ndarray) -> None:
        """Gives every node a slot: those with several children where all of them fit, the others into what is left."""
        by = np.lexsort((letter, parent))
        child, letter, parent = by + 1, letter[by], parent[by]
        families = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[families, len(parent)])
        width = len(self.alphabet) + 1
        free = np.ones(nodes + width + BLOCK, dtype=bool)
        free[0] = False
        offset = np.zeros(nodes, dtype=np.int64)
        self.slot = np.zeros(nodes, dtype=np.int64)
        low = 1
        for f in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            mine = slice(families[f], families[f] + sizes[f])
            own, start = letter[mine], low
            while True:
                if start + BLOCK + width > len(free):
                    free = np.r_[free, np.ones(len(free), dtype=bool)]
                places = np.flatnonzero(free[start : start + BLOCK]) + start
                for c in own[1:]:
                    places = places[free[places + (c - own[0])]]
                if len(places):
                    break
                start += BLOCK
            if start > low + 2 * BLOCK:  # hardly any room below; single children fill it
                low = start
            slots = places[0] + own - own[0]
            free[slots] = False
            offset[parent[families[f]]] = places[0] - own[0]
            self.slot[child[mine]] = slots
        single = families[sizes == 1]
        if np.count_nonzero(free) < len(single):
            free = np.r_[free, np.ones(len(single), dtype=bool)]
        slots = np.flatnonzero(free)[: len(single)]
        offset[parent[single]] = slots - letter[single]
        self.slot[child[single]] = slots
        size = int(self.slot.max()) + 1
        self.base = np.zeros(size + width, dtype=np.int32)
        self.check = np.full(size + 2 * width, -1, dtype=np.int32)
        self.base[self.slot] = offset
        self.check[self.slot[child]] = self.slot[parent]

    def encode(self, points: np.ndarray) -> np.ndarray:
        """Codes of characters; 0 where no token has one."""
        if not len(self.alphabet):
            return np.zeros(len(points), dtype=np.int32)
        top = int(self.alphabet[-1]) + 1
        code = np.zeros(top + 1, dtype=np.int32)
        code[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return code[np.minimum(points, top)]

    def walk(self, codes: np.ndarray, longest: int | None = None, stride: int = 1, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, token) of every occurrence of every token in ``codes``, in which 0 matches nothing; the next
        character stands ``stride`` places on, and ``state`` may give each place a state to begin in (-1: none)."""
        starts, found = np.arange(len(codes)), []
        state = np.zeros(len(codes), dtype=np.int64) if state is None else state
        if len(state) and state.min() < 0:
            starts = np.flatnonzero(state >= 0)
            state = state[starts]
        padded = np.r_[codes, np.zeros((self.longest + 1) * stride, dtype=codes.dtype)]
        for depth in range(min(self.longest, longest or self.longest)):
            code = padded[starts + depth * stride]
            to = self.base[state] + code
            ok = (code > 0) & (to >= 0)
            ok[ok] = self.check[to[ok]] == state[ok]
            starts, state = starts[ok], to[ok]
            if not len(starts):
                break
            token = self.value[state]
            hit = token >= 0
            found.append((starts[hit], np.full(int(hit.sum()), depth + 1), token[hit]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def descend(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, state) of the places from which ``depth`` characters can be followed."""
        starts, state = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        padded = np.r_[codes, np.zeros(depth, dtype=codes.dtype)]
        for step in range(depth):
            code = padded[starts + step]
            to = self.base[state] + code
            ok = (code > 0) & (to >= 0)
            ok[ok] = self.check[to[ok]] == state[ok]
            starts, state = starts[ok], to[ok].astype(np.int64)
        return starts, state


@dataclass
class Matcher:
    """A trie with the ids and the scores of its tokens; a score that is not a number means no edge."""

    trie: DoubleArray
    ids: np.ndarray
    unk: int  # the place of the unknown token, or -1
    scores: np.ndarray | None = None
    longest: int = 1
    names: list[str] = field(default_factory=list)
    heads: bool = False  # a head mark stands only at the front of tokens, so no token reaches from one word into the next
    behind: int = 0  # the state in which pieces behind the first begin, or -1


def fits(vocab: DataFrame) -> bool:
    return vocab.count() <= MAX_TOKENS


def matcher(vocab: DataFrame, max_length: int | None = None, use_unk: bool = True, score: str | None = None, prefix: str = "") -> Broadcast:
    """The trie of ``vocab(token_id, token)``, of a checked size, on its way to the executors; ``score``: a column of it;
    ``prefix``: what tokens for later pieces of a segment begin with."""
    columns = ["token_id", "token"] + ([score] if score else [])
    rows = vocab.where("token <> ''").select(*columns).orderBy("token_id").limit(MAX_TOKENS + 1).collect()
    if len(rows) > MAX_TOKENS:
        raise ValueError(f"a vocabulary of more than {MAX_TOKENS} tokens: use the joins of lattice.py")
    tokens = [r[1] for r in rows]
    unk = tokens.index(UNK) if use_unk and UNK in tokens else -1
    scores = np.array([np.nan if r[2] is None else float(r[2]) for r in rows]) if score else None
    trie = DoubleArray(tokens)
    made = Matcher(trie, np.array([r[0] for r in rows], dtype=np.int32), unk, scores, max(1, min(trie.longest, max_length or trie.longest)), heads=not any(HEAD in t[1:] for t in tokens))
    if prefix:
        state = trie.descend(trie.encode(code_points(prefix)), len(prefix))[1]
        made.behind = int(state[0]) if len(state) else -1
    return vocab.sparkSession.sparkContext.broadcast(made)


def with_scores_of(vocab: DataFrame, tries: Broadcast, score: str = "lp") -> Broadcast:
    """Other scores for the same tokens, as a table from place to score."""
    made = tries.value
    found = dict(vocab.select("token_id", F.col(score).cast("double")).collect())  # at most MAX_TOKENS
    scores = np.array([np.nan if (x := found.get(i)) is None else x for i in made.ids.tolist()])
    return vocab.sparkSession.sparkContext.broadcast(scores)
