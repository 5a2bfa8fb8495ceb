"""Periodic runs: maximal stretches of words that repeat with a period, and texts with the repeats taken out.

A run of smallest period q is a stretch of at least max(MIN_WORDS, 2 * q) consecutive words in which words q apart are
equal, and which no neighbouring word extends.

Documents of a task are worked on together, in batches of about BATCH_WORDS words (whole documents: a longer one is a
batch alone). A batch is one array of word numbers, in which every document has numbers of its own and ends with a
separator of its own, so nothing matches across documents.

1. ``Suffixes``: prefix doubling gives the suffix array and, for every power of two B, the class of the B words at each
   place. A class is an interval of the suffix array; two classes compared from the largest B down give the common
   extension of two places in either direction.
2. ``Wavelet``: a wavelet matrix over the suffix array answers range-successor queries: the next place, at or behind a
   given one, at which the words of a class occur.
3. Dyadic blocks: a run of period q repeats, q words on, a stretch of at least max(6, q) words. With q >= 2 * B - 1 (or
   B = 2) that stretch holds an aligned block of B words, whose copy lies in the window of distances 2 * B - 1 to
   4 * B - 2 (1 to 6 for B = 2). So each block of each B asks for its occurrences in its own window only.
4. Progressions: occurrences no more than B / 2 apart are periodic; one extension gives the whole arithmetic progression,
   and the next query starts behind it. The distances found are candidate periods; each is extended to both sides.

Memory: some 4 * log2(longest repeat) bytes a word of a batch. Nothing is shuffled.

Defined cases: null and blank texts have no words, no run and an empty collapsed text; repeated rows and rows with a null
doc_id are documents as others; an empty table gives no rows; of the input only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import crc32_sql, let, words

MIN_WORDS = 12
BATCH_WORDS = 1 << 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_FIELDS = [pa.field(name, pa.int64()) for name in ("start", "length", "period")]


class Suffixes:
    """``ranks[k][i]``: where the suffixes that share the 2**k words at i begin in the suffix array ``order``."""

    def __init__(self, values: np.ndarray) -> None:
        """``values``: numbers from 0; the last one occurs once."""
        n = len(values)
        order = np.argsort(values, kind="stable").astype(np.int32)
        rank = np.empty(n, dtype=np.int32)
        rank[order] = self.starts(np.arange(n, dtype=np.int32), values[order])
        self.ranks, width = [rank], 1
        while True:
            shared = np.bincount(rank, minlength=n)[rank[order]] > 1
            at = np.flatnonzero(shared).astype(np.int32)
            if not len(at):
                break
            some = order[at]
            key = rank[some].astype(np.int64) * (n + 1) + rank[np.minimum(some + width, n - 1)] + 1  # shared words end before the last
            by = np.argsort(key)
            order[at] = some = some[by]
            rank = rank.copy()
            rank[some] = self.starts(at, key[by])
            self.ranks.append(rank)
            width *= 2
        self.order = order

    @staticmethod
    def starts(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For sorted ``keys`` at places ``at``: the place of the first equal one."""
        new = np.r_[True, keys[1:] != keys[:-1]]
        return at[np.flatnonzero(new)[np.cumsum(new) - 1]]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        i, j = i.copy(), j.copy()
        first = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][i] == self.ranks[k][j]).astype(i.dtype) << k
            i += step
            j += step
        return i - first

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        i, j = i.copy(), j.copy()
        first = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            room = i >= 1 << k
            left, right = np.where(room, i - (1 << k), 0), np.where(room, j - (1 << k), 0)
            step = (room & (self.ranks[k][left] == self.ranks[k][right])).astype(i.dtype) << k
            i -= step
            j -= step
        return first - i


class Wavelet:
    """A wavelet matrix over a permutation of 0..n-1; queries are answered for whole arrays of intervals."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.bits = range(max(1, self.n.bit_length()) - 1, -1, -1)
        self.zeros = []  # per bit: how many zeros before each place
        for b in self.bits:
            one = (values >> b & 1).astype(bool)
            before = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def less(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in [low, high) are below ``bound``, which is at most n."""
        count = np.zeros(len(low), dtype=np.int32)
        for b, zeros in zip(self.bits, self.zeros, strict=True):
            up = (bound >> b & 1).astype(bool)
            low0, high0 = zeros[low], zeros[high]
            count += np.where(up, high0 - low0, 0)
            low, high = np.where(up, zeros[-1] + low - low0, low0), np.where(up, zeros[-1] + high - high0, high0)
        return count

    def ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of the given rank (from 0) in [low, high)."""
        value = np.zeros(len(low), dtype=np.int32)
        for b, zeros in zip(self.bits, self.zeros, strict=True):
            low0, high0 = zeros[low], zeros[high]
            up = rank >= high0 - low0
            rank = np.where(up, rank - (high0 - low0), rank)
            value += up.astype(np.int32) << b
            low, high = np.where(up, zeros[-1] + low - low0, low0), np.where(up, zeros[-1] + high - high0, high0)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value in [low, high) that is at least ``bound``; n where there is none."""
        rank = self.less(low, high, np.minimum(bound, self.n).astype(np.int32))
        found = np.full(len(low), self.n, dtype=np.int32)
        there = rank < high - low
        found[there] = self.ranked(low[there], high[there], rank[there])
        return found


def block_periods(suffixes: Suffixes, wavelet: Wavelet, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block starts, distances): the occurrences of every aligned block of 2**k words in its window."""
    n, size = wavelet.n, 1 << k
    rank = suffixes.ranks[k]
    x = np.arange(0, n - size + 1, size, dtype=np.int32)
    low = rank[x]
    many = np.bincount(rank, minlength=n)[low].astype(np.int32)
    x, low, high = x[many > 1], low[many > 1], (low + many)[many > 1]
    nearest, farthest = (1 if k == 1 else 2 * size - 1), 4 * size - 2
    before, bound = np.full(len(x), -n - size, dtype=np.int32), x + nearest
    while len(x):
        at = wavelet.successor(low, high, bound)
        hit = (at < n) & (at <= x + farthest)
        x, low, high, before, at = x[hit], low[hit], high[hit], before[hit], at[hit]
        if not len(x):
            return
        yield x, at - x
        bound, step = at + 1, at - before
        periodic = np.flatnonzero(step <= size // 2)
        if len(periodic):
            d, first = step[periodic], at[periodic]
            terms = (suffixes.common(before[periodic], first) - size) // d  # of the progression, behind ``first``
            inside = np.minimum(terms, (x[periodic] + farthest - first) // d)
            owner = np.repeat(np.arange(len(periodic)), inside)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(inside) - inside, inside) + 1
            yield x[periodic][owner], (first[owner] + nth * d[owner] - x[periodic][owner]).astype(np.int32)
            at[periodic] = first + terms * d
            bound[periodic] = at[periodic] + 1
        before = at


def all_runs(values: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period; ``values`` as in :class:`Suffixes`."""
    suffixes = Suffixes(values)
    wavelet = Wavelet(suffixes.order)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for k in range(1, len(suffixes.ranks)):
        for x, q in block_periods(suffixes, wavelet, k):
            y = x + q
            start, end = x - suffixes.common_before(x, y), y + suffixes.common(x, y)
            ok = end - start >= np.maximum(least, 2 * q)
            if ok.any():
                found.append(np.stack([start[ok], end[ok], q[ok]], axis=1).astype(np.int64))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # other blocks and multiples of the smallest period give the same stretch
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]] if len(rows) else rows
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[list[bytes]], least: int = MIN_WORDS) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Of each document of a batch: rows (start, length, period), and the words that no run repeats."""
    values, starts, used = [], [], 0
    for text in texts:
        own = {w: i for i, w in enumerate(dict.fromkeys(text), used)}
        starts.append(len(values))
        values.extend(map(own.__getitem__, text))
        values.append(used + len(own))  # the separator
        used += len(own) + 1
    rows = all_runs(np.array(values, dtype=np.int32), least)
    change = np.zeros(len(values) + 1, dtype=np.int32)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 1], -1)
    kept = np.cumsum(change) == 0
    bounds = np.searchsorted(rows[:, 0], [*starts, len(values)])
    for i, (text, at) in enumerate(zip(texts, starts, strict=True)):
        own_rows = rows[bounds[i] : bounds[i + 1]]
        if len(own_rows):
            text = [text[w] for w in np.flatnonzero(kept[at : at + len(text)]).tolist()]
        yield np.stack([own_rows[:, 0] - at, own_rows[:, 1] - own_rows[:, 0], own_rows[:, 2]], axis=1), text


def runs_job(least: int):  # noqa: ANN201
    """An Arrow job over (doc_id, text): (doc_id, n_words, runs, collapsed)."""

    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows, collapsed = zip(*((r, b" ".join(t)) for r, t in runs_of(texts, least)), strict=True)
        offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = np.concatenate(rows)
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=RUN_FIELDS))
        columns = [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    found = (text or b"").split()  # bytes: the six ASCII white-space characters
                    if ids and size + len(found) > BATCH_WORDS:
                        yield answer(ids, texts)
                        ids, texts, size = [], [], 0
                    ids.append(doc_id)
                    texts.append(found)
                    size += len(found) + 1
        if ids:
            yield answer(ids, texts)

    return run


def periodic_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of ``docs(doc_id, text)``: all runs of at least ``least`` words by start and
    period, and the words outside the repeats, joined by blanks."""
    if least < MIN_WORDS:
        raise ValueError(f"runs have at least {MIN_WORDS} words: the first window relies on it")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(runs_job(least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` where every tenth document by hash repeats a stretch of its words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("int")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda c: F.array_join(F.transform(w, lambda x, i: F.when(i < c["a"], x).otherwise(F.get(w, c["a"] + (i - c["a"]) % c["p"]))), " "))

    planted = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, repeated(w)))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(docs: DataFrame) -> DataFrame:
    found = periodic_runs(with_planted_runs(docs.select(F.col("doc_id").cast("long"), "text")))
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "")
    best = found.withColumn("_best", F.array_max(order)).withColumn("_runs", text)
    length, period = F.col("_best.length"), -F.col("_best.p")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.col("_runs").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def oracle() -> str:
    """DuckDB SQL: pairs of equal words at a distance, their islands, and of equal stretches that of smallest period."""
    return rf"""
WITH w0 AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
w1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM w0),
w2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM w1),
w3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w2),
w AS (SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM w3),
t AS (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
m AS (SELECT x.k, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.k = y.k AND x.word = y.word AND x.i < y.i),
s AS (SELECT k, q, min(i) AS start, max(i) + 1 + q AS stop FROM (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM m) GROUP BY k, q, island),
r AS (SELECT k, start, stop - start AS length, min(q) AS period FROM s WHERE stop - start >= greatest({MIN_WORDS}, 2 * q) GROUP BY k, start, stop),
d AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS collapsed FROM t ANTI JOIN d USING (k, i) GROUP BY k),
f AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
  arg_max({{'s': start, 'l': length, 'p': period}}, row(length, -start, -period)) AS b FROM r GROUP BY k)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.p AS BIGINT) AS period, CAST(1000 * b.l // b.p AS BIGINT) AS exponent_milli,
sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM w LEFT JOIN f USING (k) LEFT JOIN c USING (k)"""
