"""Best-fit packing: whole documents into sequences of at most ``CAPACITY`` tokens.

Planning needs the histogram of piece lengths only (at most ``CAPACITY`` numbers, whatever the corpus), so the
plan is made from it: pieces above one third of the capacity are matched greedily, at most two to a sequence, and
smaller ones best-fit the gaps, longest first. A plan row says: the n pieces of length L with ranks from r lie at
offset o of the n sequences numbered from b. Spark then ranks the pieces of each length and looks their rows up.

Ranks are made in two steps, within hashed buckets of a length and by bucket totals, so that a length that a third
of all pieces have is still spread out. Nothing but the histogram reaches the driver.

Defined cases: a null or empty text is one end token; repeated rows are packed once each; the plan does not depend
on row order; an empty table gives no rows; a text of any length is cut into pieces of a full sequence; of the input only
doc_id and text are read, so clashing names do no harm.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import cut_lineage

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 1_500_000
RANK_BUCKET_ROWS = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_WITH_IDS = PIECES + ", ids array<int>"


# --- planning ----------------------------------------------------------------------------------


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) rows that place every piece exactly once."""
    left = {n: c for n, c in histogram.items() if c and 0 < n <= capacity}
    rank: Counter[int] = Counter()
    rows, gaps, bins = [], {}, 0  # gaps: free room -> list of [first sequence, count]
    sizes: list[int] = []  # rooms with sequences, ascending

    def place(length: int, count: int, at: int, offset: int) -> None:
        rows.append((length, rank[length], count, at, offset))
        rank[length] += count
        left[length] -= count

    def offer(room: int, at: int, count: int) -> None:
        if room and count:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(sizes, room)
            gaps[room].append([at, count])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in large:  # the longest partner that fits
            if not left[n]:
                break
            if m > n or m + n > capacity or not left[m]:
                continue
            count = left[n] // 2 if m == n else min(left[n], left[m])
            if count:
                place(n, count, bins, 0)
                place(m, count, bins, n)
                offer(capacity - n - m, bins, count)
                bins += count
        if left[n]:
            count = left[n]
            place(n, count, bins, 0)
            offer(capacity - n, bins, count)
            bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(sizes, n)
            if k == len(sizes):  # no gap fits: open as many sequences as these pieces fill
                offer(capacity, bins, -(-left[n] // (capacity // n)))
                bins += -(-left[n] // (capacity // n))
                continue
            room = sizes[k]
            at, count = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], sizes[k]
            used = min(count, left[n])
            place(n, used, at, capacity - room)
            offer(room - n, at, used)
            offer(room, at + used, count - used)
    return rows


# --- tokens ------------------------------------------------------------------------------------


class Ids:
    """Token ids of texts. A word's ids depend on the word alone, so they are kept from text to text.

    Text between white space is a word. Letters with ASCII punctuation behind them are two units for this
    tokenizer, and case is folded, so such a word is looked up by its lower-cased letters and its punctuation.
    """

    TAIL = re.compile(r"[!-/:-@\[-`{-~]+$")
    ODD = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(public_tokenizers.path(name))
        self.marks: dict[str, str] = {}  # a letter as the model's byte symbols
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def split(self, word: str) -> tuple[str, str]:
        tail = self.TAIL.search(word)
        body, rest = (word[: tail.start()], tail[0]) if tail else (word, "")
        if body.isalpha() and "Σ" not in body and "İ" not in body:
            return body.lower(), rest
        return word, ""

    def symbols(self, letter: str) -> str:
        if letter not in self.marks:
            self.marks[letter] = letter if letter.isascii() else "".join(p for p, _ in self.encoder.pre_tokenizer.pre_tokenize_str(letter))
        return self.marks[letter]

    def encode(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """Lower-cased letters are one unit for the tokenizer as they stand, so they go to its model directly."""
        rest, tokenize = [], self.encoder.model.tokenize
        for u in units:
            if not u.isalpha() or u != u.lower() or not is_normalized("NFC", u):
                rest.append(u)
                continue
            word = u if u.isascii() else "".join(map(self.symbols, u))
            yield u, array("I", [t.id for t in tokenize(word)]).tobytes()
        for u, e in zip(rest, self.encoder.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            yield u, array("I", e.ids).tobytes()

    def learn(self, new: list[str]) -> None:
        for kept in (self.words, self.units):
            if len(kept) > CACHED_WORDS:
                kept.clear()
        parts = [self.split(w) for w in new]
        units = self.units
        unseen = list({u for p in parts for u in p if u and u not in units})
        units.update(self.encode(unseen))
        self.words.update((w, units[a] + units[b] if b else units[a]) for w, (a, b) in zip(new, parts, strict=True))

    def of(self, texts: list[str]) -> list[np.ndarray]:
        words = [re.split(r"[\t-\r ]+", t.strip("\t\n\v\f\r ")) if self.ODD.search(t) else t.split() for t in texts]
        known = self.words
        new = set().union(*words).difference(known)
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = set().union(*words)
        if new:
            self.learn(list(new))
        end = np.array([END_ID], dtype="<u4").tobytes()
        return [np.frombuffer(b"".join([*map(known.__getitem__, ws), end]), dtype="<u4") for ws in words]


SHARED: dict[str, Ids] = {}  # of a Python worker


def tokenize_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in SHARED:
            SHARED[tokenizer] = Ids(tokenizer)
        ids_of = SHARED[tokenizer].of
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                pieces = []
                for doc, ids in zip(part.column(0).to_pylist(), ids_of([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes())))
                        pieces.append(piece)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES_WITH_IDS if with_ids else PIECES)


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, ... among those of the same length, in an order that reruns repeat."""
    buckets = max(1, rows // RANK_BUCKET_ROWS)
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    totals = keyed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")
    starts = totals.select("length", "_b", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return keyed.withColumn("_within", within).join(starts, ["length", "_b"]).withColumn("rank", F.col("_before") + F.col("_within")).drop("_b", "_before", "_within")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces(doc_id, piece, length, ids_crc32, ...)`` with sequence_id and offset."""
    pieces = cut_lineage(pieces)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows = plan(histogram, capacity)
    spark = pieces.sparkSession
    # A plan has a few rows per length: it grows with the capacity, not with the corpus.
    table = spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("length", "_rank", "_count", "_bin", "_offset"))}))
    slots = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_rank", "_count", "_bin", "_offset"))).alias("_slots"))
    found = ranked(pieces, sum(histogram.values())).join(F.broadcast(slots), "length")  # a row per length
    slot = F.filter("_slots", lambda s: (s["_rank"] <= F.col("rank")) & (F.col("rank") < s["_rank"] + s["_count"]))[0]
    out = found.withColumn("_slot", slot)
    return out.withColumns({"sequence_id": F.col("_slot._bin") + F.col("rank") - F.col("_slot._rank"), "offset": F.col("_slot._offset")}).drop("_slots", "_slot", "rank")


def pack_sequences(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids): the sequences themselves, for a trainer."""
    placed = pack(tokenize_pieces(docs, tokenizer, capacity, with_ids=True), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # a sequence holds at most ``capacity`` tokens
    grouped = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    return grouped.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))


def op10_packing(docs: DataFrame) -> DataFrame:
    return pack(tokenize_pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
