"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece
lengths (at most ``capacity`` numbers) reaches the driver. There the configuration
program - use as few patterns as possible so that every length is covered - is solved
in fractions by multiplicative weights: the weight of a length falls as the share of it
that is covered grows, a knapsack dynamic program prices patterns under the present
weights, and every length takes a fraction of the best pattern that holds it. The prices
also give a lower bound on the number of sequences.

The fractions are then rounded: whole numbers of each pattern, then one more of a pattern
in the order of the fractions lost, as long as pieces for it are left. What is left over
is a smaller program of the same kind and is solved and rounded again, until a round
places little; each of the last sequences is the fullest that a subset-sum dynamic
program finds for the longest piece left.

Patterns reach the pieces by rank: the i-th piece of a length belongs to the run
of sequences that covers rank i. Ranks are counted in PARTS parts of a length, so
a length that holds most rows is still ranked by many tasks.

A null text is an empty one: one piece, the end-of-text id alone. Repeated rows
are pieces of their own, also with null ids. An empty table gives an empty result. Other
columns are ignored, whatever their names. Very long texts are cut, never shortened.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismview.llm.scratch import held, written

CAPACITY, END_ID = 4096, 1
#: Steps of the fractional program, the share of a pattern's most that a step takes, and the rate at which weights fall.
ROUNDS, STEP, RATE = 12, 0.9, 0.3
#: Weights begin at this power of a length, so that long pieces, which fit in few places, are placed first.
LENGTH_POWER = 0.15
#: Share of a length that may stay uncovered before it counts as covered.
COVERED = 1e-3
#: Programs solved and rounded one after the other at most; a round that places less than this share of what is left is the last.
PROGRAMS, LEAST_PLACED = 12, 0.1
PARTS = 64
CACHE_WORDS = 400_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long"


class WordIds(dict):
    """Token ids of white-space-separated words as little-endian bytes; a bounded number of words is remembered.

    The tokenizer ends every token at white space, so the ids of a text are those
    of its words in order. It also lower-cases, and ends tokens between ASCII letters and
    a full stop or comma, so most words need one lookup or one merge run of the model. (Other
    letters may lower-case to a letter and a combining mark, which joins what follows.)
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[str, bytes] = {}
        self.marks = {mark: self.plain(mark) for mark in ".,"}

    def plain(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if word.isascii() and word.isalpha():
                found = self[word.lower()] if not word.islower() else array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()
            elif word[-1:] in self.marks and word.isascii() and word[:-1].isalpha():
                found = self[word[:-1]] + self.marks[word[-1]]
            else:
                found = self.plain(word)
        if len(self) >= CACHE_WORDS:  # what is still in use comes back from the older half
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def cut_pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words = held(path, lambda: WordIds(path))
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
        out: list[tuple] = []
        for ident, text in zip(ids, texts, strict=True):
            data = words.encode(text or "") + end
            for k in range(0, len(data), 4 * capacity):
                part = data[k : k + 4 * capacity]
                out.append((ident, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_patterns(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over every capacity: the best worth, and the length taken (-1: none, one token stays free)."""
    worth = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        worth[c] = worth[c - 1]
        k = fits[c]
        if k:
            value = prices[:k] + worth[c - lengths[:k]]
            j = int(value.argmax())
            if value[j] > worth[c]:
                worth[c], taken[c] = value[j], j
    return worth, taken


def pattern_at(taken: list[int], lengths: list[int], free: int) -> list[int]:
    items = []
    while free > 0:
        j = taken[free]
        if j < 0:
            free -= 1
        else:
            items.append(j)
            free -= lengths[j]
    return items


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], float], int]:
    """How much of each pattern (positions of lengths) covers every length, and the program's lower bound on sequences."""
    amounts: dict[tuple[int, ...], float] = {}
    left, weight, bound = counts.astype(float), (lengths / lengths[-1]) ** LENGTH_POWER, -(-int((lengths * counts).sum()) // capacity)
    for last in [False] * ROUNDS + [True]:
        open_ = np.flatnonzero(left > COVERED * counts)
        if not len(open_):
            break
        own, price = lengths[open_], lengths[open_] / capacity * weight[open_]
        worth, taken = best_patterns(own, price, capacity)
        if len(open_) == len(lengths):  # prices at which no pattern is worth over 1 bound the program from below
            bound = max(bound, int(np.ceil((price / worth[capacity] * counts).sum() - 1e-6)))
        own, taken, rest = own.tolist(), taken.tolist(), left[open_].tolist()
        for anchor in range(len(own) - 1, -1, -1):
            if rest[anchor] <= 0:
                continue
            items = [anchor, *pattern_at(taken, own, capacity - own[anchor])]
            need = Counter(items)
            # The last step covers what is still open, and its partners once more.
            times = rest[anchor] / need[anchor] if last else STEP * min(rest[j] / n for j, n in need.items())
            if times > 1e-6:
                for j, n in need.items():
                    rest[j] -= n * times
                pattern = tuple(int(open_[j]) for j in items)
                amounts[pattern] = amounts.get(pattern, 0.0) + times
        left[open_] = np.maximum(rest, 0.0)
        weight *= np.exp(-RATE * (1 - left / counts))
        weight /= weight.max()
    return amounts, bound


def rounded(amounts: dict[tuple[int, ...], float], counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole numbers of patterns, and the pieces of each length that they leave."""
    left, out = counts.tolist(), []

    def take(items: tuple[int, ...], times: int) -> None:
        need = Counter(items)
        times = min(times, *(left[j] // n for j, n in need.items()))
        if times > 0:
            for j, n in need.items():
                left[j] -= n * times
            out.append((items, times))

    for items, x in amounts.items():
        take(items, int(x))
    for items, _ in sorted(amounts.items(), key=lambda p: (int(p[1]) - p[1], p[0])):
        take(items, 1)
    return out, np.array(left, np.int64)


def fullest(lengths: list[int], left: list[int], room: int) -> list[int]:
    """Positions of pieces left that fill ``room`` as far as any choice of them does."""
    reach, steps = 1, []  # bit s: a choice of the pieces so far has the sum s
    mask = (1 << (room + 1)) - 1
    for j in range(len(lengths) - 1, -1, -1):
        for _ in range(min(left[j], room // lengths[j])):
            more = (reach | reach << lengths[j]) & mask
            if more == reach:
                break
            steps.append((j, reach))
            reach = more
        if reach >> room & 1:
            break
    at, items = reach.bit_length() - 1, []
    for j, before in reversed(steps):
        if not before >> at & 1:
            items.append(j)
            at -= lengths[j]
    return items


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], int]:
    """Patterns (lengths, how many sequences) that place every piece exactly once, and a lower bound on sequences."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    patterns, bound = [], 0
    for i in range(PROGRAMS):
        open_ = np.flatnonzero(counts)
        if not len(open_):
            break
        amounts, least = fractional(lengths[open_], counts[open_], capacity)
        bound = bound or least
        found, left = rounded(amounts, counts[open_])
        patterns += [([int(lengths[open_[j]]) for j in items], n) for items, n in found]
        placed = 1 - left.sum() / counts[open_].sum()
        counts[open_] = left
        if placed < LEAST_PLACED:
            break
    left, sizes = counts.tolist(), lengths.tolist()
    for j in range(len(sizes) - 1, -1, -1):
        while left[j]:
            left[j] -= 1
            items = [j]
            for k in fullest(sizes[: j + 1], left, capacity - sizes[j]):
                left[k] -= 1
                items.append(k)
            times = min([1 + left[k] // n for k, n in Counter(items).items()])
            for k in items:
                left[k] -= times - 1
            patterns.append(([sizes[k] for k in items], times))
    return patterns, bound


def runs_of(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted; a run lasts until the next rank of its length."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for items, times in patterns:
        offset = 0
        for length in items:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def place(batches: Iterator[pa.RecordBatch], runs) -> Iterator[pa.RecordBatch]:
    table = runs.value
    keys = table[:, 0] << 44 | table[:, 1]
    for batch in batches:
        rank = batch["rank"].to_numpy()
        at = np.searchsorted(keys, batch["length"].to_numpy() << 44 | rank, side="right") - 1
        run = table[at]
        columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(run[:, 2] + rank - run[:, 1]), pa.array(run[:, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: its tokens' place in the document and in the packed sequences."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(rows.mapInArrow(lambda b: cut_pieces(b, tokenizer_path, capacity, end_id), PIECE), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    runs = docs.sparkSession.sparkContext.broadcast(runs_of(solve(histogram, capacity)[0]))  # bounded by the number of lengths: PROGRAMS x ROUNDS x capacity patterns and their pieces, whatever the input
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parted.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    ranked = parted.withColumn("number", number).join(F.broadcast(starts), ["length", "part"])  # capacity x PARTS rows at most
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number") - 1).alias("rank")).mapInArrow(lambda b: place(b, runs), PLACED)
