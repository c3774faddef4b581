"""Benchmark decontamination: an FM-index of each training shard, searched for test phrases.

A shard is one Arrow batch of documents. Its words become symbols: words that no
benchmark item contains are separators, and stretches of benchmark words that are
shorter than the shortest phrase cannot hold one, so only the longer stretches
enter the index. All phrases are searched backwards at once through wavelet-tree
ranks, occurrences are located by sampled suffix positions, and overlapping
occurrences merge into removal spans. Nothing is shuffled, and no group of
documents meets in one task.

Benchmark phrases travel in blocks of at most BLOCK_WORDS words, one at a time: the driver
reads the benchmark as a stream, broadcasts a block, searches every shard for it, writes
what was hit, and lets the block go before it reads the next. Items longer than a block
are read in pieces that overlap by a window less one word. A benchmark of one block is
searched in a single pass over the documents; for more, documents are numbered in a
table first, and the hits of a document in all blocks are merged.

Null and empty texts have no words and are clean; an item without words matches
nothing; a null item id counts as an empty one. Items that share an id count once.
Repeated documents each get their row, also those with null ids. An empty table gives an
empty result. Other columns are ignored, or kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismview.llm.fm_index import FMIndex
from prismview.llm.scratch import rows_without, shared_folder, written

WINDOW, BLOCK_WORDS = 13, 200_000
#: A document is contaminated if one word in so many is hit.
ONE_IN = 20

#: A-Z to a-z; bytes that are not in a word to a space. Words are [0-9a-z\x80-\xff]+ in UTF-8.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = "items array<string>, spans array<struct<start:int,end:int>>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Phrases:
    """A block of benchmark items as symbol windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            coded = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words]
            for i in range(max(1, len(coded) - window + 1) if coded else 0):
                owners.setdefault(tuple(coded[i : i + window]), set()).add(item)
        self.groups = []
        for length in sorted({len(w) for w in owners}):
            same = [w for w in owners if len(w) == length]
            self.groups.append((length, np.array(same, np.int32), [sorted(owners[w]) for w in same]))
        self.shortest = min((g[0] for g in self.groups), default=window)


def pieces_of(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Words of each item, joined by blanks, in pieces of at most ``most`` words that hold every window."""
    for batch in batches:
        items, texts = [], []
        for item, text in zip(batch["item_id"].to_pylist(), batch["text"], strict=True):
            words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
            for at in range(0, max(1, len(words) - window + 1) if words else 0, most - window + 1):
                items.append(item or "")
                texts.append(b" ".join(words[at : at + most]))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary())], names=["item", "words"])


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    """The benchmark in blocks, read one after the other."""
    most = max(block_words, 2 * window)
    pieces = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(lambda b: pieces_of(b, window, most), "item string, words binary")
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for item, joined in pieces.toLocalIterator():
        words = bytes(joined).split(b" ")
        if held and size + len(words) > block_words:
            yield Phrases(held, window)
            held, size = [], 0
        held.append((item, words))
        size += len(words)
    if held:
        yield Phrases(held, window)


def hits_in(words: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Hit words of a shard as (document, word number), and the items that each document holds."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    code = phrases.symbols.get
    stream = np.zeros(int(lengths.sum()) + len(words), np.int32)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    for d, own in enumerate(words):
        stream[starts[d] : starts[d] + len(own)] = np.fromiter((code(w, 0) for w in own), np.int32, len(own))
    none = np.zeros(0, np.int64)
    # Stretches of benchmark words that are long enough to hold a phrase.
    inside = np.concatenate([[False], stream > 0, [False]])
    begin, end = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return none, none, {}
    sizes = end - begin + 1
    origin = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    index = FMIndex(stream[origin], len(phrases.symbols))  # each stretch with the separator after it
    document = np.searchsorted(starts, origin, side="right") - 1
    marks = np.zeros(len(origin) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for length, patterns, owners in phrases.groups:
        low, high = index.search(patterns)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        counts = high[found] - low[found]
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
        places = index.locate(rows)
        np.add.at(marks, places, 1)
        np.add.at(marks, places + length, -1)
        pairs = np.unique(np.stack([document[places], np.repeat(found, counts)]), axis=1)
        for d, w in pairs.T.tolist():
            items.setdefault(d, set()).update(owners[w])
    hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    return document[hit], origin[hit] - starts[document[hit]], items


def merged(numbers: np.ndarray) -> list[dict]:
    """Sorted distinct word numbers as spans [start, end)."""
    if not len(numbers):
        return []
    breaks = np.flatnonzero(np.diff(numbers) > 1)
    first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(numbers) - 1]])
    return [{"start": int(numbers[a]), "end": int(numbers[b]) + 1} for a, b in zip(first, last, strict=True)]


def search_shard(texts: pa.Array, phrases: Phrases) -> tuple[list[int], dict[int, np.ndarray], dict[int, set[str]]]:
    """Words of each document, and of those with a hit the hit word numbers and the items."""
    words = [words_of(t.as_buffer().to_pybytes()) if t.is_valid else [] for t in texts]
    document, number, items = hits_in(words, phrases)
    edges = np.flatnonzero(np.diff(document)) + 1
    firsts = document[np.concatenate([[0], edges])] if len(document) else []
    return list(map(len, words)), {int(d): part for d, part in zip(firsts, np.split(number, edges), strict=False)}, items


def verdict(n_hit: int, n_words: int, one_in: int) -> bool:
    return n_hit > 0 and one_in * n_hit >= n_words


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RESULT_TYPE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", SPAN), ("contaminated", pa.bool_())])


def result(ids: pa.Array, n_words: list[int], items: list[list[str]], spans: list[list[dict]], one_in: int) -> pa.RecordBatch:
    n_hit = [sum(s["end"] - s["start"] for s in own) for own in spans]
    columns = [ids, n_words, n_hit, list(map(len, items)), items, spans, [verdict(h, n, one_in) for h, n in zip(n_hit, n_words, strict=True)]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, RESULT_TYPE, strict=True)], schema=RESULT_TYPE)


def search_shards(batches: Iterator[pa.RecordBatch], shared, one_in: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` to RESULT rows, for a benchmark of one block."""
    for batch in batches:
        n_words, at, items = search_shard(batch["text"], shared.value)
        yield result(batch["doc_id"], n_words, [sorted(items.get(d, ())) for d in range(len(n_words))], [merged(at[d]) if d in at else [] for d in range(len(n_words))], one_in)


def number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(row, row + batch.num_rows), pa.int64())], names=[*batch.schema.names, "_row"])
        row += batch.num_rows


def hits_of_block(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """``_row, _text`` to ``_row, items, spans`` of documents with a hit."""
    for batch in batches:
        _, at, items = search_shard(batch["_text"], shared.value)
        hit = sorted(at)
        columns = [batch["_row"].take(pa.array(hit, pa.int64())), pa.array([sorted(items[d]) for d in hit], pa.list_(pa.string())), pa.array([merged(at[d]) for d in hit], SPAN)]
        yield pa.RecordBatch.from_arrays(columns, names=["_row", "items", "spans"])


def united(spans: list[dict]) -> list[dict]:
    """Spans of several blocks, merged where they touch."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def merge_hits(batches: Iterator[pa.RecordBatch], one_in: int) -> Iterator[pa.RecordBatch]:
    """``_id, _text, items, spans`` (lists of the blocks' lists, null without a hit) to RESULT rows."""
    for batch in batches:
        n_words = [len(words_of(t.as_buffer().to_pybytes())) if t.is_valid else 0 for t in batch["_text"]]
        items = [sorted({x for own in lists or () for x in own}) for lists in batch["items"].to_pylist()]
        spans = [united([x for own in lists or () for x in own]) for lists in batch["spans"].to_pylist()]
        yield result(batch["_id"], n_words, items, spans, one_in)


def search_blocks(docs: DataFrame, first: Phrases, others: Iterator[Phrases], text_col: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """All columns of ``docs`` with ``_row``, and ``_row, items, spans`` of documents with a hit, lists of the blocks' lists."""
    schema = docs.schema.simpleString()[7:-1]
    kept = written(docs.mapInArrow(number_rows, f"{schema},_row:bigint"), "documents", folder)
    rows = kept.select("_row", F.col(text_col).alias("_text"))
    found = None
    for i, phrases in enumerate((p for part in ([first], others) for p in part)):
        shared = docs.sparkSession.sparkContext.broadcast(phrases)  # BLOCK_WORDS words at most
        own = written(rows.mapInArrow(lambda b, s=shared: hits_of_block(b, s), f"_row long, {FOUND}"), f"block{i}", folder)
        shared.destroy()
        found = own if found is None else found.unionByName(own)
    return kept, found.groupBy("_row").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: word and hit counts, the items found (sorted as strings), removal spans in words, the verdict."""
    blocks = blocks_of(benchmark, window, block_words)
    first, second = next(blocks, Phrases([], window)), next(blocks, None)
    rows, folder = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shared_folder(docs.sparkSession)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)  # BLOCK_WORDS words at most
        return written(rows.mapInArrow(lambda batches: search_shards(batches, shared, one_in), RESULT), "found", folder)
    kept, found = search_blocks(rows.toDF("_id", "_text"), first, (p for part in ([second], blocks) for p in part), "_text", folder)
    return written(kept.join(found, "_row", "left").select("_id", "_text", "items", "spans").mapInArrow(lambda b: merge_hits(b, one_in), RESULT), "found", folder)


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def keep_clean(batches: Iterator[pa.RecordBatch], shared, one_in: int, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, at, _ = search_shard(batch[text_col], shared.value)
        yield batch.filter(pa.array([not verdict(len(at.get(d, ())), n, one_in) for d, n in enumerate(n_words)], pa.bool_()))


def contaminated_rows(batches: Iterator[pa.RecordBatch], one_in: int) -> Iterator[pa.RecordBatch]:
    """``_row, _text, spans`` to the ``_row`` of contaminated documents."""
    for batch in batches:
        n_words = [len(words_of(t.as_buffer().to_pybytes())) if t.is_valid else 0 for t in batch["_text"]]
        n_hit = [sum(s["end"] - s["start"] for s in united([x for own in lists for x in own])) for lists in batch["spans"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["_row"].filter(pa.array([verdict(h, n, one_in) for h, n in zip(n_hit, n_words, strict=True)], pa.bool_()))], names=["_row"])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all their columns unchanged."""
    blocks = blocks_of(benchmark, window, block_words)
    first, second = next(blocks, Phrases([], window)), next(blocks, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)  # BLOCK_WORDS words at most
        return docs.mapInArrow(lambda b: keep_clean(b, shared, one_in, text_col), docs.schema)
    folder = shared_folder(docs.sparkSession)
    named = [f"c{i}" for i in range(len(docs.columns))]  # columns of any name beside _row
    kept, found = search_blocks(docs.toDF(*named), first, (p for part in ([second], blocks) for p in part), named[docs.columns.index(text_col)], folder)
    texts = kept.select("_row", F.col(named[docs.columns.index(text_col)]).alias("_text")).join(found.select("_row", "spans"), "_row")
    gone = written(texts.mapInArrow(lambda b: contaminated_rows(b, one_in), "_row long"), "contaminated", folder)
    return rows_without(kept, gone, "_row").select(*[F.col(n).alias(c) for n, c in zip(named, docs.columns, strict=True)])
