"""Exact deduplication over an extendible-hash index on shared files.

1. *Entries.* Each task normalises its texts, hashes them and folds equal texts
   of one Arrow batch into the row with the largest id, comparing bytes. Copies
   therefore never travel together: a group leaves each batch as one entry. Where a key
   still has more than FOLD entries, they fold again in groups of about FOLD, level by
   level, so no task ever meets more than about FOLD texts of a group.
2. *Directory.* A histogram of the leading key bits (2^MAX_DEPTH numbers) drives
   directory doubling: a bucket over its capacity splits in two on the next bit,
   and the directory doubles when a bucket at full depth splits. A bucket holds CAPACITY
   entries or a 2^(MAX_DEPTH - 1)-th of all, whichever is more, so buckets split at any
   size of the input and the directory keeps to 2^MAX_DEPTH slots.
3. *Owners.* A bucket is a range of keys. Its owner task reads the entries in key
   order, chains those with equal keys, and compares the chained texts byte for
   byte, so texts whose hashes collide stay apart. Texts travel only for keys that
   several entries have. What an owner finds is written to the index files in the order
   of its buckets, a file an owner.
4. Every row looks up its entry in the index by row number.

A null text counts as empty. Of equal texts the row with the largest id stays; of
rows that also share the id, one stays; a null id loses to any other. An empty
table gives an empty result. Other columns are ignored, or kept beside the
survivors by ``survivors``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismview.llm.scratch import in_slots, rows_with, rows_without, shared_folder, written

#: Entries that a bucket may hold before it splits, leading key bits at most, and entries of a key that meet in one task.
CAPACITY, MAX_DEPTH, FOLD = 4096, 16, 1000

ENTRY = "_id long, _row long, _entry long, _sha binary, _key long, _copies long, _text string"
OWNED = "_bucket int, _entry long, _keep_row long, _keep_id long, _size long"


def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_id, _text`` (+ others) to entry rows; only an entry's own row keeps text and others."""
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    for batch in batches:
        others = [c for c in batch.schema.names if c not in ("_id", "_text")]
        ids = batch["_id"].to_pylist()
        lowered = [t.as_buffer().to_pybytes() for t in pc.ascii_lower(pc.fill_null(batch["_text"], ""))]
        best: dict[bytes, int] = {}
        copies: dict[bytes, int] = {}
        for i, t in enumerate(lowered):
            copies[t] = copies.get(t, 0) + 1
            j = best.get(t)
            if j is None or (ids[i] is not None and (ids[j] is None or ids[i] > ids[j])):
                best[t] = i
        entry = [best[t] for t in lowered]
        own = pa.array([e == i for i, e in enumerate(entry)], pa.bool_())
        sha = {e: hashlib.sha256(t).digest() for t, e in best.items()}
        digests = [sha[e] for e in entry]
        blank = lambda column: pc.if_else(own, column, pa.nulls(len(column), column.type))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(range(row, row + len(ids)), pa.int64()),
                pa.array([row + e for e in entry], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], pa.int64()),
                pa.array([copies[t] if e == i else None for i, (t, e) in enumerate(zip(lowered, entry, strict=True))], pa.int64()),
                blank(batch["_text"]),
                *[blank(batch[c]) for c in others],
            ],
            names=["_id", "_row", "_entry", "_sha", "_key", "_copies", "_text", *others],
        )
        row += len(ids)


def directory(histogram: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Global depth and the bucket number of each directory slot.

    ``histogram``: entries by the ``max_depth`` leading bits of their key.
    """
    sums = [0]
    for i in range(1 << max_depth):
        sums.append(sums[-1] + histogram.get(i, 0))
    depth, buckets, pending = 0, [], [(0, 0)]  # (prefix, local depth)
    while pending:
        prefix, local = pending.pop()
        width = max_depth - local
        if local < max_depth and sums[(prefix + 1) << width] - sums[prefix << width] > capacity:
            depth = max(depth, local + 1)
            pending += [(prefix << 1 | 1, local + 1), (prefix << 1, local + 1)]
        else:
            buckets.append((prefix, local))
    slots = [0] * (1 << depth)
    for number, (prefix, local) in enumerate(buckets):
        width = depth - local
        for slot in range(prefix << width, (prefix + 1) << width):
            slots[slot] = number
    return depth, slots


def chain_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in (bucket, key) order to the row that stays for each; holds the chain of one key at a time."""
    out: list[tuple] = []
    at, chain = None, []  # chain: [text, bucket, members, best id, best row, copies]

    def close() -> None:
        for _, bucket, members, best, best_row, copies in chain:
            out.extend((bucket, m, best_row, best, copies) for m in members)

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        out.clear()
        kinds = [pa.int32()] + [pa.int64()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_bucket", "_entry", "_keep_row", "_keep_id", "_size"])

    for batch in batches:
        texts = pc.ascii_lower(pc.fill_null(batch["_text"], ""))
        for i, (bucket, key, entry, ident, copies) in enumerate(zip(*[batch[c].to_pylist() for c in ("_bucket", "_key", "_entry", "_id", "_copies")], strict=True)):
            if (bucket, key) != at:
                close()
                at, chain = (bucket, key), []
            text = texts[i].as_buffer().to_pybytes()  # empty where a key has one entry
            link = next((c for c in chain if c[0] == text), None)
            if link is None:
                chain.append([text, bucket, [entry], ident, entry, copies])
                continue
            link[2].append(entry)
            link[5] += copies
            if ident is not None and (link[3] is None or ident > link[3]):
                link[3], link[4] = ident, entry
        if len(out) > 20_000:
            yield flush()
    close()
    yield flush()


def folded(entries: DataFrame, own: DataFrame, fold: int, folder: str) -> tuple[DataFrame, list[DataFrame]]:
    """``own`` with at most about ``fold`` entries a key and text, and ``_entry, _keep_row`` of the entries folded at each level.

    Entries of a crowded key are dealt into groups; equal texts of a group leave it as one. Levels go on while they make a key less crowded.
    """
    links: list[DataFrame] = []
    before = None
    while True:
        level = len(links)
        counts = own.groupBy("_key").count().filter(F.col("count") > fold)
        crowded = written(counts, f"crowded{level}", folder)
        most, keys = crowded.agg(F.max("count"), F.count("*")).first()
        if not keys or (before is not None and most >= before):  # keys of many different texts fold no further
            return own, links
        before = most
        group = F.pmod(F.xxhash64("_entry", F.lit(level)), F.lit(-(-most // fold))).cast("int")
        # Entries that merely share a slot with a crowded key fold rightly, too.
        texts = in_slots(entries.filter("_row = _entry").select("_entry", "_key", "_text"), crowded, "_key").select("_entry", "_text")
        met = in_slots(own, crowded, "_key").join(texts, "_entry").withColumn("_bucket", group)
        made = written(met.repartition("_bucket", "_key").sortWithinPartitions("_bucket", "_key").mapInArrow(chain_keys, OWNED), f"fold{level}", folder)
        links.append(made.filter("_entry <> _keep_row").select("_entry", "_keep_row"))
        heads = made.filter("_entry = _keep_row").join(own.select("_entry", "_key"), "_entry").select(F.col("_keep_id").alias("_id"), "_entry", "_key", F.col("_size").alias("_copies"))
        own = written(own.join(made.select("_entry"), "_entry", "left_anti").select("_id", "_entry", "_key", "_copies").unionByName(heads), f"own{level}", folder)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), capacity: int = CAPACITY, fold: int = FOLD) -> tuple[DataFrame, DataFrame]:
    """The entry table and the index of ``docs``; ``carry`` names columns kept in the entries as ``_c0, _c1, ...``."""
    folder = shared_folder(docs.sparkSession)
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = ", ".join([ENTRY, *(f"_c{i} {kinds[c]}" for i, c in enumerate(carry))])
    entries = written(rows.mapInArrow(fold_batches, schema), "entries", folder)
    own, links = folded(entries, entries.filter("_row = _entry").select("_id", "_entry", "_key", "_copies"), fold, folder)
    several = written(own.groupBy("_key").count().filter("count > 1").select("_key"), "several", folder)
    texts = rows_with(entries.filter("_row = _entry").select("_entry", "_key", "_text"), several, "_key").select("_entry", "_text")
    top = F.shiftrightunsigned("_key", 64 - MAX_DEPTH)
    histogram = {r[0]: r[1] for r in own.groupBy(top.alias("slot")).count().collect()}  # 2^MAX_DEPTH rows at most
    depth, slots = directory(histogram, max(capacity, sum(histogram.values()) >> (MAX_DEPTH - 1)))
    places = docs.sparkSession.createDataFrame(list(enumerate(slots)), "_slot long, _bucket int")  # 2^MAX_DEPTH rows at most
    slot = F.shiftrightunsigned("_key", 64 - depth) if depth else F.lit(0).cast("long")
    owned = own.join(texts, "_entry", "left").withColumn("_slot", slot).join(F.broadcast(places), "_slot")
    found = written(owned.repartition("_bucket").sortWithinPartitions("_bucket", "_key").mapInArrow(chain_keys, OWNED), "index", folder)
    for link in reversed(links):  # folded entries stay with what their group's head stays with
        heads = found.withColumnRenamed("_entry", "_head").drop("_bucket")
        more = link.withColumnRenamed("_keep_row", "_head").join(heads, "_head").select(F.lit(-1).alias("_bucket"), "_entry", "_keep_row", "_keep_id", "_size")
        found = found.unionByName(more)
    return entries, found


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, fold: int = FOLD) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    entries, found = index(docs, id_col, text_col, capacity=capacity, fold=fold)
    return (
        entries.select("_id", "_row", "_entry", "_sha")
        .join(found, "_entry")
        .select(F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_row") == F.col("_keep_row")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged."""
    carry = [c for c in docs.columns if c != text_col]
    entries, found = index(docs, id_col, text_col, carry)
    gone = found.filter("_entry <> _keep_row").select("_entry")
    return rows_without(entries.filter("_row = _entry"), gone, "_entry").select(*[F.col("_text" if c == text_col else f"_c{carry.index(c)}").alias(c) for c in docs.columns])
