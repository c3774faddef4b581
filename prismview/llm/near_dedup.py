"""Near-duplicate detection: fast similarity sketching, banding, exact verification.

*Sketch.* A document is its set of distinct SHINGLE-word shingles. Fast similarity
sketching (Dahlgaard, Knudsen and Thorup) throws the set into T bins in rounds: a
round hashes every element to a bin and a value, a bin keeps its least (round,
value), and rounds go on until no bin is empty; from round T on each element falls
into one given bin, so every coordinate fills after 2T rounds at most.

*Bands.* ROWS coordinates in a row make a band key. Two sets with the threshold
similarity 0.75 share none of the BANDS keys with probability 5e-6.

*Verification.* Documents with equal sets are one class and meet only once. In the
first round every class proposes itself to one hub: the most popular class (by the
sizes of its buckets) of one of its own buckets, the one that looks most similar. The
pair is checked on the full sets of words, so a group of n near copies costs n checks,
not n * n. The second round checks the other pairs of each bucket whose classes lie
in different components by then, each pair once, unless a sketch of FINE coordinates
shows (at 4.6 standard deviations) that they cannot be similar, or their distances to
a common hub do: the Jaccard distance is a metric. Links inside a component change
nothing and are not looked for. Components are found by large-star and small-star steps over tables in
the shared folder.

*Skew.* A hub's text goes to each of its parts of about PAIRS pairs, not to each pair. A
bucket of more than BLOCK classes is compared in blocks: every two blocks meet in a cell
of their own, so a task compares 2 x BLOCK sketches at most. Nodes and components of more
than CROWD rows are joined in parts.

Documents without words are linked with nothing; null text has no words. Rows with
equal ids stay separate rows; a null id never names a component that holds another
id. An empty table gives an empty result. Other columns are ignored, or kept beside
the survivors by ``survivors``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismview.llm.scratch import held, in_slots, parted, rows_with, rows_without, shared_folder, split_join, written

SHINGLE, T, ROWS = 5, 128, 4
BANDS = T // ROWS
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Coordinates whose lowest four bits may differ: at 0.75 30 of 128 do, with a deviation of 4.8.
MOST_DIFFER = 52
FOURS = [f"_s{i}" for i in range(T // 16)]
#: Coordinates of the finer sketch, one bit each, and how many may differ: at 0.75 256 of 2048 do, with a deviation of 15.
FINE, MOST_FINE = 2048, 325
BITS = [f"_f{i}" for i in range(FINE // 64)]
#: Rows of a node or component that meet in one task, pairs of a hub (each costs two sets of shingles), and classes of a bucket.
CROWD, PAIRS, BLOCK = 1000, 200, 2000
#: Pairs that one task checks, about.
TASK_PAIRS = 2000

ENTRY = "_id long, _row long, _entry long, _n long, _fp binary, _bands array<long>, _text string, " + ", ".join(f"{c} long" for c in FOURS)

_odd = np.random.default_rng(20170901)
WORD_FACTORS = _odd.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROUND_SEEDS = _odd.integers(0, 2**63, 2 * FINE, dtype=np.uint64)
BAND_FACTORS = _odd.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Word to 64-bit hash; a bounded number of words is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space, which is just \\x20 and \\x09-\\x0D."""
    return text.lower().split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of a document's shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(held("word hashes", WordHashes).__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        return mixed((h * WORD_FACTORS[:n]).sum(keepdims=True) + np.uint64(n))
    last = n - SHINGLE + 1
    total = h[:last] * WORD_FACTORS[0]
    for j in range(1, SHINGLE):
        total += h[j : last + j] * WORD_FACTORS[j]
    return np.unique(mixed(total))


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """Coordinates of non-empty sets, one row a set; ``t`` is a power of two."""
    empty = np.iinfo(np.uint64).max
    filled = np.full((len(sets), t), empty, np.uint64)
    flat = filled.reshape(-1)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    to_bin, low = np.uint64(64 - t.bit_length() + 1), np.uint64((1 << 51) - 1)
    for i in range(2 * t):
        if not len(elements):
            break
        h = mixed(elements ^ ROUND_SEEDS[i])
        bins = (h >> to_bin).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(flat, owner * t + bins, (np.uint64(i) << np.uint64(51)) | (h & low))
        going = (filled == empty).any(axis=1)[owner]
        elements, owner = elements[going], owner[going]
    return filled


def fine_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = sketches([shingle_hashes(words_of(t.as_buffer().to_pybytes())) for t in batch["_text"]], FINE)
        bits = np.packbits((made & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64).reshape(-1, len(BITS))
        yield pa.RecordBatch.from_arrays([batch["node"], *[pa.array(bits[:, i]) for i in range(len(BITS))]], names=["node", *BITS])


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_id, _text`` (+ others) to entry rows; equal sets of a batch share the entry with the smallest id."""
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    for batch in batches:
        others = [c for c in batch.schema.names if c not in ("_id", "_text")]
        ids = batch["_id"].to_pylist()
        sets = [shingle_hashes(words_of(t.as_buffer().to_pybytes())) if t.is_valid else np.zeros(0, np.uint64) for t in batch["_text"]]
        prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        best: dict[bytes, int] = {}
        for i, p in enumerate(prints):
            if p is not None and ((j := best.get(p)) is None or (ids[i] is not None and (ids[j] is None or ids[i] < ids[j]))):
                best[p] = i
        entry = [i if p is None else best[p] for i, p in enumerate(prints)]
        own = sorted(best.values())
        made = sketches([sets[i] for i in own])
        keys = mixed((made.reshape(-1, BANDS, ROWS) * BAND_FACTORS).sum(axis=2, dtype=np.uint64)).view(np.int64)
        fours = (made & np.uint64(15)).astype(np.uint8)
        fours = (fours[:, ::2] << 4 | fours[:, 1::2]).view(np.int64)
        at = dict(zip(own, range(len(own)), strict=True))
        is_own = pa.array([e == i for i, e in enumerate(entry)], pa.bool_())
        place = pa.array([at.get(i) if e == i else None for i, e in enumerate(entry)], pa.int64())
        blank = lambda column: pc.if_else(is_own, column, pa.nulls(len(column), column.type))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(own) + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(range(row, row + len(ids)), pa.int64()),
                pa.array([row + e for e in entry], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([p if e == i else None for i, (p, e) in enumerate(zip(prints, entry, strict=True))], pa.binary()),
                bands.take(place),
                blank(batch["_text"]),
                *[pa.array(fours[:, i]).take(place) for i in range(len(FOURS))],
                *[blank(batch[c]) for c in others],
            ],
            names=["_id", "_row", "_entry", "_n", "_fp", "_bands", "_text", *FOURS, *others],
        )
        row += len(ids)


def shingle_set(text: str) -> set[tuple[bytes, ...]]:
    words = words_of(text.encode())
    return set(zip(*[words[j:] for j in range(SHINGLE)], strict=False)) if len(words) >= SHINGLE else {tuple(words)} if words else set()


def check_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``b, a, text`` in which a hub's own row (``a`` null) comes before those that are compared with it."""
    hub: set = set()
    for batch in batches:
        out = []
        for b, a, text in zip(batch["b"].to_pylist(), batch["a"].to_pylist(), batch["text"].to_pylist(), strict=True):
            own = shingle_set(text)
            if a is None:
                hub = own
                continue
            common = len(own & hub)
            union = len(own) + len(hub) - common
            out.append((a, b, 100 * common >= percent * union > 0, 1 - common / union if union else 1.0))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.float64()), strict=True)], names=["a", "b", "similar", "apart"])


def components(edges: DataFrame, name: str, folder: str, crowd: int = CROWD) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a, b``), the root being the smallest node that it reaches."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}0", folder)
    step = 0
    while True:
        # Done when all are stars: then nobody is below two others, or below one and above another.
        ends = now.selectExpr("u AS node", "1 AS ups", "0 AS downs").union(now.selectExpr("v", "0", "1")).groupBy("node").agg(F.sum("ups").alias("ups"), F.sum("downs").alias("downs"))
        most, going = ends.agg(F.max("downs"), F.max(F.expr("ups > 1 OR ups > 0 AND downs > 0"))).first()
        if not going:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        step += 1
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        centres = now.groupBy(F.col("v").alias("u")).count().filter(F.col("count") > crowd)
        above = split_join(now.select(F.col("v").alias("u"), F.col("u").alias("v")), least, "u", "v", centres, most, crowd)
        large = above.select(F.col("v").alias("u"), F.col("m").alias("v")).union(now.join(least, "u").filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = written(large, f"{name}{step}large", folder)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = written(small, f"{name}{step}small", folder)


def near_groups(docs: DataFrame, id_col: str, text_col: str, carry: list[str], percent: int = PERCENT, crowd: int = CROWD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The entry table, and ``_entry, keep_id, keep_row`` of every entry."""
    folder = shared_folder(docs.sparkSession)
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = ", ".join([ENTRY, *(f"_c{i} {kinds[c]}" for i, c in enumerate(carry))])
    entries = written(rows.mapInArrow(sketch_batches, schema), "entries", folder, batch_rows=500)
    own = entries.filter("_row = _entry")
    full = own.filter("_n > 0")
    classes = full.groupBy("_fp").agg(F.min("_entry").alias("node"))
    members = written(full.select("_fp", "_entry", "_id").join(classes, "_fp").select("_entry", "_id", "node"), "members", folder)
    # Most entries stand for their class, so the others are taken away by their slots and the bands of the rest travel once, as keys.
    heads = rows_without(full, members.filter("_entry <> node").select("_entry"), "_entry").withColumnRenamed("_entry", "node")
    facts = written(heads.select("node", "_n", *FOURS), "facts", folder)

    banded = heads.select("node", F.explode("_bands").alias("key")).repartition("key")  # both uses read the same shuffle files
    crowded = banded.groupBy("key").agg(F.count("node").alias("crowd")).filter("crowd > 1")
    shared = written(banded.join(crowded, "key"), "shared", folder)
    popular = written(shared.groupBy("node").agg(F.sum("crowd").alias("popularity")), "popular", folder)
    texts = written(rows_with(full.select(F.col("_entry").alias("node"), "_text"), popular, "node"), "texts", folder)

    def differ(a: str, b: str) -> str:
        """Coordinates of two sketches whose four bits differ."""
        x = [f"({a}.{c} ^ {b}.{c})" for c in FOURS]
        return " + ".join(f"bit_count(({v} | shiftrightunsigned({v}, 1) | shiftrightunsigned({v}, 2) | shiftrightunsigned({v}, 3)) & 1229782938247303441)" for v in x)  # 0x1111111111111111

    def alike_in_size(a: str, b: str) -> str:
        return f"100 * least({a}._n, {b}._n) >= {percent} * greatest({a}._n, {b}._n)"

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(pairs, f"{name}_pairs", folder)
        per_hub, rows = pairs.groupBy("b").count(), min(PAIRS, crowd)
        most, total = (x or 0 for x in per_hub.agg(F.max("count"), F.sum("count")).first())
        own = parted(pairs, "b", "a", per_hub.filter(F.col("count") > rows).select("b"), -(-most // rows)).withColumnRenamed("_part", "part")
        members = own.join(texts.select(F.col("node").alias("a"), F.col("_text").alias("text")), "a").select("b", "part", "a", "text")
        hubs = own.select("b", "part").distinct().join(texts.select(F.col("node").alias("b"), F.col("_text").alias("text")), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
        tasks = min(total // TASK_PAIRS + 1, 20_000)  # a pair costs far more time than its bytes tell
        met = members.union(hubs).repartition(tasks, "b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a")).select("b", "a", "text")
        return written(met.mapInArrow(lambda x: check_pairs(x, percent), "a long, b long, similar boolean, apart double"), name, folder, batch_rows=200)

    rank = F.struct("popularity", "node")
    ranked = shared.select("key", "node").join(popular, "node")
    hubs = ranked.groupBy("key").agg(F.max(rank).alias("hub"))
    offers = ranked.join(hubs, "key").filter(rank < F.col("hub")).select("node", F.col("hub.node").alias("hub")).distinct().alias("o")
    offers = offers.join(facts.alias("x"), F.expr("o.node = x.node")).join(facts.alias("y"), F.expr(f"o.hub = y.node AND {alike_in_size('x', 'y')} AND {differ('x', 'y')} <= {MOST_DIFFER}"))
    offers = offers.groupBy("o.node").agg(F.min(F.struct(F.expr(differ("x", "y")).alias("differ"), F.expr("o.hub").alias("hub"))).alias("best"))
    first = checked(offers.select(F.col("node").alias("a"), F.col("best.hub").alias("b")), "first")
    links = first.filter("similar").select("a", "b")
    roots = components(links, "first_round", folder, crowd)

    # What is left: pairs of one bucket in different components.
    placed = shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = written(placed, "placed", folder)
    hub_of = first.select(F.col("a").alias("node"), F.col("b").alias("hub"), "apart")
    split = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("least < most").select("key", "blocks")
    open_ = written(placed.join(split, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "open", folder)
    fine = in_slots(texts, open_, "node").mapInArrow(fine_sketches, "node long, " + ", ".join(f"{c} long" for c in BITS))
    fine = written(fine.join(facts.select("node", "_n"), "node").join(open_.groupBy("node").agg(F.collect_set("key").alias("_keys")), "node").join(hub_of, "node", "left").withColumn("apart", F.coalesce("apart", F.lit(0.0))).withColumn("hub", F.coalesce("hub", "node")), "fine", folder, batch_rows=200)
    # Every two blocks of a bucket meet in one cell; two of one block only in the cell of that block alone.
    cells = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "node", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    sides = cells.join(fine, "node")
    cell = "x.key = y.key AND x.low = y.low AND x.high = y.high AND (x.block <> y.block OR x.low = x.high)"
    close = f"(x.hub <> y.hub OR abs(x.apart - y.apart) <= {1 - percent / 100 + 1e-9})"  # a hub lies at distance 0 from itself
    look_alike = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in BITS) + f" <= {MOST_FINE}"
    once = "x.key = array_min(array_intersect(x._keys, y._keys))"
    pairs = sides.alias("x").join(sides.alias("y"), F.expr(f"{cell} AND x.root < y.root AND {alike_in_size('x', 'y')} AND {close} AND {look_alike} AND {once}"))
    pairs = pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
    tested = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    second = checked(pairs.join(tested, ["a", "b"], "left_anti"), "second")
    more = second.filter("similar").select("a", "b")
    for end in ("a", "b"):  # the second round's links lie between components of the first
        more = more.join(roots.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    tops = components(more, "all", folder, crowd)
    under = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    roots = under.select("node", F.coalesce("top", "root").alias("root")).union(tops)

    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_entry").alias("row"))).alias("keep")
    nodes = written(members.groupBy("node").agg(least).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "keep"), "nodes", folder)
    kept = nodes.groupBy("root").agg(F.min("keep").alias("keep"))
    members_of = nodes.groupBy("root").count()
    most = members_of.agg(F.max("count")).first()[0] or 0
    named = split_join(nodes.select("node", "root"), kept, "root", "node", members_of.filter(F.col("count") > crowd), most, crowd).select("node", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"))
    groups = members.select("_entry", "node").join(named, "node").select("_entry", "keep_id", "keep_row")
    return entries, written(groups.union(own.filter("_n = 0").select("_entry", F.col("_id").alias("keep_id"), F.col("_entry").alias("keep_row"))), "groups", folder)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row. ``sizes``: ``crowd`` and ``block``."""
    entries, groups = near_groups(docs, id_col, text_col, [], **sizes)
    found = entries.select("_id", "_n", "_entry").join(groups, "_entry")
    return found.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("keep_id").alias("component_id"), F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the smallest id of each component, all columns of ``docs`` unchanged."""
    carry = [c for c in docs.columns if c != text_col]
    entries, groups = near_groups(docs, id_col, text_col, carry)
    gone = groups.filter("_entry <> keep_row").select("_entry")
    return rows_without(entries.filter("_row = _entry"), gone, "_entry").select(*[F.col("_text" if c == text_col else f"_c{carry.index(c)}").alias(c) for c in docs.columns])
