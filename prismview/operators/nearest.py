"""The most similar earlier entry of each query, exactly: matrix products find the candidates, sums in SQL's order decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prismview.sources.tables import dropped, state_folder

#: Queries that a task holds, entries that they meet at once, and candidates that are summed at once.
BLOCK, CHUNK, PAIRS = 4096, 1024, 1 << 16
#: Half of the last digit of a rounded similarity, and what a product of units in single precision may be off for each dimension.
HALF, SLACK = 0.5e-6, 2.0**-24


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up in order."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves away from zero."""
    y = np.abs(x) * 1e6
    whole = np.floor(y)
    return np.copysign((whole + (y - whole >= 0.5)) / 1e6, x) + 0.0


@dataclass
class Group:
    """Vectors of one dimension. ``units`` is NaN where a product of units tells nothing."""

    rows: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    units: np.ndarray


def groups_of(column: pa.Array, once: bool = False) -> dict[int, Group]:
    """By dimension; vectors that are null, hold a null or have no length have no similarity and are left out. ``once``: also copies of an earlier one."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).copy()
    flat = column.flatten()
    if flat.null_count:
        sizes[pc.list_parent_indices(column).filter(flat.is_null()).to_numpy()] = -1
    found = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        vectors = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy().reshape(-1, d)
        lengths = np.sqrt(summed(vectors, vectors))
        some = np.flatnonzero(lengths != 0)
        if once:
            some = some[np.sort(np.unique(vectors[some].view(f"V{8 * d}").ravel(), return_index=True)[1])]
        rows, vectors, lengths = rows[some], vectors[some], lengths[some]
        if len(rows):
            units = vectors / lengths[:, None]
            units[~((lengths > 1e-100) & np.isfinite(lengths))] = np.nan
            found[int(d)] = Group(rows, vectors, lengths, units.astype(np.float32))
    return found


class Search:
    """What is known of a block of queries, in the order of their positions, after some entries."""

    def __init__(self, queries: pa.Table):
        self.queries = queries.combine_chunks().sort_by("position")
        self.position = self.queries["position"].to_numpy()
        self.groups = groups_of(self.queries["vector"].combine_chunks())
        n = len(self.position)
        # Similarities as they are ordered: none -inf, NaN inf. Without any the earliest entry stays.
        self.best, self.at, self.entry = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max), np.full(n, None, object)

    def meet(self, entries: pa.RecordBatch) -> bool:
        """Takes entries in the order of their positions; False if they are too late for all queries."""
        position = entries["position"].to_numpy()
        if not len(position) or position[0] >= self.position[-1]:
            return False
        names = np.array(entries["name"].to_pylist(), object)
        first = (self.best == -np.inf) & (position[0] < np.minimum(self.position, self.at))
        self.at[first], self.entry[first] = position[0], names[0]
        for d, e in groups_of(entries["vector"], once=True).items():
            if d in self.groups:
                self._compare(self.groups[d], e, position[e.rows], names[e.rows])
        return True

    def _compare(self, q: Group, e: Group, position: np.ndarray, names: np.ndarray) -> None:
        low = int(np.searchsorted(self.position[q.rows], position[0], side="right"))
        rows = q.rows[low:]
        if not len(rows):
            return
        products = q.units[low:] @ e.units.T
        mixed = int(np.searchsorted(self.position[rows], position[-1], side="right"))
        products[:mixed][position[None, :] >= self.position[rows[:mixed], None]] = -np.inf
        most = products.max(axis=1)
        slack = SLACK * (q.vectors.shape[1] + 8)
        level = self.best[rows] + np.where(position[0] < self.at[rows], -HALF, HALF) - slack  # what may win: ties only if earlier
        open_ = np.flatnonzero(~(most < level))
        if not len(open_):
            return
        floor = np.maximum(level[open_], most[open_] - 2 * HALF - 2 * slack).astype(np.float32)
        i, j = np.nonzero(~(products[open_] < floor[:, None]))
        i = open_[i]
        earlier = position[j] < self.position[rows[i]]
        i, j = i[earlier], j[earlier]
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            lengths = q.lengths[low + x] * e.lengths[y]
            key = np.where(lengths == 0, -np.inf, rounded(summed(q.vectors[low + x], e.vectors[y]) / np.where(lengths == 0, 1.0, lengths)))
            key[np.isnan(key)] = np.inf
            order = np.lexsort((y, -key, x))
            order = order[np.unique(x[order], return_index=True)[1]]
            row, y, key = rows[x[order]], y[order], key[order]
            won = (key > self.best[row]) | ((key == self.best[row]) & (position[y] < self.at[row]))
            row, y = row[won], y[won]
            self.best[row], self.at[row], self.entry[row] = key[won], position[y], names[y]

    def result(self, kind: pa.DataType) -> pa.RecordBatch:
        met = np.flatnonzero(self.at < np.iinfo(np.int64).max)
        best = np.where(self.best == np.inf, np.nan, self.best)[met]
        columns = [self.queries["name"].combine_chunks().take(pa.array(met)), pa.array(self.entry[met].tolist(), kind), pa.array(best, mask=best == -np.inf)]
        return pa.RecordBatch.from_arrays(columns, names=["name", "entry", "similarity"])


#: What Arrow calls the schemes of Hadoop.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def sorted_files(path: str) -> list[pq.ParquetFile]:
    """The files of a table whose files are ordered by ``position``, by their first positions."""
    scheme, _, rest = path.partition(":")
    fs, folder = pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}" if rest else f"file://{path}")
    files = [pq.ParquetFile(fs.open_input_file(i.path)) for i in fs.get_file_info(pafs.FileSelector(folder)) if i.path.endswith(".parquet")]
    at = lambda f: f.metadata.row_group(0).column(f.schema_arrow.names.index("position")).statistics.min
    return sorted((f for f in files if f.metadata.num_rows), key=at)


def search(batches: Iterator[pa.RecordBatch], path: str, block: int) -> Iterator[pa.RecordBatch]:
    """Queries to their best entries; the entries are read as a stream for each block of queries."""

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        with np.errstate(all="ignore"):
            known, kind = Search(pa.Table.from_batches(parts)), None
            for file in sorted_files(path):
                with file:
                    kind = file.schema_arrow.field("name").type
                    for entries in file.iter_batches(CHUNK, columns=["position", "name", "vector"], use_threads=False):
                        if not known.meet(entries):
                            break
        return None if kind is None else known.result(kind)

    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, block - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == block:
                if (told := found(held)) is not None:
                    yield told
                held, n = [], 0
    if n and (told := found(held)) is not None:
        yield told


def best_entries(queries: DataFrame, entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """The most similar earlier entry of each query. Both: ``name, position, vector``; ties go to the earlier entry.

    Positions are whole numbers. Entries are written once to the shared folder and never copied: tasks of about ``block``
    queries read them as a stream, as far as the last position of their queries. A query without any similarity
    (null, zero or of another dimension) has the earliest entry and null.
    """
    spark, folder = queries.sparkSession, state_folder(queries.sparkSession)
    columns = ["name", F.col("position").cast("long").alias("position"), "vector"]
    entries = entries.select(*columns).filter("position IS NOT NULL")
    entries.sortWithinPartitions("position").write.option("compression", "zstd").parquet(f"{folder}/entries")
    queries = queries.select(*columns).filter("position IS NOT NULL")
    parts = max(1, -(-queries.count() // block))
    schema = StructType([queries.schema["name"], StructField("entry", entries.schema["name"].dataType), StructField("similarity", DoubleType())])
    found = queries.repartition(parts, "position").mapInArrow(lambda batches: search(batches, f"{folder}/entries", block), schema)
    found.write.option("compression", "zstd").parquet(f"{folder}/best")
    dropped(spark, f"{folder}/entries")
    return spark.read.schema(schema).parquet(f"{folder}/best")
