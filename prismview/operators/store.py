"""Cached views: a table of rows per view, and what is known about each view."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismview.plans.predicates import Predicate
from prismview.sources.tables import read_texts, write_text

VIEW_ROW = "row_id long, reported boolean, verified boolean"


@dataclass(frozen=True)
class View:
    view_id: int
    predicate: Predicate
    oracle_version: str
    query_index: int
    #: Bounds are None for exact views.
    recall_bound: float | None
    precision_bound: float | None
    derived_from: tuple[str, ...]
    seconds: float
    created: float


class ViewStore:
    """Rows that are reported or verified, one folder a view, so a query reads only the views that it uses.

    What is known about a view is a small file, renamed to its place once the rows are written: a view is
    there whole or not at all, and a store over the same path begins with all of them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.views, self.by_key, self.notes = spark, path, [], {}, []
        for text in read_texts(spark, f"{path}-known", ".json"):
            told = json.loads(text)
            p = Predicate(told["text"], frozenset(told["labels"]), told["name"])
            self._list(View(told["view_id"], p, told["oracle_version"], told["query_index"], told["recall_bound"], told["precision_bound"], tuple(told["derived_from"]), told["seconds"], told["created"]), told["notes"])

    def _list(self, view: View, notes: list) -> None:
        self.views.append(view)
        self.notes.append(notes)
        self.by_key[view.oracle_version, view.predicate.key] = view  # the latest view of a text answers for it

    def add(self, predicate: Predicate, rows: DataFrame, oracle_version: str, query_index: int, recall_bound=None, precision_bound=None, derived_from=(), seconds: float = 0.0, notes: list = ()) -> View:
        """``notes``: what the query taught, kept with the view."""
        view = View(len(self.views), predicate, oracle_version, query_index, recall_bound, precision_bound, tuple(derived_from), seconds, time.time())
        rows.select("row_id", "reported", "verified").filter("reported OR verified").write.mode("overwrite").parquet(f"{self.path}/view_id={view.view_id}")
        told = {"view_id": view.view_id, "text": predicate.text, "labels": sorted(predicate.labels), "name": predicate.name, "oracle_version": oracle_version, "query_index": query_index, "recall_bound": recall_bound, "precision_bound": precision_bound, "derived_from": view.derived_from, "seconds": seconds, "created": view.created, "notes": list(notes)}
        write_text(self.spark, f"{self.path}-known/{view.view_id:08d}.json", json.dumps(told))
        self._list(view, list(notes))
        return view

    def exact(self, predicate: Predicate, oracle_version: str) -> View | None:
        return self.by_key.get((oracle_version, predicate.key))

    def candidates(self, oracle_version: str) -> list[View]:
        return [v for v in self.views if v.oracle_version == oracle_version]

    def rows(self, view_ids: list[int]) -> DataFrame:
        """``view_id, row_id, reported, verified``; folders of other views are not read."""
        all_rows = self.spark.read.schema(f"{VIEW_ROW}, view_id int").parquet(self.path)
        return all_rows.filter(F.col("view_id").isin(list(view_ids)))

    def mask(self, corpus: DataFrame, view: View) -> DataFrame:
        """``row_id, reported`` of every row of the corpus."""
        inside = self.rows([view.view_id]).filter("reported").select("row_id", F.lit(True).alias("inside"))
        return corpus.select("row_id").join(inside, "row_id", "left").select("row_id", F.col("inside").isNotNull().alias("reported"))

    def statistics(self) -> DataFrame:
        """Reported and verified rows of each view."""
        return self.rows([v.view_id for v in self.views]).groupBy("view_id").agg(F.count_if("reported").alias("n_positive"), F.count_if("verified").alias("n_verified"))

    def lineage(self) -> DataFrame:
        rows = [(v.view_id, v.predicate.pid, s) for v in self.views for s in v.derived_from]
        return self.spark.createDataFrame(rows, "view_id int, pid string, source_pid string")

    def footprint(self) -> DataFrame:
        """``view_id, files, bytes`` that each view takes in the shared folder."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path).select("path", "length")
        held = files.select(F.regexp_extract("path", r"view_id=(\d+)/", 1).cast("int").alias("view_id"), "length")
        return held.groupBy("view_id").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
