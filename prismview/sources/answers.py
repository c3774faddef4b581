"""Paid answers: a log that every oracle call goes through, caches and replay matrices."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from prismview.functions.text import call_cost, yes_no
from prismview.sources.tables import exists, read_texts, write_text

ANSWER = "version string, query_index int, tag string, part string, row_id long, answer boolean, pid string"
CACHED = "model string, pver string, claim string, row_id long, answer boolean, prompt_tokens long, output_tokens long, raw string, written long"


class AnswerLog:
    """Every oracle call goes through this table; what it holds is never asked again.

    Answers are written before they are used, a folder a predicate, so neither a task that runs
    again nor a query that broke off asks twice. An oracle with ``chunk_rows`` is asked in
    chunks of about so many rows, each committed on its own: a failure loses one chunk at most.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, pid: str) -> str:
        return f"{self.path}/pid={pid}"

    def known(self, version: str, pid: str) -> DataFrame | None:
        """``row_id, answer, part`` of what the predicate has been asked, or None."""
        if not exists(self.spark, self._folder(pid)):
            return None
        rows = self.spark.read.schema(ANSWER.rsplit(", ", 1)[0]).parquet(self._folder(pid))
        return rows.filter(F.col("version") == version).select("row_id", "answer", "part")

    def ask(self, oracle, predicate, rows: DataFrame, query_index: int, tag: str, again: bool = True) -> tuple[DataFrame, int, int]:
        """``row_id, answer, paid`` of ``rows`` (``row_id`` and what the oracle needs): from the log, else from the oracle; rows paid for, and answers that are yes.

        ``again=False``: none of ``rows`` has been asked about before, so the log need not be searched, and the job
        that writes the answers counts them.
        """
        before = self.known(oracle.version, predicate.pid) if again else None
        open_ = rows if before is None else rows.join(before.select("row_id"), "row_id", "left_anti")
        chunk, part = getattr(oracle, "chunk_rows", None), uuid.uuid4().hex
        chunks = max(1, -(-open_.count() // chunk)) if chunk else 1
        counted = []
        for i in range(chunks):
            counted.append(Observation())
            some = open_ if chunks == 1 else open_.filter(F.pmod(F.xxhash64("row_id"), F.lit(chunks)) == i)
            told = oracle.answers(predicate, some).observe(counted[-1], F.count(F.lit(1)).alias("paid"), F.count_if("answer").alias("yes"))
            told.select(F.lit(oracle.version).alias("version"), F.lit(query_index).alias("query_index"), F.lit(tag).alias("tag"), F.lit(part).alias("part"), "row_id", "answer").write.mode("append").parquet(self._folder(predicate.pid))
        held = self.known(oracle.version, predicate.pid).withColumn("paid", F.col("part") == part)
        if before is None:
            return held.filter("paid").select("row_id", "answer", "paid"), sum(c.get["paid"] for c in counted), sum(c.get["yes"] for c in counted)
        found = held.join(rows.select("row_id"), "row_id", "left_semi").select("row_id", "answer", "paid")
        return found, *found.agg(F.count_if("paid"), F.count_if("answer")).first()

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], ANSWER)
        return self.spark.read.schema(ANSWER).parquet(self.path)

    def charges(self) -> DataFrame:
        """Calls of each query by what they were for."""
        return self.read().groupBy("query_index", "tag").agg(F.count("*").alias("calls"))


def latest_answers(cache: DataFrame) -> DataFrame:
    """An append-only cache as a table: of repeated keys the row written last."""
    last = Window.partitionBy("model", "pver", "claim", "row_id").orderBy(F.desc("written"), "raw")
    return cache.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")


def missing_cells(claims: DataFrame, rows: DataFrame, cache: DataFrame, model: str, pver: str) -> DataFrame:
    """Cells ``row_id, claim`` still to be asked, a row's claims together so that a model can reuse its prompt.

    ``claims`` is a stated list of predicates and small; every row meets each of them.
    """
    known = cache.filter((F.col("model") == model) & (F.col("pver") == pver)).select("claim", "row_id").distinct()
    cells = rows.select("row_id", F.explode(F.array(*[F.lit(r[0]) for r in claims.select("claim").collect()])).alias("claim"))
    return cells.join(known, ["claim", "row_id"], "left_anti").repartition("row_id").sortWithinPartitions("row_id", "claim")


def cache_cost(cache: DataFrame, prompt_price: float = 0.15, output_price: float = 0.60) -> DataFrame:
    """Cells, tokens and dollars per model and prompt version."""
    totals = cache.groupBy("model", "pver").agg(F.count("*").alias("cells"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return totals.withColumn("dollars", call_cost(F.col("prompt_tokens"), F.col("output_tokens"), prompt_price, output_price))


def incomplete_claims(matrix: DataFrame, n_rows: int) -> DataFrame:
    """Claims of ``claim, row_id, answer`` that lack answers."""
    return matrix.groupBy("claim").agg(F.countDistinct("row_id").alias("answered")).filter(F.col("answered") < n_rows)


def cached_matrix(cache: DataFrame, claims: DataFrame, rows: DataFrame, model: str, pver: str) -> DataFrame:
    """``claim, row_id, answer`` of every cell of ``claims`` x ``rows``, the latest answer of each; an error if one is missing."""
    own = latest_answers(cache.filter((F.col("model") == model) & (F.col("pver") == pver)))
    cells = rows.select("row_id", F.explode(F.array(*[F.lit(r[0]) for r in claims.select("claim").collect()])).alias("claim"))  # a stated list
    found = cells.join(own.select("claim", "row_id", "answer"), ["claim", "row_id"], "left")
    short = found.filter("answer IS NULL").groupBy("claim").count().orderBy("claim").collect()
    if short:
        raise KeyError("answers missing: " + ", ".join(f"{r['count']} of {r.claim!r}" for r in short))
    return found.select("claim", "row_id", "answer")


def save_matrix(matrix: DataFrame, path: str, **told) -> None:
    """``claim, row_id, answer`` as a table, and what is known about it (model, corpus, prompt version, tokens) beside it."""
    matrix.select(F.col("claim").alias("text"), "row_id", "answer").write.mode("overwrite").parquet(f"{path}/answers")
    write_text(matrix.sparkSession, f"{path}/about.json", json.dumps(told))


def load_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A saved matrix, ``text, row_id, answer`` as a replay oracle reads it, and what is known about it."""
    return spark.read.schema("text string, row_id long, answer boolean").parquet(f"{path}/answers"), json.loads(read_texts(spark, path, "about.json")[0])


RUN = "model string, pver string, calls long, seconds double, prompt_tokens long, output_tokens long"


def fill_cache(spark: SparkSession, path: str, claims: DataFrame, rows: DataFrame, client: Callable[[], Callable[[str, str], tuple[str, int, int]]], model: str, pver: str, chunk_cells: int = 100_000, first_row: int | None = None, last_row: int | None = None) -> int:
    """Asks for the cells of ``claims`` x ``rows`` that the cache under ``path`` lacks, and appends them; returns their number.

    ``rows``: ``row_id, text``; ``client()`` makes ``(claim, text) -> (reply, prompt tokens, output tokens)`` on the
    executors. Cells are asked in chunks of about ``chunk_cells``, a row's claims together; each chunk and its line in the
    run log are committed before the next is asked, so a job that broke off is resumed by calling again. ``first_row`` and
    ``last_row`` (included) leave the other rows to other jobs.
    """
    if first_row is not None:
        rows = rows.filter(F.col("row_id") >= first_row)
    if last_row is not None:
        rows = rows.filter(F.col("row_id") <= last_row)
    cache = spark.read.schema(CACHED).parquet(f"{path}/answers") if exists(spark, f"{path}/answers") else spark.createDataFrame([], CACHED)
    wanted = missing_cells(claims, rows, cache, model, pver)
    many, total = wanted.count(), 0
    parts = max(1, -(-many // chunk_cells)) if many else 0

    def ask(batches):
        call = client()
        for batch in batches:
            told = [call(c, t or "") for c, t in zip(batch["claim"], batch["text"], strict=True)]
            yield pd.DataFrame({"claim": batch["claim"], "row_id": batch["row_id"], "raw": [t[0] for t in told], "prompt_tokens": [t[1] for t in told], "output_tokens": [t[2] for t in told]})

    for part in range(parts):
        began = time.time()
        stamp = int(began * 1e6)
        some = wanted.filter(F.pmod(F.xxhash64("row_id"), F.lit(parts)) == part).join(rows.select("row_id", "text"), "row_id")
        replies = some.sortWithinPartitions("row_id", "claim").mapInPandas(ask, "claim string, row_id long, raw string, prompt_tokens long, output_tokens long")
        made = replies.select(F.lit(model).alias("model"), F.lit(pver).alias("pver"), "claim", "row_id", yes_no(F.col("raw")).alias("answer"), "prompt_tokens", "output_tokens", "raw", F.lit(stamp).alias("written"))
        made.write.mode("append").parquet(f"{path}/answers")
        added = spark.read.schema(CACHED).parquet(f"{path}/answers").filter(F.col("written") == stamp).agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("p"), F.sum("output_tokens").alias("o")).first()
        if added.n:
            spark.createDataFrame([(model, pver, added.n, time.time() - began, added.p, added.o)], RUN).write.mode("append").parquet(f"{path}/runs")
        total += added.n
    return total


def run_cost(spark: SparkSession, path: str) -> DataFrame:
    """Cells and tokens from the answers, calls and seconds from the run log (cells where that is empty)."""
    cells = cache_cost(spark.read.schema(CACHED).parquet(f"{path}/answers"))
    runs = spark.read.schema(RUN).parquet(f"{path}/runs") if exists(spark, f"{path}/runs") else spark.createDataFrame([], RUN)
    logged = runs.groupBy("model", "pver").agg(F.sum("calls").alias("calls"), F.sum("seconds").alias("seconds"))
    return cells.join(logged, ["model", "pver"], "left").withColumn("calls", F.coalesce("calls", "cells"))
