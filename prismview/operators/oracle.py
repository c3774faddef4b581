"""Oracles: whatever can say whether a predicate holds for a row, at a price."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismview.plans.predicates import Predicate


#: Multiplier and shift of the two mixing steps, and the bits dropped for a 53-bit fraction.
FIRST_FACTOR, FIRST_SHIFT, SECOND_FACTOR, SECOND_SHIFT, DROPPED_BITS = 0x9E3779B97F4A7C15, 31, 0xBF58476D1CE4E5B9, 27, 11


def flip_column(row_id: Column, text: str, seed: int, rate: float) -> Column:
    """Deterministic answer noise: true for about ``rate`` of the rows, by a 64-bit mix of text, seed and row.

    Spark has no unsigned multiplication that wraps, so the mix runs on Arrow batches.
    """
    base = np.uint64(int.from_bytes(hashlib.sha1(f"{text}|{seed}".encode()).digest()[:8], "big"))

    @F.pandas_udf("boolean")
    def flips(rows: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            x = (rows.to_numpy().astype(np.uint64) + base) * np.uint64(FIRST_FACTOR)
            x = (x ^ (x >> np.uint64(FIRST_SHIFT))) * np.uint64(SECOND_FACTOR)
            x = x ^ (x >> np.uint64(SECOND_SHIFT))
        return pd.Series((x >> np.uint64(DROPPED_BITS)) * 2.0**-53 < rate)

    return flips(row_id)


@dataclass
class LabelOracle:
    """Simulated: a row's label is in the predicate's set, unless noise flips the answer. ``corpus``: ``row_id, leaf``."""

    corpus: DataFrame
    noise: float = 0.0
    seed: int = 0
    version: str = "labels"
    #: Columns of the corpus that rows may bring along, which spares a join.
    needs: tuple[str, ...] = ("leaf",)

    def holds(self, predicate: Predicate) -> Column:
        truth = F.coalesce(F.col("leaf").isin(sorted(predicate.labels)), F.lit(False)) if predicate.labels else F.lit(False)
        return truth != flip_column(F.col("row_id"), predicate.text, self.seed, self.noise) if self.noise else truth

    def answers(self, predicate: Predicate, rows: DataFrame) -> DataFrame:
        own = rows if "leaf" in rows.columns else self.corpus.join(rows.select("row_id"), "row_id", "left_semi")
        return own.select("row_id", self.holds(predicate).alias("answer"))

    def truth(self, predicate: Predicate) -> DataFrame:
        return self.corpus.select("row_id", self.holds(predicate).alias("answer"))


@dataclass
class ReplayOracle:
    """Answers stored before. ``matrix``: ``text, row_id, answer``."""

    matrix: DataFrame
    version: str = "replay"

    def answers(self, predicate: Predicate, rows: DataFrame) -> DataFrame:
        known = self.matrix.filter(F.col("text") == predicate.text)
        if known.isEmpty():
            raise KeyError(predicate.text)
        joined = rows.select("row_id").join(known.select("row_id", "answer"), "row_id", "left")
        return joined.select("row_id", F.coalesce("answer", F.raise_error(F.lit(f"no stored answer to: {predicate.text}")).cast("boolean")).alias("answer"))

    def truth(self, predicate: Predicate) -> DataFrame:
        return self.matrix.filter(F.col("text") == predicate.text).select("row_id", "answer")


@dataclass
class HostOracle:
    """A host's own filter: ``keep(text, rows)`` returns the rows that it keeps. Asked through an answer log, so no row twice."""

    keep: Callable[[str, DataFrame], DataFrame]
    version: str = "host"
    chunk_rows: int | None = 1_000_000

    def answers(self, predicate: Predicate, rows: DataFrame) -> DataFrame:
        kept = self.keep(predicate.text, rows).select("row_id", F.lit(True).alias("kept"))
        return rows.select("row_id").join(kept, "row_id", "left").select("row_id", F.col("kept").isNotNull().alias("answer"))


@dataclass
class ModelOracle:
    """A model behind a client, asked on the executors; ``client()`` makes ``(text, document) -> reply`` there.

    ``corpus``: ``row_id, text``. Calls that fail with one of ``failures`` are tried ``attempts`` times, after
    waits that double from ``wait`` seconds to ``longest_wait``. Answers are committed every ``chunk_rows``.
    Documents are sent whole unless ``most_chars`` is given.
    """

    corpus: DataFrame
    client: Callable[[], Callable[[str, str], str]]
    prompt_version: str = "1"
    most_chars: int | None = None
    attempts: int = 6
    wait: float = 1.0
    longest_wait: float = 60.0
    failures: tuple[type[Exception], ...] = (OSError,)
    chunk_rows: int | None = 100_000

    @property
    def version(self) -> str:
        return f"model/{self.prompt_version}"

    def answers(self, predicate: Predicate, rows: DataFrame) -> DataFrame:
        from prismview.functions.text import yes_no

        make, text, cut, attempts, wait, longest, failures = self.client, predicate.text, self.most_chars, self.attempts, self.wait, self.longest_wait, self.failures

        def ask(batches):
            call = make()
            for batch in batches:
                replies = []
                for document in batch["text"]:
                    for attempt in range(attempts):
                        try:
                            replies.append(call(text, (document or "")[:cut]))
                            break
                        except failures:
                            if attempt == attempts - 1:
                                raise
                            time.sleep(min(wait * 2**attempt, longest))
                yield pd.DataFrame({"row_id": batch["row_id"], "reply": replies})

        wanted = self.corpus.join(rows.select("row_id"), "row_id", "left_semi").select("row_id", "text")
        return wanted.mapInPandas(ask, "row_id long, reply string").select("row_id", yes_no(F.col("reply")).alias("answer"))
