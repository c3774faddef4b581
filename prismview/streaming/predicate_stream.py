"""Predicates that arrive as a stream are answered batch by batch, in order, with one store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismview.operators.engine import QueryResult, ReuseEngine
from prismview.plans.predicates import Predicate


def answer_stream(predicates: DataFrame, engine: ReuseEngine, sink: Callable[[QueryResult], None], checkpoint: str):
    """``predicates``: a stream of ``position, text, labels``. Returns the running query.

    A batch holds questions, not rows of the corpus, so it is small. Views and answers are in the
    engine's folder: a batch that runs again after a failure, also in a new engine over that
    folder, finds finished questions in the store and pays only for answers that were not written.
    """

    def run(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("position").select("text", F.coalesce("labels", F.array().cast("array<string>")).alias("labels")).toLocalIterator():
            sink(engine.query(Predicate(r.text, frozenset(r.labels))))

    return predicates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
