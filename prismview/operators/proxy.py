"""A cheap score that drops candidates which are very unlikely to be positive."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismview.functions.sampling import sample_key, sample_pool
from prismview.functions.vectors import dot
from prismview.operators.baselines import NoReasoner
from prismview.operators.engine import QueryResult, ReuseEngine
from prismview.plans.predicates import Predicate
from prismview.plans.rewrite import CANDIDATE, PRUNED, Plan


@dataclass(frozen=True)
class HashingEmbedder:
    """Unit vectors of character trigram counts: of a text on the driver, or of a column."""

    dim: int = 256

    def __call__(self, text: str) -> list[float]:
        tidy = " ".join(text.lower().split())
        counts = [0.0] * self.dim
        for gram, n in Counter(tidy[i : i + 3] for i in range(max(len(tidy) - 2, 1))).items():
            counts[int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % self.dim] += n
        length = math.sqrt(sum(c * c for c in counts))
        return [c / length for c in counts]

    def column(self, text: Column) -> Column:
        """The same for whole texts of a column, in Arrow batches."""

        @F.pandas_udf("array<double>")
        def embedded(texts: pd.Series) -> pd.Series:
            return texts.map(self)

        return embedded(F.coalesce(text, F.lit("")))


def embed_documents(docs: DataFrame, embedder: HashingEmbedder, path: str) -> DataFrame:
    """``row_id, vector`` of ``row_id, text``, computed once and written."""
    docs.select("row_id", embedder.column(F.col("text")).alias("vector")).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _inner(weights: list[float], shift: float = 0.0) -> Column:
    return dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in weights])) + F.lit(float(shift))


def zero_shot_scores(rows: DataFrame, query: list[float]) -> DataFrame:
    """``row_id, score``: inner product with the query's vector. ``rows``: ``row_id, vector``."""
    return rows.select("row_id", _inner(query).alias("score"))


def fit_proxy(rows: DataFrame, pilot: DataFrame, c: float = 1.0) -> tuple[list[float], float] | None:
    """Weights and intercept of a class-balanced logistic regression on pilot answers; None if the pilot has one class only."""
    counts = {r[0]: r[1] for r in pilot.groupBy("answer").count().collect()}
    if len(counts) < 2:
        return None
    n = sum(counts.values())
    weight = F.when(F.col("answer"), n / (2 * counts[True])).otherwise(n / (2 * counts[False]))
    sample = rows.join(F.broadcast(pilot.select("row_id", "answer")), "row_id")  # as many rows as the pilot
    sample = sample.select(array_to_vector("vector").alias("x"), F.col("answer").cast("double").alias("y"), weight.alias("w"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", standardization=False, regParam=1 / (c * n)).fit(sample)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def trained_scores(rows: DataFrame, pilot: DataFrame, c: float = 1.0) -> DataFrame | None:
    """``row_id, score`` of the fitted proxy, its decision value; None if there is nothing to fit."""
    fitted = fit_proxy(rows, pilot, c)
    return None if fitted is None else rows.select("row_id", _inner(*fitted).alias("score"))


def choose_cutoff(scored_pilot: DataFrame, recall: float = 0.9, safety: float = 0.5, least_positives: int = 8, least_kept_recall: float = 0.95, least_dropped: float = 0.2, seed: int = 0) -> float | None:
    """A score below which rows may go: a low quantile of half the pilot's positives, checked on the other half.

    ``scored_pilot``: ``row_id, score, answer``. None if there is too little to tell or too little to gain.
    """
    key = sample_key(seed, 0, "cutoff", F.lit(""), F.col("row_id"))
    halves = scored_pilot.withColumn("half", F.when(F.col("answer"), F.row_number().over(Window.partitionBy("answer").orderBy(key, "row_id")) % 2))
    fitted = halves.agg(F.count_if("answer").alias("positives"), F.percentile(F.when(F.col("half") == 1, F.col("score")), (1 - recall) * safety).alias("cutoff")).first()
    if fitted.positives < least_positives:
        return None
    above = F.col("score") >= fitted.cutoff
    kept = halves.agg(F.avg(F.when(F.col("half") == 0, above.cast("double"))).alias("recall"), F.avg(above.cast("double")).alias("share")).first()
    return None if kept.recall is None or kept.recall < least_kept_recall or kept.share > 1 - least_dropped else float(fitted.cutoff)


def values_at(rows: DataFrame, column: str, ranks: list[int], bins: int = 1024, most: int = 10_000) -> dict[int, float]:
    """The values at ranks (from 0) of a column without nulls, by histograms that are refined only where a rank falls.

    The driver holds ``bins`` counts for each rank, and at last the distinct values of a bin of at most ``most`` rows.
    """
    found: dict[int, float] = {}
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    open_ = {(low, high, 0): [r for r in ranks if r < n]} if n else {}  # (bounds, rows below) to ranks inside
    while open_:
        (low, high, below), inside = open_.popitem()
        own = rows.filter(F.col(column).between(low, high))
        width = (high - low) / bins
        many = own.count() if (low, high, below) != (None, None, None) else n
        if many <= most or width == 0 or low + width == low:
            seen = below
            for r in own.groupBy(column).count().orderBy(column).collect():
                found |= {k: r[0] for k in inside if seen <= k < seen + r[1]}
                seen += r[1]
            continue
        slot = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        seen = below
        for r in own.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("slot").collect():
            if within := [k for k in inside if seen <= k < seen + r.n]:
                open_[(r.low, r.high, seen)] = within
            seen += r.n
    return found


def score_bands(dropped: DataFrame, bands: int) -> DataFrame:
    """``row_id, band``: dropped rows in near-equal bands from high to low scores. ``dropped``: ``row_id, score``.

    Band edges are interpolated quantiles, found by refined histograms: no task sorts or holds all scores.
    """
    n = dropped.count() if bands > 1 else 0
    places = [i * (n - 1) / bands for i in range(1, bands)] if n else []
    at = values_at(dropped, "score", sorted({r for p in places for r in (math.floor(p), math.ceil(p))})) if places else {}
    band = F.lit(0)
    for p in places:
        low, high = at[math.floor(p)], at[math.ceil(p)]
        band = band + F.when(F.col("score") < low + (high - low) * (p - math.floor(p)), 1).otherwise(0)
    return dropped.select("row_id", band.cast("int").alias("band"))


@dataclass
class EmbeddingProxy:
    """Scores by row vectors; remembers what it fitted for a text. ``rows``: ``row_id, vector``; ``embed(text)`` gives a vector."""

    rows: DataFrame
    embed: object
    fitted: dict[str, tuple[list[float], float] | None] = field(default_factory=dict)
    stats: dict[str, int] = field(default_factory=lambda: {"fits": 0, "zero_shot": 0})

    def zero_shot(self, predicate: Predicate) -> DataFrame:
        self.stats["zero_shot"] += 1
        return zero_shot_scores(self.rows, self.embed(predicate.text))

    def scores(self, predicate: Predicate, pilot: DataFrame) -> DataFrame:
        """Trained on the pilot, once a text; zero-shot if there is nothing to fit."""
        if predicate.text not in self.fitted:
            self.fitted[predicate.text] = fit_proxy(self.rows, pilot)
            self.stats["fits"] += 1
        own = self.fitted[predicate.text]
        return self.zero_shot(predicate) if own is None else self.rows.select("row_id", _inner(*own).alias("score"))

    def reset_training(self) -> None:
        """Forgets what pilots taught, as a pilot belongs to the engine that drew it."""
        self.fitted.clear()


@dataclass
class ProxyCascade:
    """Pilot, score, cutoff: what it drops becomes strata that the audit covers."""

    proxy: EmbeddingProxy
    pilot: int = 200
    recall: float = 0.9
    bands: int = 4

    def cut(self, plan: Plan, predicate: Predicate, ask, seed: int, query: int) -> tuple[Plan, DataFrame | None]:
        """The plan with dropped rows pruned, and the pilot's answers, if one was drawn."""
        pool = plan.rows.filter(F.col("role") == CANDIDATE)
        if pool.limit(self.pilot + 1).count() <= self.pilot:
            return plan, None
        answers = ask(sample_pool(pool, self.pilot, seed, query, "pilot"), "pilot")
        scores = self.proxy.scores(predicate, answers)
        cutoff = choose_cutoff(scores.join(F.broadcast(answers), "row_id"), self.recall, seed=seed)  # as many rows as the pilot
        if cutoff is None:
            return plan, answers
        dropped = pool.select("row_id").join(scores, "row_id").filter(F.col("score") < cutoff).join(answers.select("row_id"), "row_id", "left_anti")
        banded = score_bands(dropped, self.bands).select("row_id", F.concat(F.lit("proxy:band"), F.col("band").cast("string")).alias("band"))
        kept = [c for c in plan.rows.columns if c not in ("role", "stratum")]
        rows = plan.rows.join(banded, "row_id", "left").select(*kept, F.when(F.col("band").isNotNull(), PRUNED).otherwise(F.col("role")).alias("role"), F.coalesce("stratum", "band").alias("stratum"))
        return plan.with_rows(rows), answers


class ProxyCascadeEngine(ReuseEngine):
    """The cascade alone, with the same certificate: no view is reused and every query begins anew."""

    def __init__(self, corpus: DataFrame, oracle, proxy: ProxyCascade, **options):
        super().__init__(corpus, oracle, NoReasoner(), proxy=proxy, **options)

    def query(self, predicate: Predicate) -> QueryResult:
        self.store.by_key.clear()
        return replace(super().query(predicate), reuse="proxy-cascade")
