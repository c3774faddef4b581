"""A quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector w is shared by all
grades, and ordered thresholds cut its axis. x holds the distinct words of a text,
hashed into SLOTS slots and scaled to length one, and a few hashed shapes (share of
distinct words, of words equal to the one before, of symbols, digits and capitals, length,
runs of symbols) that each weigh one. The expected grade ranks documents; the tail probability of a grade selects
them.

Training maximises the likelihood with a ridge penalty by limited-memory quasi-Newton
steps (L-BFGS). A step is one Spark job over the written sample, whose tasks sum
likelihood and gradients of their rows; the driver holds SLOTS weights and a few
former steps. It ends when a step gains less than CONVERGED of the objective, or after
STEPS jobs. Thresholds keep their order, as their gaps are fitted as logarithms. The
sample has at most SAMPLE rated rows of each grade, taken in hash order, and weighs
each grade as often as it is rated. Rows with crc32(id as text) mod 5 = 0 are held out.

A null or empty text has no words and gets the grade that its shapes imply. Null grades
are not learnt from. With fewer than two grades in training nothing can be learnt: the
expected grade is the one grade (or null) and the tail probability 1 or 0 (or null). A
null id is scored and counts as not held out. Repeated rows each get their row. An empty
table gives an empty result. Other columns are ignored, whatever their names. Texts of
any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismview.llm.scratch import held, written
from prismview.llm.toxicity import held_out

SAMPLE, SLOTS, STEPS, RIDGE = 10_000, 1 << 16, 40, 1e-4
#: Share of the objective that a step gains at least, and former steps that shape the next.
CONVERGED, MEMORY = 2e-3, 6
#: Tasks of a training step: each sends SLOTS numbers to the driver.
TASKS = 16
SYMBOLS = re.compile(r"[^\w\s]{2,}")
SCORED = "doc_id long, expected_grade double, tail double"


class WordSlots(dict):
    """Word to slot; a bounded number of words is remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word) % SLOTS
        return found


def shapes(text: str, words: list[str], distinct: int) -> list[str]:
    """Names of a text's shapes; blanks keep them apart from words."""
    n, chars = len(words), max(len(text), 1)
    tenth = lambda a, b: min(int(10 * a / max(b, 1)), 10)
    letters = sum(map(str.isalpha, text)) if n else 0
    lines = [x for x in text.split("\n") if x]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        f" length {int(math.log2(n + 1))}",
        f" distinct {tenth(distinct, n)} of {int(math.log2(n + 1))}",
        f" letters {min(int(20 * letters / chars), 20)}",
        f" again {tenth(again, n - 1)}",
        f" lines {tenth(len(set(lines)), len(lines))}",
        f" word {min(int(letters / max(n, 1)), 20)}",
        f" symbols {min(int(math.log2(1 + 100 * len(SYMBOLS.findall(text)) / max(n, 1))), 8)}",
    ]


def features(text: str) -> tuple[np.ndarray, int]:
    """Slots of the distinct words, then of the shapes, and the number of the former."""
    slots = held("word slots", WordSlots)
    words = text.lower().split()
    own = set(words)
    of_words = np.unique(np.fromiter(map(slots.__getitem__, own), np.int32, len(own)))
    return np.concatenate([of_words, np.array([slots[s] for s in shapes(text, words, len(own))], np.int32)]), len(of_words)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def axis(self, slots: np.ndarray, n_words: int) -> float:
        w = self.weights[slots]
        return float(w[:n_words].sum() / math.sqrt(max(n_words, 1)) + w[n_words:].sum())

    def tails(self, at: float) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - at, -500, 500)))


def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t or "") for t in batch["text"].to_pylist()]
        slots = pa.array([m[0] for m in made], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([slots, pa.array([m[1] for m in made], pa.int32()), batch["grade"], batch["weight"]], names=["slots", "n_words", "grade", "weight"])


def gradient(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """One row a task: summed gradients of the log-likelihood."""
    model: Model = shared.value
    grades = len(model.thresholds) + 1
    likelihood, for_weights, for_thresholds = 0.0, np.zeros(SLOTS), np.zeros(grades - 1)
    edges = np.concatenate([[-np.inf], model.thresholds, [np.inf]])
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch["slots"]
        slots, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        slots, offsets = slots[offsets[0] : offsets[-1]], offsets - offsets[0]
        n_words, grade, weight = (batch[c].to_numpy() for c in ("n_words", "grade", "weight"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        is_word = np.arange(len(slots)) - offsets[owner] < n_words[owner]
        value = np.where(is_word, 1 / np.sqrt(np.maximum(n_words, 1))[owner], 1.0)
        at = np.bincount(owner, model.weights[slots] * value, batch.num_rows)
        above, below = (1 / (1 + np.exp(-np.clip(edges[grade + d] - at, -500, 500))) for d in (1, 0))
        chance = np.maximum(above - below, 1e-12)
        likelihood += float((weight * np.log(chance)).sum())
        for_weights += np.bincount(slots, (weight * (above + below - 1))[owner] * value, SLOTS)
        up, down = weight * above * (1 - above) / chance, weight * below * (1 - below) / chance
        for_thresholds += np.array([up[grade == k].sum() - down[grade == k + 1].sum() for k in range(grades - 1)])
    yield pa.RecordBatch.from_arrays([pa.array([likelihood]), pa.array([for_weights.tobytes()]), pa.array([for_thresholds.tobytes()])], names=["likelihood", "weights", "thresholds"])


def model_of(point: np.ndarray) -> Model:
    """Weights, first threshold and logarithms of the gaps between thresholds as a model."""
    return Model(point[:SLOTS], point[SLOTS] + np.concatenate([[0.0], np.cumsum(np.exp(point[SLOTS + 1 :]))]))


def ascend(objective, start: np.ndarray, steps: int, converged: float = CONVERGED) -> tuple[np.ndarray, int]:
    """The point at which ``objective(point) -> (value, gradient)`` is greatest, and the evaluations that took. L-BFGS with halved steps."""
    point, (value, slope), used, memory = start, objective(start), 1, []
    size = 1.0 / max(float(np.abs(slope).max()), 1e-12)
    while used < steps:
        way, factors = slope.copy(), []
        for s, y, r in reversed(memory):
            factors.append(r * float(s @ way))
            way -= factors[-1] * y
        if memory:
            s, y, r = memory[-1]
            way *= 1 / (r * float(y @ y))
        for (s, y, r), f in zip(memory, reversed(factors), strict=True):
            way += s * (f - r * float(y @ way))
        rise, length = float(slope @ way), 1.0 if memory else size
        while True:
            there = point + length * way
            at, up = objective(there)
            used += 1
            if at >= value + 1e-4 * length * rise or used >= steps or length < 1e-6:
                break
            length /= 2
        if at <= value:
            break
        step, turn = there - point, slope - up  # the objective is concave: turn and step point the same way
        if float(step @ turn) > 1e-12:
            memory = [*memory, (step, turn, 1 / float(step @ turn))][-MEMORY:]
        gained, point, value, slope = at - value, there, at, up
        if gained < converged * abs(value):
            break
    return point, used


def train(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE, steps: int = STEPS) -> Model | int | None:
    """``docs``: ``doc_id, text``; ``ratings``: ``doc_id, grade`` from 0. A single grade is returned as it is."""
    usable = ratings.filter((F.col("grade") >= 0) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("grade").cast("int").alias("grade")).distinct()
    sizes = {r[0]: r[1] for r in usable.groupBy("grade").count().collect()}  # a row a grade
    if len(sizes) < 2:
        return next(iter(sizes), None)
    picked = None
    for g, n in sorted(sizes.items()):
        own = usable.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumn("weight", F.lit(n / min(n, sample_rows) / sum(sizes.values())))
        picked = own if picked is None else picked.union(own)
    ids = written(picked, "ids")  # sample_rows a grade at most
    sample = docs.join(F.broadcast(ids), "doc_id").select("text", "grade", "weight")
    rows = written(sample.mapInArrow(featurize, "slots array<int>, n_words int, grade int, weight double"), "sample")
    rows = rows.coalesce(TASKS)
    grades = max(sizes) + 1
    share = np.cumsum([max(sizes.get(g, 0), 0.5) for g in range(grades)])[:-1] / (sum(sizes.values()) + 0.5 * grades)
    first = np.log(share / (1 - share))
    start = np.concatenate([np.zeros(SLOTS), first[:1], np.log(np.maximum(np.diff(first), 1e-6))])

    def objective(point: np.ndarray) -> tuple[float, np.ndarray]:
        model = model_of(point)
        shared = docs.sparkSession.sparkContext.broadcast(model)
        parts = rows.mapInArrow(lambda b: gradient(b, shared), "likelihood double, weights binary, thresholds binary").collect()  # TASKS rows at most
        shared.unpersist()
        for_thresholds = np.sum([np.frombuffer(p.thresholds) for p in parts], axis=0)
        above = np.cumsum(for_thresholds[::-1])[::-1]  # a gap moves all thresholds above it
        gaps = above[1:] * np.exp(point[SLOTS + 1 :])
        for_weights = np.sum([np.frombuffer(p.weights) for p in parts], axis=0) - RIDGE * model.weights
        return sum(p.likelihood for p in parts) - RIDGE / 2 * float(model.weights @ model.weights), np.concatenate([for_weights, above[:1], gaps])

    return model_of(ascend(objective, start, steps)[0])


def score(batches: Iterator[pa.RecordBatch], shared, least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        expected, tail = [], []
        for text in batch["text"].to_pylist():
            tails = model.tails(model.axis(*features(text or "")))
            expected.append(float(tails.sum()))
            tail.append(float(tails[least - 1]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(expected), pa.array(tail)], schema=schema)


def grade(docs: DataFrame, ratings: DataFrame, least: int = 1, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """``doc_id, held_out, expected_grade, tail, kept``: tail is P(grade >= least), and a document is kept from 0.5."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = train(rows, ratings, sample_rows, steps)
    if isinstance(model, Model):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail", pa.float64())])
        found = written(rows.mapInArrow(lambda b: score(b, shared, least, schema), SCORED), "grades")
    else:
        known = F.lit(model).cast("double")
        found = rows.select("doc_id", known.alias("expected_grade"), (known >= least).cast("double").alias("tail"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).alias("kept"))
