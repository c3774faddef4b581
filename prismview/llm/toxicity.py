"""Toxicity by maximum-scoring segments over token log-odds.

*Log-odds.* Toxic and clean training documents are counted for each word and
prefix they hold (not its occurrences: words come in bursts). A word's share of toxic occurrences has a Dirichlet prior centred on the share of its
longest prefix, that on the share of the next shorter one, and so on up to the
share of all words, so rare and unseen forms of a word lean on their relatives.
The score is the log-odds of a share against that of all words. A word or prefix
is listed if its score differs significantly from its parent's; others take the
score of the nearest listed prefix, or that of the rest. Of N names none is expected
to reach a z-score of sqrt(2 ln N) by chance, and that is the level.

*Segments.* A linear-time scan (Ruzzo and Tompa) finds every maximal segment; each
occurrence of a word has its full score there, and passages are these segments. As
documents are counted, not occurrences, the score of a document is damped: within a
segment the j-th occurrence of a toxic word counts 1 / j of its score, anew in each
segment, and the best stretch of a damped segment is what the segment gives.

*Calibration.* The best segment of n clean words follows an extreme-value law,
P(S >= s) = 1 - exp(-K n exp(-lambda s)); lambda solves the Karlin-Altschul equation
under the clean word frequencies, K is fitted to clean training documents, once for
damped segments and once for passages. All segments of a document that beat chance are
aggregated: the r best have the sum T of their lambda s - ln(K n), which n clean words
reach with probability exp(-T) T^(r-1) / (r! (r-1)!) for large T, halved in weight for
each further segment (r is chosen for the least chance). With x = -log10 of that chance
the score of a document is x / (x + t), where t is the threshold with the fewest errors
in training, so 0.5 is the decision.

Only labelled rows with crc32(id as text) mod 5 <> 0 are learnt from, at most
SAMPLE of each class, taken in hash order; labels, lang, source and id are no
inputs of a score. The model lists every significant name of that bounded sample.

A null or empty text has no words and scores 0. A row with a null id is scored
and counts as not held out; null labels are not learnt from. Without both classes
in training nothing can be learnt and every score is 0. Repeated rows each get
their row; a label counts once for each of its document's rows. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismview.llm.scratch import written

SAMPLE = 20_000
#: Lengths of prefixes.
SHORTEST, LONGEST = 4, 8
#: Prior documents behind a share.
PRIOR = 10.0
#: Segments at or below this E-value are reported as passages.
PASSAGE_E = 0.01

#: Ends the name of a whole word; prefixes have none.
END = "$"

WORD = re.compile(r"[^\W\d_]+")
SCORED = "doc_id long, score double, predicted int, passages array<struct<start:int,end:int,score:double,evalue:double>>"


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Scores(dict):
    """Word to score: its own, else its longest listed prefix's, else that of the rest; a bounded number of words is remembered."""

    def __init__(self, listed: dict[str, float], rest: float):
        super().__init__()
        self.listed, self.rest = listed, rest

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        name = nearest(word + END, self.listed)
        self[word] = found = self.rest if name is None else self.listed[name]
        return found


def nearest(name: str, listed) -> str | None:
    """``name`` itself (a prefix, or a word and END) or its longest prefix that is listed."""
    if name in listed:
        return name
    for k in range(min(LONGEST, len(name) - 1), SHORTEST - 1, -1):
        if name[:k] in listed:
            return name[:k]
    return None


@dataclass
class Model:
    listed: dict[str, float]
    rest: float
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K of damped segments
    passage_scale: float = 1.0  # K of passages
    threshold: float = 1.0

    def passage_evalue(self, score: float, n: int) -> float:
        return self.passage_scale * n * math.exp(-self.decay * score)

    def surprise(self, scores: list[float], n: int) -> float:
        """-log10 of the chance that n clean words hold segments so good: of the r best together, for the r at which it is least."""
        if n <= 0 or not scores:
            return 0.0
        over = sorted((self.decay * s - math.log(self.scale * n) for s in scores), reverse=True)
        e = -over[0]
        # One segment: the exact law. It holds for any score; the sums only for segments beyond chance.
        best = over[0] / math.log(10) if e < -20 else -math.log10(-math.expm1(-math.exp(e))) if e < 3.4 else 0.0
        total = over[0]
        for r, x in enumerate(over[1:], 2):
            if x <= 0:
                break
            total += x
            chance = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + (r - 1) * math.log(2)
            best = max(best, -chance / math.log(10))
        return best


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Every maximal segment as (start, end, score), in one pass over the positive runs.

    Each candidate keeps the running sum before it and after it, and a link to the nearest
    earlier candidate that began lower; those between cannot join a later one that began no
    higher, so a search follows links and looks at no candidate twice in vain. A new
    candidate that no earlier one began below closes all of them. The time is linear.
    """
    done: list[tuple[int, int, float]] = []
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, before, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
        if j < 0:
            done += [(a, b, after - first) for a, b, first, after, _ in found]
            found.clear()
        found.append((start, i + 1, before, total, j))
    return done + [(a, b, after - first) for a, b, first, after, _ in found]


def best_stretch(scores: list[float]) -> float:
    """Score of the best segment; 0 if none is positive."""
    best = run = 0.0
    for s in scores:
        run = max(run + s, 0.0)
        best = max(best, run)
    return best


def segments_of(text: str, scores: Scores) -> tuple[int, list[tuple[int, int, float]], list[float]]:
    """Words of a text, its maximal segments in words, and what each gives when damped."""
    words = WORD.findall(text.lower())
    values = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    positive = values > 0
    if not positive.any():
        return len(words), [], []
    # Sum runs of one sign first: the scan then takes as many steps as there are runs.
    edges = np.concatenate([[0], np.flatnonzero(positive[1:] != positive[:-1]) + 1])
    ends = np.append(edges[1:], len(words))
    runs = maximal_segments(np.add.reduceat(values, edges).tolist())
    damped = []
    for a, b, s in runs:
        first, last = int(edges[a]), int(ends[b - 1])
        seen: Counter[str] = Counter()
        for i in (np.flatnonzero(positive[first:last]) + first).tolist():
            seen[words[i]] += 1
            values[i] /= seen[words[i]]
        again = len(seen) < seen.total()
        damped.append(best_stretch(np.add.reduceat(values[first:last], edges[a:b] - first).tolist()) if again else s)
    return len(words), [(int(edges[a]), int(ends[b - 1]), s) for a, b, s in runs], damped


def names_in(text: str) -> set[str]:
    """Words (with END) and prefixes of a text."""
    words = set(WORD.findall(text.lower()))
    names = {w + END for w in words}
    for k in range(SHORTEST, LONGEST + 1):
        names.update([w[:k] for w in words if len(w) >= k])
    return names


def count_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            counts[toxic].update(names_in(text or ""))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][w] for w in names], pa.int64()), pa.array([counts[0][w] for w in names], pa.int64())], names=["name", "toxic", "clean"])


def learn(sample: DataFrame) -> Model | None:
    """``sample``: ``text, toxic`` (0 or 1), of bounded size."""
    counts = written(sample.mapInArrow(count_names, "name string, toxic long, clean long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "names")
    whole = counts.filter(F.endswith("name", F.lit(END)))
    toxic, clean = whole.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    significant = math.sqrt(2 * math.log(max(counts.count(), 2)))
    if not toxic or not clean:
        return None
    odds = lambda name: F.log(name) - F.log(f"{name}_not")

    def graded(df: DataFrame) -> DataFrame:
        """``name, share, share_not, score, z, toxic, clean`` of counts under a Dirichlet prior with mean ``prior``. A share near 1 is told from 1 by ``share_not``, the share of the clean ones."""
        t, c = F.col("toxic") + PRIOR * F.col("prior"), F.col("clean") + PRIOR * F.col("prior_not")
        both = F.col("toxic") + F.col("clean") + PRIOR
        df = df.select("name", "toxic", "clean", "prior", "prior_not", (t / both).alias("share"), (c / both).alias("share_not"), F.sqrt(1 / t + 1 / c).alias("spread"))
        return df.select("name", "share", "share_not", (odds("share") - math.log(toxic / clean)).alias("score"), (F.abs(odds("share") - odds("prior")) / F.col("spread")).alias("z"), "toxic", "clean")

    all_t, all_c = F.lit(toxic / (toxic + clean)), F.lit(clean / (toxic + clean))
    levels: list[DataFrame] = []
    for k in range(SHORTEST, LONGEST + 1):
        own = counts.filter((F.length("name") == k) & ~F.endswith("name", F.lit(END)))
        if levels:
            above = levels[-1].select(F.col("name").alias("parent"), F.col("share").alias("prior"), F.col("share_not").alias("prior_not"))
            own = own.join(above, F.substring("name", 1, k - 1) == F.col("parent"))
        else:
            own = own.withColumn("prior", all_t).withColumn("prior_not", all_c)
        levels.append(written(graded(own), f"prefix{k}"))
    shares = levels[0].select("name", "share", "share_not")
    for level in levels[1:]:
        shares = shares.union(level.select("name", "share", "share_not"))
    parent = shares.toDF("parent", "above", "above_not")
    stem = F.when(F.length("name") > LONGEST, F.substring("name", 1, LONGEST)).otherwise(F.regexp_replace("name", "[$]$", ""))
    words = whole.join(parent, stem == F.col("parent"), "left").select("name", "toxic", "clean", F.coalesce("above", all_t).alias("prior"), F.coalesce("above_not", all_c).alias("prior_not"))
    found = graded(words)
    for level in levels:
        found = found.union(level)
    top = {r.name: r for r in found.filter(F.col("z") >= significant).collect()}  # names of the bounded sample
    # Occurrences under a listed name, without those under a listed name below it.
    own_t, own_c = {n: r.toxic for n, r in top.items()}, {n: r.clean for n, r in top.items()}
    rest_t, rest_c = toxic, clean
    for name, r in top.items():
        shorter = name[:LONGEST] if len(name) > LONGEST + 1 else name[:-1]
        above = nearest(shorter, top) if len(shorter) >= SHORTEST else None
        if above is None:
            rest_t, rest_c = rest_t - r.toxic, rest_c - r.clean
        else:
            own_t[above], own_c[above] = own_t[above] - r.toxic, own_c[above] - r.clean
    rest = min(math.log(max(rest_t, 1) / toxic) - math.log(max(rest_c, 1) / clean), -1e-3)
    model = Model({n: r.score for n, r in top.items()}, rest)
    # Karlin-Altschul: the mean of exp(lambda s) over clean words is 1.
    scores = np.array([*model.listed.values(), rest])
    weights = np.maximum(np.array([*own_c.values(), rest_c], float), 0.5)
    weights /= weights.sum()
    low, high = 1e-3, 10.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if float((weights * np.exp(np.minimum(middle * scores, 600))).sum()) > 1 else (middle, high)
    model.decay = low
    return model


def measure(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Damped segments, best passage and length of each training document."""
    model: Model = shared.value
    scores = Scores(model.listed, model.rest)
    for batch in batches:
        found = [segments_of(t or "", scores) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([n for n, _, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.list_(pa.float64())), pa.array([max((s[2] for s in x), default=0.0) for _, x, _ in found], pa.float64())], names=["toxic", "n", "damped", "passage"])


def calibrate(model: Model, sample: DataFrame, sizes: dict[int, int]) -> Model:
    """Fits K and the threshold on the bounded sample; classes count as often as they are labelled (``sizes``)."""
    shared = sample.sparkSession.sparkContext.broadcast(model)
    rows = sample.mapInArrow(lambda b: measure(b, shared), "toxic int, n long, damped array<double>, passage double").collect()
    # Gumbel: the mean of lambda S - ln n over clean documents is ln K plus Euler's constant.
    clean = [r for r in rows if not r.toxic and r.n]
    fitted = lambda best: max(math.exp(sum(model.decay * best(r) - math.log(r.n) for r in clean) / len(clean) - 0.5772156649) if clean else 0.0, 1e-6)
    model.scale, model.passage_scale = fitted(lambda r: max(r.damped, default=0.0)), fitted(lambda r: r.passage)
    x = np.array([model.surprise(r.damped, r.n) for r in rows])
    y = np.array([r.toxic for r in rows])
    weight = np.where(y == 1, sizes[1] / max((y == 1).sum(), 1), sizes[0] / max((y == 0).sum(), 1))
    order = np.argsort(x)
    x, y, weight = x[order], y[order], weight[order]
    # A cut before i calls i and later toxic: errors are toxic rows before it and clean rows from it on.
    missed = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, 0))])
    wrong = np.concatenate([[0], np.cumsum(np.where(y == 0, weight, 0))])
    errors = missed + wrong[-1] - wrong
    errors[1:-1] += np.where(x[1:] > x[:-1], 0, np.inf)  # rows that tie stay together
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    gaps = [((x[i - 1] if i else 0.0), (x[i] if i < len(x) else x[-1] + 1)) for i in best]
    low, high = max(gaps, key=lambda g: g[1] - g[0])
    model.threshold = max((low + high) / 2, 1e-3)
    return model


def grade(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    model: Model | None = shared.value
    scores = Scores(model.listed, model.rest) if model else None
    for batch in batches:
        score, passages = [], []
        for text in batch["text"].to_pylist():
            n, found, damped = segments_of(text or "", scores) if model else (0, [], [])
            x = model.surprise(damped, n) if model else 0.0
            score.append(x / (x + model.threshold) if model else 0.0)
            graded = ((a, b, s, model.passage_evalue(s, n)) for a, b, s in found)
            passages.append([{"start": a, "end": b, "score": s, "evalue": e} for a, b, s, e in graded if e <= PASSAGE_E])
        columns = [batch["doc_id"], score, [int(s >= 0.5) for s in score], passages]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> Model | None:
    """``docs``: ``doc_id, text``; ``labels``: ``doc_id, toxic``."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {0: 0, 1: 0} | {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    picked = [usable.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for c in (0, 1)]
    ids = written(picked[0].union(picked[1]), "ids")  # 2 x sample_rows rows at most
    sample = written(docs.join(F.broadcast(ids), "doc_id").select("text", "toxic").distinct(), "sample")  # copies count once
    model = learn(sample)
    return calibrate(model, sample, sizes) if model else None


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels, sample_rows))
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", passage)])
    found = rows.mapInArrow(lambda b: grade(b, shared, schema), SCORED)
    return written(found, "scores").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages")


def keep_clean(batches: Iterator[pa.RecordBatch], shared, text_col: str) -> Iterator[pa.RecordBatch]:
    model: Model | None = shared.value
    scores = Scores(model.listed, model.rest) if model else None
    for batch in batches:
        keep = []
        for text in batch[text_col].to_pylist():
            n, _, damped = segments_of(text or "", scores) if model else (0, [], [])
            keep.append(not model or model.surprise(damped, n) < model.threshold)
        yield batch.filter(pa.array(keep, pa.bool_()))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all their columns unchanged."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels, sample_rows))
    return docs.mapInArrow(lambda b: keep_clean(b, shared, text_col), docs.schema)
