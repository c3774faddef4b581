"""What reuse is compared with: asking everything, exact text hits, hits by similar wording."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismview.operators.engine import QueryResult, ReuseEngine
from prismview.operators.nearest import best_entries as best_entries
from prismview.plans.predicates import OVERLAP, Judgment, Predicate
from prismview.sources.answers import AnswerLog
from prismview.sources.tables import state_folder


class NoReasoner:
    """Sees no relation, so nothing but an exact text is ever reused."""

    def judge(self, p: Predicate, others: list[Predicate]) -> list:
        return [Judgment(OVERLAP, 0.0) for _ in others]


def exact_cache(corpus: DataFrame, oracle, **options) -> ReuseEngine:
    return ReuseEngine(corpus, oracle, NoReasoner(), audit=None, **options)


@dataclass
class ColdEngine:
    """Asks about every row of every query, once: answers are written, whatever is done with the result."""

    corpus: DataFrame
    oracle: object
    folder: str | None = None

    def __post_init__(self):
        self.log, self.position = AnswerLog(self.corpus.sparkSession, f"{self.folder or state_folder(self.corpus.sparkSession)}/answers"), 0

    def query(self, predicate: Predicate) -> QueryResult:
        answers, paid, _ = self.log.ask(self.oracle, predicate, self.corpus, self.position, "cold")
        self.position += 1
        return QueryResult(predicate, answers.select("row_id", F.col("answer").alias("reported")), "cold", {"cold": paid})


@dataclass
class SimilarCache:
    """Reuses the whole answer of the entry whose vector is nearest, if near enough; ``embed(text)`` gives unit vectors."""

    corpus: DataFrame
    oracle: object
    embed: object
    level: float = 0.9
    entries: list[tuple[list[float], QueryResult]] = field(default_factory=list)

    def __post_init__(self):
        self.cold = ColdEngine(self.corpus, self.oracle)

    def query(self, predicate: Predicate) -> QueryResult:
        v = self.embed(predicate.text)
        best, nearest = None, -1.0
        for u, result in self.entries:
            s = sum(a * b for a, b in zip(u, v, strict=True))
            if s > nearest:
                best, nearest = result, s
        if best is not None and nearest >= self.level:
            return QueryResult(predicate, best.rows, f"embed-hit@{nearest:.2f}", {})
        result = self.cold.query(predicate)
        self.entries.append((v, result))
        return result
