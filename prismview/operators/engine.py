"""The reuse engine: exact hit, judge, plan, ask, audit, publish."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from prismview.operators.store import View, ViewStore
from prismview.plans.audit import Audit, AuditConfig, run_audit
from prismview.plans.predicates import FORWARD, Predicate
from prismview.plans.rewrite import ASSUMED, CANDIDATE, RewriteConfig, build_plan, choose_views
from prismview.plans import slack as slacks
from prismview.plans.slack import SlackModel, admit
from prismview.sources.answers import AnswerLog
from prismview.sources.tables import state_folder


@dataclass
class QueryResult:
    """``rows``: ``row_id, reported``. Bounds are None where the answer is exact."""

    predicate: Predicate
    rows: DataFrame
    reuse: str  # exact-hit, rewrite or cold
    calls: dict[str, int]
    recall_bound: float | None = None
    precision_bound: float | None = None
    used: tuple[str, ...] = ()
    seconds: float = 0.0
    seconds_asking: float = 0.0

    @property
    def n_calls(self) -> int:
        return sum(self.calls.values())


@dataclass
class ReuseEngine:
    """Answers predicates over ``corpus`` (``row_id``, plus what the oracle wants), paying as few oracle calls as the certificate allows.

    ``judge(p, views)`` returns a judgment for each view; ``audit=None`` publishes
    rewrites without a certificate; ``proxy`` may drop candidates before they are asked.

    Views, answers and what audits taught live in tables under ``folder``: an engine over a folder
    that holds some goes on from there. A query that broke off is asked again under its old number: it plans
    and samples as before and pays only for answers that were not written yet.
    """

    corpus: DataFrame
    oracle: object
    judge: object
    rewrite: RewriteConfig = field(default_factory=RewriteConfig)
    audit: AuditConfig | None = field(default_factory=AuditConfig)
    proxy: object | None = None
    slack: SlackModel | None = None
    seed: int = 0
    folder: str | None = None

    def __post_init__(self):
        spark = self.corpus.sparkSession
        self.folder = self.folder or state_folder(spark)
        self.spark, self.store, self.log = spark, ViewStore(spark, f"{self.folder}/views"), AnswerLog(spark, f"{self.folder}/answers")
        self.query_index = 1 + max((v.query_index for v in self.store.views), default=-1)
        self.n_rows, self.view_counts = None, {}
        self.needs = tuple(c for c in getattr(self.oracle, "needs", ()) if c in self.corpus.columns)
        if self.slack is not None:
            for notes in self.store.notes:
                for o in notes:
                    self.slack.observe(slacks.Observation(*o[:5]))

    def query(self, predicate: Predicate) -> QueryResult:
        began, index = time.time(), self.query_index
        self.query_index += 1
        hit = self.store.exact(predicate, self.oracle.version)
        if hit:
            return QueryResult(predicate, self.store.mask(self.corpus, hit), "exact-hit", {}, hit.recall_bound, hit.precision_bound, (hit.predicate.pid,), time.time() - began)
        self.n_rows = self.n_rows or self.corpus.count()
        views = self.store.candidates(self.oracle.version)
        judged = [(v.view_id, v.predicate.pid, j) for v, j in zip(views, self.judge.judge(predicate, [v.predicate for v in views]), strict=True)] if views else []
        uses = choose_views(judged, self.rewrite)
        uses, predicted = self.within_budget(uses)
        reported_rows = self.store.rows([u.view_id for u in uses]).filter("reported").select("view_id", "row_id") if uses else None
        plan = build_plan(self.corpus, uses, reported_rows, predicted, self.needs)
        asking = [0.0]
        asked: dict[str, int] = {}
        counts: dict[str, tuple[int, int]] = {}  # of the latest ask with a tag
        sizes: dict[str, int] = {}
        again = self.log.known(self.oracle.version, predicate.pid) is not None  # rows of one query are asked about once

        def ask(rows: DataFrame, tag: str) -> DataFrame:
            at = time.time()
            answers, paid, yes = self.log.ask(self.oracle, predicate, rows, index, tag, again)
            counts[tag] = paid, yes
            asking[0] += time.time() - at
            return answers

        pilot = None
        if uses:  # written before any sample is drawn
            plan, sizes = self.written(plan, f"query={index}")
        answers = []
        if self.proxy is not None:
            plan, pilot = self.proxy.cut(plan, predicate, ask, self.seed, index)
            if pilot is not None:
                plan, sizes = self.written(plan, f"cut={index}")  # the model is applied once, before any audit
                answers.append(pilot)
        candidates = plan.rows.filter(F.col("role") == CANDIDATE)
        if pilot is not None:
            candidates = candidates.join(pilot.select("row_id"), "row_id", "left_anti")
        answers.append(ask(candidates, "candidates"))
        asked |= {tag: paid for tag, (paid, _) in counts.items()}
        found = sum(yes for _, yes in counts.values())
        recall = precision = None
        notes: list = []
        if self.audit is not None and any(sizes):
            confidence = {u.stratum: u.confidence for u in uses}
            audit = run_audit(plan.rows, {s: n for s, n in sizes.items() if s}, confidence, found, ask, self.audit, self.seed, index)
            recall, precision = audit.recall_bound, audit.precision_bound
            answers += audit.answers
            for tag, n in audit.calls.items():
                asked[tag] = asked.get(tag, 0) + n
            notes = self.learn(audit, uses)
        known = answers[0]
        for more in answers[1:]:
            known = known.unionByName(more)
        # A row is asked at most once; the pilot may overlap a later sample only through the plan's strata.
        known = known.groupBy("row_id").agg(F.bool_or("answer").alias("answer"))
        # A view holds what is reported or verified: the answers, and assumed rows that nobody asked about.
        final = known.select("row_id", F.col("answer").alias("reported"), F.lit(True).alias("verified"))
        if any(u.rule == "backward" for u in uses):
            assumed = plan.rows.filter(F.col("role") == ASSUMED).select("row_id").join(known.select("row_id"), "row_id", "left_anti")
            final = final.union(assumed.select("row_id", F.lit(True), F.lit(False)))
        kind = "rewrite" if uses else "cold"
        view = self.store.add(predicate, final, self.oracle.version, index, recall, precision, [u.pid for u in uses], time.time() - began, notes)
        return QueryResult(predicate, self.store.mask(self.corpus, view), kind, asked, recall, precision, tuple(u.pid for u in uses), time.time() - began, asking[0])

    def written(self, plan, name: str) -> tuple:
        """The plan as a table, and the sizes of its strata that are not empty, in claim order, counted as they are written."""
        path, counted = f"{self.folder}/plans/{name}", Observation()
        names = [u.stratum for u in plan.uses] + [f"proxy:band{b}" for b in range(getattr(self.proxy, "bands", 0))]
        plan.rows.observe(counted, F.count_if(F.col("stratum").isNull()).alias("s"), *[F.count_if(F.col("stratum") == n).alias(f"s{i}") for i, n in enumerate(names)]).write.mode("overwrite").parquet(path)
        sizes = {"": counted.get["s"]} | {n: counted.get[f"s{i}"] for i, n in enumerate(names)}
        return plan.with_rows(self.spark.read.schema(plan.rows.schema).parquet(path)), {n: k for n, k in sizes.items() if k}

    @classmethod
    def resume(cls, corpus: DataFrame, oracle, judge, folder: str, **options) -> ReuseEngine:
        """The engine whose tables are in ``folder``."""
        return cls(corpus, oracle, judge, folder=folder, **options)

    def slack_features(self) -> DataFrame:
        """What was known of each audited stratum when it was planned, and what it cost: ``query_index, kind, source, fraction, slack, weight, confidence, found``."""
        rows = [(v.query_index, *o) for v, notes in zip(self.store.views, self.store.notes, strict=True) for o in notes]
        return self.spark.createDataFrame(rows, "query_index int, kind string, source string, fraction double, slack double, weight double, confidence double, found long")

    def within_budget(self, uses: list) -> tuple[list, float]:
        """Leaves out forward and disjoint views whose predicted cost in recall exceeds the budget."""
        if self.slack is None or self.rewrite.slack_share is None or self.audit is None or self.audit.target_recall is None:
            return uses, 0.0
        limited = [u for u in uses if u.rule != "backward"]
        if not limited:
            return uses, 0.0
        missing = sorted({u.view_id for u in limited} - self.view_counts.keys())
        if missing:
            counts = self.store.rows(missing).filter("reported").groupBy("view_id").count().collect()
            self.view_counts |= dict.fromkeys(missing, 0) | {r[0]: r[1] for r in counts}
        pruned = {u.stratum: self.n_rows - self.view_counts[u.view_id] if u.rule == FORWARD else self.view_counts[u.view_id] for u in limited}
        cost = {u.stratum: self.slack.predict(u.rule, u.pid, pruned[u.stratum] / max(self.n_rows, 1)) for u in limited}
        kept = set(admit([(u.stratum, pruned[u.stratum], cost[u.stratum]) for u in limited], self.rewrite.slack_share * (1 - self.audit.target_recall)))
        return [u for u in uses if u.rule == "backward" or u.stratum in kept], sum(cost[s] for s in kept)

    def learn(self, audit: Audit, uses: list) -> list[tuple]:
        """What each pruned stratum turned out to cost; used by later queries only."""
        source, positives = {u.stratum: u.pid for u in uses}, max(audit.found + audit.extra, 1)
        notes = []
        for s in audit.strata:
            if s.rule != "backward" and s.sampled:
                estimate = s.positives if s.read else s.positives * s.size / s.sampled
                notes.append((s.rule, source.get(s.name, ""), s.size / max(self.n_rows, 1), estimate / positives, float(s.size if s.read else s.sampled), float(s.confidence), audit.found))
                if self.slack is not None:
                    self.slack.observe(slacks.Observation(*notes[-1][:5]))
        return notes


@dataclass
class FilterService:
    """A host's entry point: ``filter(text)`` with a persistent store and one confidence level for all relations."""

    engine: ReuseEngine
    level: float = 0.5

    def __post_init__(self):
        self.engine.rewrite = replace(self.engine.rewrite, levels=dict.fromkeys(self.engine.rewrite.levels, self.level))
        self.results: list[QueryResult] = []

    def filter(self, text: str) -> QueryResult:
        self.results.append(self.engine.query(Predicate(text)))
        return self.results[-1]

    def statistics(self) -> dict[str, float]:
        calls = sum(r.n_calls for r in self.results)
        cold = len(self.results) * (self.engine.n_rows or 0)
        return {"queries": len(self.results), "calls": calls, "cold_calls": cold, "reduction": cold / calls if calls else float("inf")}


def sem_filter(df: DataFrame, text: str, service: FilterService) -> tuple[DataFrame, QueryResult]:
    """The rows of ``df`` (with ``row_id``) that the question holds for, and the certificate."""
    result = service.filter(text)
    return df.join(result.rows.filter("reported").select("row_id"), "row_id", "left_semi"), result


__all__ = ["FilterService", "QueryResult", "ReuseEngine", "View", "sem_filter"]
