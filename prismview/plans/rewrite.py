"""Rewriting a predicate by cached views: which rows still have to be asked about.

Every view in use gets one bit; a row's bits say in which of the views it is reported.
The bits of all views come from one aggregation over the views' positive rows, and
the rules become one CASE over them:

* a row inside a *backward* view (q implies p) is assumed positive,
* a row outside a *forward* view (p implies q) is pruned,
* a row inside a *disjoint* view is pruned,
* a row with evidence both ways, and any other row, is a candidate.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismview.plans.predicates import BACKWARD, DISJOINT, EQUIV, FORWARD, Judgment

CANDIDATE, ASSUMED, PRUNED = "candidate", "assumed", "pruned"


@dataclass(frozen=True)
class RewriteConfig:
    #: Least confidence per relation (fixed values).
    levels: dict[str, float] = field(default_factory=lambda: {EQUIV: 0.8, FORWARD: 0.8, BACKWARD: 0.9, DISJOINT: 0.9})
    superset: bool = True
    union: bool = True
    disjoint: bool = True
    #: Views per rule.
    most_views: int = 8
    #: Recall that rewrites may cost, as a share of 1 - target; None: no budget.
    slack_share: float | None = None


@dataclass(frozen=True)
class ViewUse:
    """A cached view in one role; ``rule``: forward, backward or disjoint."""

    rule: str
    view_id: int
    pid: str
    confidence: float

    @property
    def stratum(self) -> str:
        return f"{self.rule}:{self.view_id}"


@dataclass(frozen=True)
class Plan:
    """``rows``: ``row_id, role, stratum``; strata in claim order."""

    rows: DataFrame
    uses: tuple[ViewUse, ...]
    predicted_slack: float = 0.0

    def with_rows(self, rows: DataFrame) -> Plan:
        return replace(self, rows=rows)


def choose_views(judged: list[tuple[int, str, Judgment]], config: RewriteConfig) -> list[ViewUse]:
    """Accepted uses of judged views, each rule's best first; ``judged``: view id, pid, judgment."""
    wanted = {FORWARD: config.superset, BACKWARD: config.union, DISJOINT: config.disjoint}
    out: list[ViewUse] = []
    for rule in (BACKWARD, FORWARD, DISJOINT):
        fit = []
        for view_id, pid, j in judged:
            serves = j.relation == rule or (j.relation == EQUIV and rule != DISJOINT)
            if wanted[rule] and serves and j.confidence >= config.levels[j.relation]:
                fit.append(ViewUse(rule, view_id, pid, j.confidence))
        out += sorted(fit, key=lambda u: (-u.confidence, u.pid))[: config.most_views]
    return out


def view_bits(uses: list[ViewUse], view_rows: DataFrame) -> DataFrame:
    """``row_id, bits`` of rows that some view in use reports. ``view_rows``: ``view_id, row_id`` of reported rows."""
    bit = F.coalesce(*[F.when(F.col("view_id") == v, F.lit(sum(1 << i for i, u in enumerate(uses) if u.view_id == v))) for v in sorted({u.view_id for u in uses})])
    inside = view_rows.filter(F.col("view_id").isin(sorted({u.view_id for u in uses})))
    return inside.select("row_id", bit.cast("long").alias("bit")).groupBy("row_id").agg(F.bit_or("bit").alias("bits"))


def stratum_of(uses: list[ViewUse], bits: Column, demote: bool = True) -> Column:
    """First rule that claims a row; null for candidates."""
    has = lambda i: bits.bitwiseAND(F.lit(1 << i).cast("long")) != 0
    inside = [has(i) for i, u in enumerate(uses) if u.rule == BACKWARD]
    against = [~has(i) if u.rule == FORWARD else has(i) for i, u in enumerate(uses) if u.rule != BACKWARD]
    claim = None
    if demote and inside and against:
        some_in, some_out = inside[0], against[0]
        for c in inside[1:]:
            some_in = some_in | c
        for c in against[1:]:
            some_out = some_out | c
        claim = F.when(some_in & some_out, F.lit(None).cast("string"))
    for i, u in enumerate(uses):
        holds = ~has(i) if u.rule == FORWARD else has(i)
        claim = claim.when(holds, u.stratum) if claim is not None else F.when(holds, u.stratum)
    return claim if claim is not None else F.lit(None).cast("string")


def role_of(stratum: Column) -> Column:
    return F.when(stratum.isNull(), CANDIDATE).when(stratum.startswith(f"{BACKWARD}:"), ASSUMED).otherwise(PRUNED)


def build_plan(corpus: DataFrame, uses: list[ViewUse], view_rows: DataFrame | None, predicted_slack: float = 0.0, keep: tuple[str, ...] = ()) -> Plan:
    """``corpus``: ``row_id``; ``keep`` names columns of it that stay. Uses are in claim order: backward, forward, disjoint."""
    rows = corpus.select("row_id", *keep)
    if not uses:
        return Plan(rows.select("row_id", *keep, F.lit(CANDIDATE).alias("role"), F.lit(None).cast("string").alias("stratum")), ())
    bits = rows.join(view_bits(uses, view_rows), "row_id", "left").withColumn("bits", F.coalesce("bits", F.lit(0)).cast("long"))
    staged = bits.select("row_id", *keep, stratum_of(uses, F.col("bits")).alias("stratum"))
    return Plan(staged.select("row_id", *keep, role_of(F.col("stratum")).alias("role"), "stratum"), tuple(uses), predicted_slack)


def stratum_sizes(plan: Plan) -> dict[str, int]:
    """Sizes of the strata that are not empty, in claim order (candidates under "")."""
    counted = {r[0] or "": r[1] for r in plan.rows.groupBy("stratum").count().collect()}  # a row a view in use at most
    order = [u.stratum for u in plan.uses]
    return {s: counted[s] for s in sorted(counted, key=lambda s: order.index(s) if s in order else len(order) + len(s))}


def reported(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """``row_id, reported``: asked rows by their answer, assumed rows true, pruned rows false."""
    return plan.join(answers.select("row_id", "answer"), "row_id", "left").select("row_id", F.coalesce("answer", F.col("role") == ASSUMED).alias("reported"))
