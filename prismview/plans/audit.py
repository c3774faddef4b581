"""Certificates for rewritten answers: samples of the rows that nobody asked about.

Assumed strata are sampled one by one, pruned strata as one pool. Exact bounds on the
positives that remain unseen give a lower bound on recall and on precision; strata
are read fully, in an order fixed before sampling, until the recall bound reaches the
target. The plan is written before the first sample is drawn, and every sample has
the query and the phase in its key, so it is independent of the plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismview.functions import bounds
from prismview.functions.sampling import sample_pool, sample_strata
from prismview.plans.predicates import BACKWARD
from prismview.plans.rewrite import ASSUMED, CANDIDATE, PRUNED


@dataclass(frozen=True)
class AuditConfig:
    """Defaults are fixed values."""

    alpha: float = 0.05
    target_recall: float | None = 0.9
    target_precision: float | None = 0.9
    mode: str = "adaptive"  # or fraction, fixed
    most_sample: int = 4000
    fraction: float = 0.1
    safety: float = 0.8
    least_sample: int = 20
    read_fully: int = 10
    escalate: bool = True
    order: str = "size-desc"  # or size-asc, conf-asc
    certify: str = "joint"  # or recall, recall-trust
    pooling: str = "pooled"  # or separate: a sample and a bound for each pruned stratum
    split: str = "sqrt"  # or proportional: how separate samples share the allowance


@dataclass
class Stratum:
    name: str
    rule: str
    size: int
    confidence: float = 0.0
    sampled: int = 0
    positives: int = 0
    #: All its rows have been asked about.
    read: bool = False
    #: The bound of a stratum with a sample of its own.
    alpha: float = 0.0


@dataclass
class Audit:
    recall_bound: float | None
    precision_bound: float | None
    strata: list[Stratum]
    found: int
    extra: int
    answers: list[DataFrame] = field(default_factory=list)
    calls: dict[str, int] = field(default_factory=dict)

    def corrections(self, plan: DataFrame) -> DataFrame:
        """``row_id, stratum, answer`` of audited rows whose answer is not what the plan took for granted. ``plan``: ``row_id, role, stratum``."""
        told = self.answers[0]
        for more in self.answers[1:]:
            told = told.unionByName(more)
        taken = plan.filter(F.col("role") != CANDIDATE).select("row_id", "stratum", (F.col("role") == ASSUMED).alias("taken"))
        return taken.join(told.select("row_id", "answer"), "row_id").filter("answer <> taken").select("row_id", "stratum", "answer")


def plain_size(config: AuditConfig, size: int) -> int:
    if size <= config.read_fully:
        return size
    wanted = max(config.least_sample, math.ceil(config.fraction * size)) if config.mode == "fraction" else config.most_sample
    return min(size, wanted, config.most_sample)


def assumed_size(config: AuditConfig, size: int, alpha: float) -> int:
    """Enough that a stratum under the target precision would show a miss; independent of its size."""
    p = config.target_precision
    if config.mode != "adaptive":
        return plain_size(config, size)
    if size <= config.read_fully or p is None or p >= 1:
        return size
    return min(size, config.most_sample, max(config.least_sample, math.ceil(math.log(max(alpha, 1e-12)) / math.log(p))))


def pool_size(config: AuditConfig, size: int, allowance: float, alpha: float) -> int:
    """Enough that a clean sample certifies at most ``allowance`` missed rows."""
    if size <= config.read_fully or allowance < 1:
        return size
    wanted = config.least_sample if allowance >= size else max(config.least_sample, math.ceil(math.log(alpha) / math.log1p(-allowance / size)))
    return min(size, config.most_sample, wanted)


def miss_allowance(config: AuditConfig, known: int) -> float:
    t = config.target_recall
    return known * (1 - t) / max(t, 1e-9) * config.safety


def escalation_order(strata: list[Stratum], order: str) -> list[Stratum]:
    place = {s.name: i for i, s in enumerate(strata)}
    keys = {"size-desc": lambda s: (-s.size, place[s.name]), "size-asc": lambda s: (s.size, place[s.name]), "conf-asc": lambda s: (s.confidence, -s.size, place[s.name])}
    return sorted(strata, key=keys[order])


def split_allowance(sizes: dict[str, int], allowance: float, alpha: float, config: AuditConfig) -> dict[str, float]:
    """Shares of the allowance by the square root (or size) of strata; those read fully give theirs back."""
    open_, out = dict(sizes), dict.fromkeys(sizes, 0.0)
    while open_:
        weight = {k: math.sqrt(n) if config.split == "sqrt" else n for k, n in open_.items()}
        share = {k: allowance * w / sum(weight.values()) for k, w in weight.items()}
        full = [k for k, n in open_.items() if pool_size(config, n, share[k], alpha) >= n]
        if not full:
            return out | share
        for k in full:
            del open_[k]
    return out


def run_audit(rows: DataFrame, sizes: dict[str, int], confidence: dict[str, float], found: int, ask: Callable[[DataFrame, str], DataFrame], config: AuditConfig, seed: int, query: int) -> Audit:
    """``rows``: the written plan; ``sizes``: of strata in claim order; ``found``: positives among the candidates.

    ``ask(rows, tag)`` pays for answers and returns them as a written table.
    """
    strata = [Stratum(s, s.split(":")[0], n, confidence.get(s, 0.0)) for s, n in sizes.items() if s]
    assumed, pruned = [s for s in strata if s.rule == BACKWARD], [s for s in strata if s.rule != BACKWARD]
    result = Audit(None, None, strata, found, 0)
    checked = config.certify != "recall-trust"
    pools = int(bool(assumed) and checked) + int(bool(pruned))
    alpha_pool = config.alpha / max(1, pools)
    unverified = 0 if checked else sum(s.size for s in assumed)

    def paid(wanted: DataFrame, tag: str) -> DataFrame:
        answers = ask(wanted, tag)
        result.answers.append(answers)
        return answers

    def by_stratum(wanted: DataFrame, tag: str) -> dict[str, tuple[int, int]]:
        """Rows and positives of each stratum among the rows asked about."""
        answers = paid(wanted, tag)
        counted = rows.select("row_id", "stratum").join(answers, "row_id").groupBy("stratum").agg(F.count("*"), F.count_if("answer"), F.count_if("paid")).collect()
        result.calls[tag] = result.calls.get(tag, 0) + sum(r[3] for r in counted)
        return {r[0]: (r[1], r[2]) for r in counted}

    def rest_of(names: list[str]) -> DataFrame:
        """Rows of strata that nobody has asked about yet."""
        wanted = rows.filter(F.col("stratum").isin(names)).select("row_id", "stratum")
        for answers in result.answers:
            wanted = wanted.join(answers.select("row_id"), "row_id", "left_anti")
        return wanted

    if assumed and checked:
        alpha_each = alpha_pool / len(assumed)
        wanted = {s.name: assumed_size(config, s.size, alpha_each) for s in assumed}
        whole, part = [n for n, m in wanted.items() if m >= sizes[n]], {n: m for n, m in wanted.items() if m < sizes[n]}
        pool = rows.filter(F.col("role") == ASSUMED).select("row_id", "stratum")
        for names, tag, drawn in ((whole, "fallback", lambda: pool.filter(F.col("stratum").isin(whole))), (part, "audit", lambda: sample_strata(pool, part, seed, query, "assumed"))):
            if names:
                seen = by_stratum(drawn(), tag)
                for s in assumed:
                    if s.name in names:
                        s.sampled, s.positives = seen.get(s.name, (0, 0))
                        s.read = tag == "fallback"
                        result.found += s.positives
        if config.certify == "joint" and config.target_precision is not None:
            bad = [s for s in assumed if not s.read and s.sampled >= 5 and s.positives < config.target_precision * s.sampled]
            if bad:
                seen = by_stratum(rest_of([s.name for s in bad]), "precision-escalate")
                for s in bad:
                    more = seen.get(s.name, (0, 0))[1]
                    s.read, s.positives, s.sampled = True, s.positives + more, s.size
                    result.found += more
        for s in assumed:
            if not s.read:
                result.extra += max(0, bounds.lower_bound(s.size, s.sampled, s.positives, alpha_each) - s.positives)
                unverified += s.size - s.sampled

    missed = 0
    if pruned:
        alpha_level = alpha_pool / (len(pruned) + 1)
        pool = rows.filter(F.col("role") == PRUNED).select("row_id", "stratum")
        total = sum(s.size for s in pruned)
        allowance = miss_allowance(config, result.found + result.extra) if config.target_recall is not None else 0.0
        adaptive = config.mode == "adaptive" and config.target_recall is not None
        if config.pooling == "separate":
            alpha_each = alpha_pool / len(pruned)
            share = split_allowance({s.name: s.size for s in pruned}, allowance, alpha_each, config)
            wanted = {s.name: pool_size(config, s.size, share[s.name], alpha_each) if adaptive else plain_size(config, s.size) for s in pruned}
            whole, part = [n for n, m in wanted.items() if m >= sizes[n]], {n: m for n, m in wanted.items() if m < sizes[n]}
            seen = by_stratum(pool.filter(F.col("stratum").isin(whole)), "fallback") if whole else {}
            seen |= by_stratum(sample_strata(pool, part, seed, query, "pruned"), "audit") if part else {}
        else:
            m = pool_size(config, total, allowance, alpha_level) if adaptive else plain_size(config, total)
            whole = [s.name for s in pruned] if m >= total else []
            seen = by_stratum(pool if m >= total else sample_pool(pool, m, seed, query, "pruned"), "fallback" if m >= total else "audit")
        for s in pruned:
            s.sampled, s.positives = seen.get(s.name, (0, 0))
            s.read = s.name in whole
            s.alpha = alpha_pool / len(pruned)
            result.found += s.positives

        def still_missed() -> int:
            active = [s for s in pruned if not s.read]
            if config.pooling == "separate":
                return sum(bounds.upper_bound(s.size, s.sampled, s.positives, s.alpha) - s.positives for s in active)
            n, m, k = (sum(getattr(s, a) for s in active) for a in ("size", "sampled", "positives"))
            return bounds.upper_bound(n, m, k, alpha_level) - k if active else 0

        missed = still_missed()
        while config.escalate and config.target_recall is not None and bounds.recall_bound(result.found, result.extra, missed) < config.target_recall:
            active = [s for s in pruned if not s.read]
            if not active:
                break
            if config.pooling == "separate":
                worst = max(active, key=lambda s: (bounds.upper_bound(s.size, s.sampled, s.positives, s.alpha) - s.positives, s.size))
            else:
                worst = next(s for s in escalation_order(pruned, config.order) if not s.read)
            more = by_stratum(rest_of([worst.name]), "escalate").get(worst.name, (0, 0))[1]
            worst.read, worst.positives, worst.sampled = True, worst.positives + more, worst.size
            result.found += more
            missed = still_missed()
    result.recall_bound = bounds.recall_bound(result.found, result.extra, missed)
    if config.certify == "joint":
        result.precision_bound = bounds.precision_bound(result.found, result.extra, unverified)
    return result




__all__ = ["CANDIDATE", "Audit", "AuditConfig", "Stratum", "assumed_size", "escalation_order", "miss_allowance", "plain_size", "pool_size", "run_audit", "split_allowance"]
