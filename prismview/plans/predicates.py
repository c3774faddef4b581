"""Predicates over labelled rows, and the relations between them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

EQUIV, FORWARD, BACKWARD, DISJOINT, OVERLAP = RELATIONS = ("equiv", "forward", "backward", "disjoint", "overlap")


@dataclass(frozen=True)
class Predicate:
    """A question about a row, and the labels of rows for which it holds (empty if only an oracle knows)."""

    text: str
    labels: frozenset[str] = field(default_factory=frozenset)
    name: str = ""

    @property
    def pid(self) -> str:
        return hashlib.sha1(self.text.encode()).hexdigest()[:12]

    @property
    def key(self) -> str:
        """What exact lookup goes by."""
        return " ".join(self.text.lower().translate(str.maketrans(".,", "  ")).split())


@dataclass(frozen=True)
class Judgment:
    relation: str
    confidence: float


def relation_of_labels(p: Column, q: Column) -> Column:
    """Relation of two arrays of distinct labels. An empty set is contained in every other, so it is never disjoint."""
    p_in_q, q_in_p = F.size(F.array_except(p, q)) == 0, F.size(F.array_except(q, p)) == 0
    return (
        F.when(p_in_q & q_in_p, EQUIV).when(p_in_q, FORWARD).when(q_in_p, BACKWARD).when(~F.arrays_overlap(p, q), DISJOINT).otherwise(OVERLAP)
    )


def relation_of_counts(n_p: Column, n_q: Column, n_both: Column, slack: float = 0.02) -> Column:
    """Relation measured on extensions of n_p and n_q rows that share n_both, up to a slack."""
    out_p = F.coalesce(F.try_divide(n_p - n_both, n_p), F.lit(0.0))
    out_q = F.coalesce(F.try_divide(n_q - n_both, n_q), F.lit(0.0))
    shared = F.coalesce(F.try_divide(n_both, F.least(n_p, n_q)), F.lit(1.0))
    return (
        F.when(((n_p == 0) & (n_q == 0)) | ((out_p <= slack) & (out_q <= slack)), EQUIV)
        .when(out_p <= slack, FORWARD)
        .when(out_q <= slack, BACKWARD)
        .when((n_p > 0) & (n_q > 0) & (shared <= slack), DISJOINT)
        .otherwise(OVERLAP)
    )


def relation_of_sets(p: frozenset[str], q: frozenset[str]) -> str:
    """The same for two predicates at hand on the driver."""
    if p <= q:
        return EQUIV if q <= p else FORWARD
    if q <= p:
        return BACKWARD
    return OVERLAP if p & q else DISJOINT


def threshold_relation(c_f: Column, e_f: Column, c_b: Column, e_b: Column, level: float = 0.7) -> Column:
    """Relation and confidence of contradiction and entailment scores in both directions."""
    both = (e_f >= level) & (e_b >= level)
    against = F.greatest(c_f, c_b)
    name = F.when(both, EQUIV).when(e_f >= level, FORWARD).when(e_b >= level, BACKWARD).when(against >= level, DISJOINT).otherwise(OVERLAP)
    sure = F.when(both, F.least(e_f, e_b)).when(e_f >= level, e_f).when(e_b >= level, e_b).when(against >= level, against).otherwise(1 - F.greatest(e_f, e_b, c_f, c_b))
    return F.struct(name.alias("relation"), sure.alias("confidence"))
