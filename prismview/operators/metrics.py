"""Scores and analyses as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(empty))


def precision_recall(rows: DataFrame, *groups: str) -> DataFrame:
    """``rows``: booleans ``reported`` and ``truth``. Empty denominators give 1, an empty F1 gives 0."""
    counts = rows.groupBy(*groups).agg(F.count_if(F.col("reported") & F.col("truth")).alias("tp"), F.count_if("reported").alias("n_reported"), F.count_if("truth").alias("n_true"))
    scored = counts.withColumn("precision", _ratio(F.col("tp"), F.col("n_reported"))).withColumn("recall", _ratio(F.col("tp"), F.col("n_true")))
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def summarize(queries: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Per method: calls, macro precision and recall, certificates and how many of them reality fell short of."""
    short = lambda bound, value: F.count_if(F.col(bound) > F.col(value) + tolerance)
    return queries.groupBy("method").agg(
        F.count("*").alias("queries"),
        F.sum("calls").alias("calls"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.count("recall_bound").alias("certificates"),
        short("recall_bound", "recall").alias("recall_violations"),
        short("precision_bound", "precision").alias("precision_violations"),
        F.avg("recall_bound").alias("mean_recall_bound"),
    )


def confusion(judged: DataFrame) -> DataFrame:
    """``relation, predicted, n`` of judged pairs."""
    return judged.groupBy("relation", "predicted").agg(F.count("*").alias("n"))


def relation_scores(judged: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each relation as predicted."""
    sides = judged.select(F.explode(F.array_distinct(F.array("relation", "predicted"))).alias("of"), "relation", "predicted")
    return precision_recall(sides.select("of", (F.col("predicted") == F.col("of")).alias("reported"), (F.col("relation") == F.col("of")).alias("truth")), "of")


def reliability(judged: DataFrame, bins: int = 10) -> DataFrame:
    """Accuracy and mean confidence in equal bins, the last one closed. ``judged``: ``confidence, correct``."""
    slot = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return judged.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration_error(judged: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error, one row."""
    r = reliability(judged, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def agreement(answers: DataFrame) -> DataFrame:
    """Agreement, Cohen's kappa and Jaccard of positives of each pair of models. ``answers``: ``model, text, row_id, answer``.

    Models are few; the join is on the cell.
    """
    a, b = answers.alias("a"), answers.alias("b")
    pairs = a.join(b, (F.col("a.text") == F.col("b.text")) & (F.col("a.row_id") == F.col("b.row_id")) & (F.col("a.model") < F.col("b.model")))
    x, y = F.col("a.answer"), F.col("b.answer")
    counts = pairs.groupBy(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(
        F.count("*").alias("n"), F.count_if(x == y).alias("same"), F.count_if(x).alias("n_a"), F.count_if(y).alias("n_b"), F.count_if(x & y).alias("both"), F.count_if(x | y).alias("either")
    )
    observed = F.col("same") / F.col("n")
    chance = (F.col("n_a") * F.col("n_b") + (F.col("n") - F.col("n_a")) * (F.col("n") - F.col("n_b"))) / (F.col("n").cast("double") * F.col("n"))
    return counts.select("model_a", "model_b", "n", observed.alias("agreement"), _ratio(observed - chance, 1 - chance).alias("kappa"), _ratio(F.col("both"), F.col("either")).alias("jaccard"))


def predecessors(queries: DataFrame) -> DataFrame:
    """For each query, which kinds of relation some earlier query has to it. ``queries``: ``position, key, labels`` of a stated workload."""
    from prismview.plans.predicates import relation_of_labels

    now, past = queries.alias("now"), queries.alias("past")
    pairs = now.join(past, F.col("past.position") < F.col("now.position"), "left")
    relation = relation_of_labels(F.col("now.labels"), F.col("past.labels"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return pairs.groupBy(F.col("now.position").alias("position")).agg(
        some(F.col("past.key") == F.col("now.key")).alias("repeat"),
        some((relation == "equiv") & (F.col("past.key") != F.col("now.key"))).alias("equiv"),
        some(relation.isin("forward", "backward")).alias("containment"),
        some(relation == "disjoint").alias("disjoint"),
    )


def implication_slack(declared: DataFrame, extensions: DataFrame) -> DataFrame:
    """How far declared implications hold. ``declared``: ``a, b``; ``extensions``: ``name, row_id``. Empty or unknown sides are left out."""
    rows = extensions.distinct()
    n = rows.groupBy("name").agg(F.count("*").alias("n"))
    both = declared.join(rows.select(F.col("name").alias("a"), "row_id"), "a").join(rows.select(F.col("name").alias("b"), "row_id"), ["b", "row_id"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    sized = declared.join(n.select(F.col("name").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("name").alias("b"), F.col("n").alias("n_b")), "b").join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return sized.select("a", "b", (1 - F.col("both") / F.col("n_a")).alias("slack"), (1 - F.col("both") / F.col("n_b")).alias("reverse_slack"), (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))


def slack_summary(slacks: DataFrame, *groups: str) -> DataFrame:
    """Exact implications, median, mean and largest slack, how many stay within 0.10."""
    return slacks.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.col("slack") == 0).alias("exact"), F.percentile("slack", 0.5).alias("median"), F.avg("slack").alias("mean"), F.max("slack").alias("largest"), F.count_if(F.col("slack") <= 0.10).alias("near"))


def paired_ratios(runs: DataFrame, arm: str, base: str, value: str) -> DataFrame:
    """Quartiles of arm / base over pairs of (rep, query), without pairs of which either side was retried. ``runs``: ``rep, query, arm, retries`` and the value."""
    pair = Window.partitionBy("rep", "query")
    clean = runs.withColumn("worst", F.max("retries").over(pair)).filter("worst = 0")
    sides = clean.groupBy("rep", "query").pivot("arm", [arm, base]).agg(F.first(value))
    ratio = F.try_divide(F.col(arm).cast("double"), F.col(base))
    return sides.groupBy("rep").agg(F.count(ratio).alias("pairs"), F.percentile(ratio, 0.25).alias("q1"), F.percentile(ratio, 0.5).alias("median"), F.percentile(ratio, 0.75).alias("q3"), F.try_divide(F.sum(arm).cast("double"), F.sum(base)).alias("of_sums"))


def shortfall(certified: DataFrame) -> DataFrame:
    """Rows missing to meet a bound. ``certified``: ``tp, n_true, n_reported, recall_bound, precision_bound``."""
    lack = lambda bound, n: F.greatest(F.ceil(F.round(F.col(bound) * F.col(n), 9)) - F.col("tp"), F.lit(0))
    return certified.withColumn("recall_short", lack("recall_bound", "n_true")).withColumn("precision_short", lack("precision_bound", "n_reported"))


def shortfall_draws(one: DataFrame, other: DataFrame) -> DataFrame:
    """Certificates that fall short in one draw of the samples, in another, and in both. Each: ``position`` and the columns of ``shortfall``.

    ``exact`` counts certificates of 1, which leave nothing unseen and so cannot fall short by chance.
    """
    fails = lambda df, name: shortfall(df).select("position", ((F.col("recall_short") > 0) | (F.col("precision_short") > 0)).alias(name), ((F.col("recall_bound") == 1) & (F.coalesce("precision_bound", F.lit(1.0)) == 1)).alias(f"{name}_exact"))
    both = fails(one, "here").join(fails(other, "there"), "position")
    return both.agg(F.count("*").alias("queries"), F.count_if("here").alias("here"), F.count_if("there").alias("there"), F.count_if(F.col("here") & F.col("there")).alias("both"), F.count_if("here_exact").alias("exact"))


def unit_cost(runs: DataFrame, prompt_price: float = 0.15, output_price: float = 0.60) -> DataFrame:
    """Per model: tokens a call, calls a second, dollars a call. ``runs``: ``model, calls, seconds, prompt_tokens, output_tokens``."""
    sums = runs.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("calls", "seconds", "prompt_tokens", "output_tokens")])
    dollars = F.col("prompt_tokens") * (prompt_price / 1e6) + F.col("output_tokens") * (output_price / 1e6)
    per = lambda c: F.try_divide(c, F.col("calls"))
    return sums.select("model", "calls", per(F.col("prompt_tokens") + F.col("output_tokens")).alias("tokens_a_call"), F.try_divide("calls", "seconds").alias("calls_a_second"), per(dollars).alias("dollars_a_call"))


def pair_accuracy(judged: DataFrame) -> DataFrame:
    """``escalated, pairs, accuracy`` of judged pairs: those that went to the second judge, and the others."""
    return judged.groupBy("escalated").agg(F.count("*").alias("pairs"), F.avg((F.col("relation") == F.col("predicted")).cast("double")).alias("accuracy"))


def host_comparison(alone: DataFrame, reused: DataFrame) -> DataFrame:
    """``query, alone, reused, saved``: calls by the host's own counter without and with reuse. Both: ``query, calls``."""
    both = alone.select("query", F.col("calls").alias("alone")).join(reused.select("query", F.col("calls").alias("reused")), "query")
    return both.withColumn("saved", 1 - F.try_divide("reused", "alone"))


def run_agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """Share of rows answered alike in two runs, and of positives that flipped. Both: ``query, row_id, answer``."""
    both = one.alias("x").join(other.alias("y"), ["query", "row_id"])
    x, y = F.col("x.answer"), F.col("y.answer")
    return both.groupBy("query").agg(F.avg((x == y).cast("double")).alias("agreement"), _ratio(F.count_if(x != y), F.count_if(x | y), 0.0).alias("flipped"))


def compare_results(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Cells of two result tables that differ by more than a relative tolerance, or that one side lacks."""
    sides = left.select(*keys, *[F.col(v).cast("double").alias(f"l_{v}") for v in values]).join(right.select(*keys, *[F.col(v).cast("double").alias(f"r_{v}") for v in values]), keys, "full_outer")
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"l_{v}").alias("left"), F.col(f"r_{v}").alias("right")) for v in values]))
    differ = ~(F.abs(F.col("left") - F.col("right")) <= tolerance * F.greatest(F.abs("left"), F.abs("right")))
    return sides.select(*keys, cells.alias("c")).select(*keys, "c.*").filter(F.coalesce(differ, F.col("left").isNotNull() | F.col("right").isNotNull()))


def score_query(result, truth: DataFrame) -> tuple[int, int, int]:
    """True positives, reported and true rows of a result. ``truth``: ``row_id, answer``."""
    told = result.rows.join(truth, "row_id")
    return tuple(told.agg(F.count_if(F.col("reported") & F.col("answer")), F.count_if("reported"), F.count_if("answer")).first())


SCORED = "position int, name string, method string, reuse string, calls long, tp long, n_reported long, n_true long, precision double, recall double, tp_oracle long, n_oracle long, recall_oracle double, precision_oracle double, recall_bound double, precision_bound double, seconds double, seconds_asking double"


def run_workload(engine, predicates: list, labels, method: str = "reuse", tags: dict[str, str] | None = None) -> DataFrame:
    """Answers a stated list of predicates in order; a row a query, scored against labels and against the oracle's own answers.

    ``labels.truth(p)`` and, if there is one, ``engine.oracle.truth(p)`` give ``row_id, answer``. ``tags`` are added as columns.
    """
    ratio = lambda a, b: a / b if b else 1.0
    rows = []
    for i, p in enumerate(predicates):
        r = engine.query(p)
        tp, n, true = score_query(r, labels.truth(p))
        tp_o, _, true_o = (tp, n, true) if engine.oracle is labels or not hasattr(engine.oracle, "truth") else score_query(r, engine.oracle.truth(p))
        rows.append((i, p.name, method, r.reuse, r.n_calls, tp, n, true, ratio(tp, n), ratio(tp, true), tp_o, true_o, ratio(tp_o, true_o), ratio(tp_o, n), r.recall_bound, r.precision_bound, r.seconds, r.seconds_asking))
    out = engine.corpus.sparkSession.createDataFrame(rows, SCORED)
    for k, v in (tags or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out


def headline(scored: DataFrame, n_rows: int) -> DataFrame:
    """One row a method: calls against asking every row, how answers came about, mean scores, and certificates that reality fell short of."""
    short = lambda bound, value: F.count_if(F.col(bound) > F.col(value) + 1e-12)
    out = scored.groupBy("method").agg(
        F.count("*").alias("queries"), F.sum("calls").alias("calls"), F.count_if(F.col("reuse") == "exact-hit").alias("exact_hits"), F.count_if(F.col("reuse") == "cold").alias("cold"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), short("recall_bound", "recall_oracle").alias("recall_violations"), short("precision_bound", "precision_oracle").alias("precision_violations"),
    )
    return out.withColumn("reduction", F.try_divide(F.col("queries") * n_rows, F.col("calls")))


def cost_split(charges: DataFrame) -> DataFrame:
    """``tag, calls, share`` of all calls. ``charges``: ``tag, calls``."""
    sums = charges.groupBy("tag").agg(F.sum("calls").alias("calls"))
    return sums.withColumn("share", F.col("calls") / F.sum("calls").over(Window.partitionBy()))


def coverage(scored: DataFrame) -> DataFrame:
    """``certificates, covered, share``: how many recall bounds reality kept, over all queries."""
    given = F.col("recall_bound").isNotNull()
    kept = given & (F.col("recall_oracle") >= F.col("recall_bound") - 1e-12)
    return scored.agg(F.count_if(given).alias("certificates"), F.count_if(kept).alias("covered")).withColumn("share", F.try_divide("covered", "certificates"))
