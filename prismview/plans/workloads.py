"""Predicates over a two-level taxonomy as tables, and workloads drawn from them by hash.

The taxonomy is a table ``leaf, grp`` of a stated, small number of labels; what is made of it
stays a DataFrame. Draws are digests of (seed, position), so a workload is the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismview.plans.predicates import Predicate, relation_of_labels

#: Ways to ask for one label, and for either of two.
ASK_ONE = ("Origin of the record: {}?", "Was {} where it came from?", "Keep what {} accounts for.")
ASK_TWO = ("Origin of the record: {} or else {}?", "Keep what {} and {} account for together.")
#: Queries of a session: its group, a leaf, the leaf asked otherwise, the leaf with its neighbour, the group asked otherwise, another leaf.
SESSION = ("group", "leaf", "leaf again", "pair", "group again", "other leaf")


def hash_draw(seed: int, *parts: Column) -> Column:
    """A whole number below 2^28 by a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 7), 16, 10).cast("int")


def label_sets(taxonomy: DataFrame) -> DataFrame:
    """``kind, name, labels``: each leaf, each group of two leaves or more, and each leaf with the next one by name."""
    leaf = taxonomy.select(F.lit("leaf").alias("kind"), F.col("leaf").alias("name"), F.array("leaf").alias("labels"))
    group = taxonomy.groupBy("grp").agg(F.array_sort(F.collect_set("leaf")).alias("labels")).filter(F.size("labels") > 1)
    following = F.lead("leaf").over(Window.orderBy("leaf"))  # the stated labels
    pair = taxonomy.select("leaf", following.alias("other")).filter("other IS NOT NULL")
    return leaf.union(group.select(F.lit("group"), "grp", "labels")).union(pair.select(F.lit("pair"), F.concat_ws("+", "leaf", "other"), F.array_sort(F.array("leaf", "other"))))


def universe(taxonomy: DataFrame) -> DataFrame:
    """``kind, name, wording, text, labels``: every label set in each of its wordings."""
    sets = label_sets(taxonomy)

    def worded(text: str) -> Column:
        parts = text.split("{}")
        names = [F.split("name", r"\+")[0], F.split("name", r"\+")[1]] if len(parts) == 3 else [F.col("name")]
        return F.concat(*[x for p, n in zip(parts, names, strict=False) for x in (F.lit(p), n)], F.lit(parts[-1]))

    texts = F.when(F.col("kind") == "pair", F.array(*map(worded, ASK_TWO))).otherwise(F.array(*map(worded, ASK_ONE)))
    return sets.select("kind", "name", F.posexplode(texts).alias("wording", "text"), "labels")


def labelled_pairs(predicates: DataFrame, quota: int, seed: int = 0) -> DataFrame:
    """``p, q, relation``: ordered pairs of different texts, ``quota`` of each relation by hash; fewer where there are not so many.

    ``predicates``: ``text, labels`` of a stated list. A rare relation cannot be filled from another, so none is repeated.
    """
    p, q = predicates.select(F.col("text").alias("p"), F.col("labels").alias("lp")), predicates.select(F.col("text").alias("q"), F.col("labels").alias("lq"))
    pairs = p.join(q, F.col("p") != F.col("q")).select("p", "q", relation_of_labels(F.col("lp"), F.col("lq")).alias("relation"))
    nth = F.row_number().over(Window.partitionBy("relation").orderBy(hash_draw(seed, F.col("p"), F.col("q")), "p", "q"))
    return pairs.withColumn("nth", nth).filter(F.col("nth") <= quota).drop("nth")


def sessions(taxonomy: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``position, step, kind, name, wording, text, labels``: ``n`` queries in sessions that drill into a group and back."""
    spark = taxonomy.sparkSession
    groups = taxonomy.groupBy("grp").agg(F.array_sort(F.collect_set("leaf")).alias("leaves")).filter(F.size("leaves") > 1)
    many = groups.count()
    numbered = groups.withColumn("g", F.row_number().over(Window.orderBy("grp")) - 1)  # the stated groups
    steps = spark.range(n).select(F.col("id").cast("int").alias("position"), (F.col("id") / len(SESSION)).cast("int").alias("session"), (F.col("id") % len(SESSION)).cast("int").alias("step"))
    chosen = steps.withColumn("g", hash_draw(seed, F.lit("group"), F.col("session")) % max(many, 1)).join(F.broadcast(numbered), "g")
    pick = lambda what: F.col("leaves")[hash_draw(seed, F.lit(what), F.col("session")) % F.size("leaves")]
    step = lambda *which: F.col("step").isin([SESSION.index(w) for w in which])
    following = taxonomy.select(F.col("leaf").alias("first"), F.lead("leaf").over(Window.orderBy("leaf")).alias("next"))  # the stated labels
    told = chosen.withColumn("first", pick("leaf")).join(F.broadcast(following), "first", "left")
    kind = F.when(step("group", "group again"), "group").when(step("pair") & F.col("next").isNotNull(), "pair").otherwise("leaf")
    name = F.when(kind == "group", F.col("grp")).when(kind == "pair", F.concat_ws("+", "first", "next")).when(step("other leaf"), pick("other")).otherwise(F.col("first"))
    asked = told.select("position", "step", kind.alias("kind"), name.alias("name"), F.when(step("leaf again", "group again"), 1).otherwise(0).alias("wording"))
    return asked.join(universe(taxonomy), ["kind", "name", "wording"])


def as_predicates(queries: DataFrame) -> list[Predicate]:
    """A workload, a stated list, in order. ``queries``: ``position, name, text, labels``."""
    return [Predicate(r.text, frozenset(r.labels), r.name) for r in queries.orderBy("position").collect()]
