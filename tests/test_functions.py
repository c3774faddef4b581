import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismview.functions import bounds, text
from prismview.functions.sampling import sample_pool, sample_strata
from prismview.operators.oracle import ModelOracle
from prismview.plans.predicates import Predicate
from prismview.sources import corpora


def exact_at_most(k, n, t, m):
    return sum(math.comb(t, i) * math.comb(n - t, m - i) for i in range(0, k + 1) if i <= t and m - i <= n - t) / math.comb(n, m)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 120), st.data())
def test_hypergeometric_tail_matches_integers(n, data):
    t, m = data.draw(st.integers(0, n)), data.draw(st.integers(0, n))
    k = data.draw(st.integers(0, m))
    assert abs(bounds.at_most(k, n, t, m) - exact_at_most(k, n, t, m)) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 80), st.data())
def test_bounds_are_the_extreme_consistent_counts(n, data):
    m = data.draw(st.integers(1, n))
    k = data.draw(st.integers(0, m))
    level = 0.05 - bounds.TIE  # a probability on the level counts as consistent
    fits_up = [t for t in range(k, n - (m - k) + 1) if exact_at_most(k, n, t, m) > level]
    fits_low = [t for t in range(k, n - (m - k) + 1) if 1 - (exact_at_most(k - 1, n, t, m) if k else 0) > level]
    assert bounds.upper_bound(n, m, k, 0.05) == (k if m == n else max(fits_up))
    assert bounds.lower_bound(n, m, k, 0.05) == (k if m == n else min(fits_low))


def test_coverage_of_the_upper_bound():
    rng, n, positives, m, short = random.Random(3), 400, 25, 60, 0
    for _ in range(400):
        k = sum(i < positives for i in rng.sample(range(n), m))
        short += bounds.upper_bound(n, m, k, 0.05) < positives
    assert short / 400 <= 0.05 + 0.03


def test_clopper_pearson_ends():
    assert bounds.clopper_pearson(0, 10)[0] == 0 and bounds.clopper_pearson(10, 10)[1] == 1
    low, high = bounds.clopper_pearson(5, 10)
    assert abs(low - 0.1871) < 1e-3 and abs(high - 0.8129) < 1e-3


def test_text_forms(spark):
    rows = spark.createDataFrame([(" The  Row, is. ", "Yes."), (None, None), ("A", "'no, never'"), ("", "well, yes"), ("b.", "maybe")], "t string, r string")
    got = rows.select(text.normal_form(F.col("t")).alias("n"), text.yes_no(F.col("r")).alias("y")).collect()
    assert [r.n for r in got] == ["the row is", None, "a", "", "b"]
    assert [r.y for r in got] == [True, None, False, True, False]


def test_documents_are_whole_unless_a_cut_is_asked_for(spark, tmp_path):
    long = "word " * 1000
    rows = spark.createDataFrame([(1, f" {long}\n")], "doc_id long, text string")
    assert rows.select(text.clean_document(F.col("text"))).first()[0] == long.strip()
    assert corpora.texts(rows, "doc_id", "text").first().text == long.strip()
    assert len(corpora.texts(rows, "doc_id", "text", most=2000).first().text) == 2000
    (tmp_path / "news.csv").write_text(f'1,"Title","{long}"\n')
    assert corpora.news_csv(spark, str(tmp_path / "news.csv")).first().text == f"Title. {long.strip()}"
    asked = ModelOracle(rows.select(F.col("doc_id").alias("row_id"), "text"), lambda: lambda claim, document: "yes" if len(document) > 1200 else "no")
    assert asked.answers(Predicate("long", frozenset()), spark.createDataFrame([(1,)], "row_id long")).first().answer


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("stratum"))
    a = sample_pool(rows.repartition(7), 100, 1, 2, "x").collect()
    b = sample_pool(rows.repartition(3), 100, 1, 2, "x").collect()
    assert {r.row_id for r in a} == {r.row_id for r in b} and len(a) == 100
    assert {r.row_id for r in sample_pool(rows, 100, 1, 3, "x").collect()} != {r.row_id for r in a}
    sizes = {"0": 10, "2": 700}
    got = sample_strata(rows, sizes, 1, 2, "y").groupBy("stratum").count().collect()
    assert {r[0]: r[1] for r in got} == {"0": 10, "2": 666}
    assert sample_strata(rows, {}, 1, 2, "y").count() == 0
