import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from prismview.functions import bounds
from prismview.operators import metrics, proxy, reasoners
from prismview.operators.baselines import ColdEngine, SimilarCache, best_entries, exact_cache
from prismview.operators.engine import FilterService, ReuseEngine, sem_filter
from prismview.operators.oracle import HostOracle, LabelOracle, ModelOracle, ReplayOracle
from prismview.plans import audit as audits
from prismview.plans.predicates import RELATIONS, Judgment, Predicate, relation_of_sets
from prismview.plans.rewrite import RewriteConfig, ViewUse, build_plan, choose_views
from prismview.plans.slack import Observation, SlackModel, admit
from prismview.plans.workloads import as_predicates, labelled_pairs, sessions, universe
from prismview.sources import answers, corpora
from prismview.streaming.predicate_stream import answer_stream

G0 = Predicate("The row is about g0.", frozenset({"g0_l0", "g0_l1"}))
LEAF = Predicate("The row is about g0_l0.", frozenset({"g0_l0"}))


def engine_of(corpus, **options):
    return ReuseEngine(corpus, LabelOracle(corpus), reasoners.LabelReasoner(**options.pop("reasoner", {})), **options)


def true_rows(result):
    return {r.row_id for r in result.rows.filter("reported").collect()}


def plan_of(spark, uses, views, n=12):
    rows = spark.range(n).select(F.col("id").alias("row_id"))
    seen = spark.createDataFrame([(v, r) for v, members in views.items() for r in members], "view_id int, row_id long")
    return {r.row_id: (r.role, r.stratum) for r in build_plan(rows, uses, seen).rows.collect()}


def test_rules_and_conflicts(spark):
    uses = [ViewUse("backward", 0, "a", 0.95), ViewUse("forward", 1, "b", 0.9), ViewUse("disjoint", 2, "c", 0.9)]
    plan = plan_of(spark, uses, {0: [0, 1, 9], 1: range(6), 2: [1, 5]})
    assert plan[0] == ("assumed", "backward:0")
    assert plan[1] == ("candidate", None)  # inside a backward and a disjoint view
    assert plan[9] == ("candidate", None)  # inside a backward view, outside a forward one
    assert plan[3] == ("candidate", None)
    assert plan[5] == ("pruned", "disjoint:2")
    assert plan[7] == ("pruned", "forward:1")


def test_views_below_their_level_are_not_used():
    judged = [(0, "a", Judgment("forward", 0.79)), (1, "b", Judgment("disjoint", 0.89)), (2, "c", Judgment("overlap", 1.0)), (3, "d", Judgment("equiv", 0.8))]
    assert [(u.rule, u.view_id) for u in choose_views(judged, RewriteConfig())] == [("backward", 3), ("forward", 3)]
    assert choose_views(judged, RewriteConfig(superset=False, union=False)) == []
    many = [(i, f"p{i}", Judgment("forward", 0.9)) for i in range(20)]
    assert len(choose_views(many, RewriteConfig())) == 8


def test_cold_exact_hit_and_rewrite(corpus):
    engine = engine_of(corpus)
    cold = engine.query(G0)
    assert cold.reuse == "cold" and cold.n_calls == 300 and cold.recall_bound is None
    again = engine.query(Predicate("the ROW is, about g0", G0.labels))
    assert again.reuse == "exact-hit" and again.n_calls == 0 and true_rows(again) == true_rows(cold)
    leaf = engine.query(LEAF)
    assert leaf.reuse == "rewrite" and true_rows(leaf) == {i for i in range(300) if i % 6 == 0}
    assert leaf.recall_bound >= 0.9 and leaf.used == (G0.pid,)
    log = engine.log.read()
    assert log.groupBy("query_index", "row_id").count().filter("count > 1").count() == 0  # every row is paid once
    assert log.count() == cold.n_calls + leaf.n_calls


@pytest.mark.parametrize("seed", [1, 2])
def test_certificates_hold_under_a_wrong_reasoner(spark, seed):
    rows = [(i, f"g{i % 3}_l{i // 3 % 2}") for i in range(900)]
    corpus = spark.createDataFrame(rows, "row_id long, leaf string").cache()
    engine = engine_of(corpus, reasoner={"error": 0.35, "seed": seed}, seed=seed)
    taxonomy = spark.createDataFrame([(f"g{g}_l{i}", f"g{g}") for g in range(3) for i in range(2)], "leaf string, grp string")
    short = 0
    for p in as_predicates(sessions(taxonomy, 6, seed)):
        result = engine.query(p)
        truth = {i for i, leaf in rows if leaf in p.labels}
        got = true_rows(result)
        recall = len(got & truth) / len(truth)
        precision = len(got & truth) / len(got) if got else 1.0
        short += result.recall_bound is not None and result.recall_bound > recall + 1e-12
        short += result.precision_bound is not None and result.precision_bound > precision + 1e-12
    assert short == 0


def test_no_audit_is_cheaper_and_has_no_bounds(corpus):
    engine = engine_of(corpus, audit=None)
    engine.query(G0)
    leaf = engine.query(LEAF)
    assert leaf.n_calls == 100 and leaf.recall_bound is None


def test_separate_pools_and_recall_only(corpus):
    for changes in ({"pooling": "separate"}, {"certify": "recall"}, {"certify": "recall-trust"}, {"mode": "fixed"}):
        engine = engine_of(corpus, audit=audits.AuditConfig(**changes))
        engine.query(LEAF)
        result = engine.query(G0)
        assert true_rows(result) == {i for i in range(300) if i % 3 == 0}
        assert (result.precision_bound is None) == (changes.get("certify", "joint") != "joint")


def test_noise_is_the_same_every_time(corpus):
    oracle = LabelOracle(corpus, noise=0.2, seed=5)
    one = {r.row_id: r.answer for r in oracle.truth(LEAF).collect()}
    two = {r.row_id: r.answer for r in oracle.answers(LEAF, corpus.repartition(5).limit(100)).collect()}
    assert all(one[k] == v for k, v in two.items())
    flipped = sum(one[i] != (i % 6 == 0) for i in range(300))
    assert 30 < flipped < 95


def test_replay_host_and_model_oracles(spark, corpus):
    matrix = LabelOracle(corpus).truth(LEAF).withColumn("text", F.lit(LEAF.text))
    assert ReplayOracle(matrix).answers(LEAF, corpus).filter("answer").count() == 50
    with pytest.raises(KeyError):
        ReplayOracle(matrix).answers(G0, corpus)
    host = HostOracle(lambda t, rows: rows.join(corpus.filter("leaf = 'g0_l0'").select("row_id"), "row_id", "left_semi"))
    assert host.answers(LEAF, corpus).filter("answer").count() == 50
    docs = spark.createDataFrame([(1, "about cats"), (2, None), (3, "dogs")], "row_id long, text string")
    model = ModelOracle(docs, lambda: lambda claim, document: "Yes" if "cats" in document else "no.")
    assert {r.row_id: r.answer for r in model.answers(Predicate("cats?"), docs).collect()} == {1: True, 2: False, 3: False}


def test_service_and_baselines(corpus):
    host = HostOracle(lambda t, rows: rows.join(corpus.filter("grp = 'g1'").select("row_id"), "row_id", "left_semi"))
    service = FilterService(ReuseEngine(corpus, host, reasoners.ThresholdReasoner(reasoners.PairScorer(reasoners.lexical_scores))))
    kept, result = sem_filter(corpus, "The row is about g1.", service)
    assert kept.count() == 100 and result.reuse == "cold"
    sem_filter(corpus, "the row is about g1", service)
    assert service.statistics()["reduction"] == 2.0
    oracle = LabelOracle(corpus)
    assert ColdEngine(corpus, oracle).query(LEAF).n_calls == 300
    cache = exact_cache(corpus, oracle)
    cache.query(G0)
    assert cache.query(LEAF).n_calls == 300 and cache.query(G0).n_calls == 0
    similar = SimilarCache(corpus, oracle, lambda t: [1.0, 0.0] if "g0" in t else [0.0, 1.0])
    similar.query(G0)
    assert similar.query(LEAF).reuse == "embed-hit@1.00"


def test_reasoners():
    found = reasoners.LabelReasoner().judge(LEAF, [G0, LEAF, Predicate("x", frozenset({"z"}))])
    assert [j.relation for j in found] == ["forward", "equiv", "disjoint"]
    assert relation_of_sets(frozenset(), frozenset({"a"})) == "forward"
    wrong = reasoners.LabelReasoner(error=1.0).judge(LEAF, [G0])
    assert wrong[0].relation != "forward" and wrong == reasoners.LabelReasoner(error=1.0).judge(LEAF, [G0])
    arbiter = reasoners.Arbiter(lambda kind, a, b: "yes" if kind == "implies" and a == LEAF.text else "no")
    two = reasoners.TwoTierReasoner(reasoners.LabelReasoner(confidence=0.5), arbiter, most=1)
    assert [j.relation for j in two.judge(LEAF, [G0, G0])] == ["forward", "forward"] and two.escalated == 1


def test_slack_model_and_admission():
    model = SlackModel()
    assert model.rate("forward") == pytest.approx(0.05)
    for _ in range(50):
        model.observe(Observation("forward", "a", 0.5, 0.2, 100))
    assert model.predict("forward", "a", 0.5) == pytest.approx(0.2, abs=0.01)
    assert model.rate("disjoint") > 0.05  # backed by what all rules have shown
    model.observe(Observation("forward", "a", 0.0, 0.2, 100))
    assert admit([("a", 10, 0.5), ("b", 100, 0.5)], 0.1) == ["b"]
    assert admit([("a", 10, 0.04), ("b", 100, 0.05)], 0.1) == ["b", "a"]


def test_budgeted_engine_learns(corpus):
    engine = engine_of(corpus, slack=SlackModel(), rewrite=RewriteConfig(slack_share=0.5))
    engine.query(G0)
    assert true_rows(engine.query(LEAF)) == {i for i in range(300) if i % 6 == 0}
    assert engine.slack.summary()["observations"] > 0


def test_audit_sizes():
    config = audits.AuditConfig()
    assert audits.assumed_size(config, 8, 0.05) == 8 and audits.assumed_size(config, 10**6, 0.025) == 36
    assert audits.pool_size(config, 1188, 0.6, 0.01) == 1188 and audits.pool_size(config, 10**6, 10**7, 0.01) == 20
    assert audits.plain_size(audits.AuditConfig(mode="fraction"), 1000) == 100


def test_workloads(spark):
    taxonomy = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b")], "leaf string, grp string")
    made = universe(taxonomy).collect()
    assert {(r.kind, r["name"]) for r in made} == {("leaf", "a1"), ("leaf", "a2"), ("leaf", "b1"), ("group", "a"), ("pair", "a1+a2"), ("pair", "a2+b1")}
    assert len({r.text for r in made}) == len(made)
    one, two = (as_predicates(sessions(taxonomy, 20, 3)) for _ in range(2))
    assert one == two and len(one) == 20 and one[0].labels == {"a1", "a2"} and one[1].labels < one[0].labels
    labels = {r.text: frozenset(r.labels) for r in made}
    pairs = labelled_pairs(universe(taxonomy), 5).collect()
    assert all(relation_of_sets(labels[r.p], labels[r.q]) == r.relation and r.relation in RELATIONS for r in pairs)
    assert len({(r.p, r.q) for r in pairs}) == len(pairs) and max(sum(r.relation == k for r in pairs) for k in RELATIONS) == 5


def test_metrics_conventions(spark):
    rows = spark.createDataFrame([("a", True, True), ("a", False, True), ("b", False, False)], "g string, reported boolean, truth boolean")
    got = {r.g: (r.precision, r.recall, r.f1) for r in metrics.precision_recall(rows, "g").collect()}
    assert got["a"][:2] == (1.0, 0.5) and got["b"][:2] == (1.0, 1.0)
    left = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    right = spark.createDataFrame([(1, 1.0 + 1e-9), (3, 5.0)], "k long, v double")
    assert sorted(r.k for r in metrics.compare_results(left, right, ["k"], ["v"]).collect()) == [2, 3]


class Failing(LabelOracle):
    """Fails in its n-th job; counts the rows that it was asked about in finished ones."""

    chunk_rows = 40

    def __init__(self, corpus, fail_at):
        super().__init__(corpus)
        self.left = fail_at

    def answers(self, predicate, rows):
        self.left -= 1
        if not self.left:
            raise OSError("the model is gone")
        return super().answers(predicate, rows)


def test_engine_goes_on_in_its_folder(corpus):
    engine = engine_of(corpus, slack=SlackModel())
    engine.query(G0)
    engine.query(LEAF)
    again = ReuseEngine.resume(corpus, LabelOracle(corpus), reasoners.LabelReasoner(), engine.folder, slack=SlackModel())
    hit = again.query(LEAF)
    assert hit.reuse == "exact-hit" and true_rows(hit) == {i for i in range(300) if i % 6 == 0} and hit.recall_bound == engine.store.views[1].recall_bound
    assert again.query_index == 3 and again.slack.summary() == engine.slack.summary()
    before = again.log.read().count()
    assert again.query(Predicate("The row is about g1.", frozenset({"g1_l0", "g1_l1"}))).n_calls == again.log.read().count() - before
    assert {r.kind for r in again.slack_features().collect()} <= {"forward", "disjoint"} and again.slack_features().count() >= 1
    assert again.store.footprint().filter("bytes > 0").count() == 3


@pytest.mark.parametrize("fail_at", [1, 4, 9, 12])
def test_a_query_that_broke_off_pays_for_the_rest_only(corpus, fail_at):
    whole = engine_of(corpus)
    cold, leaf = whole.query(G0), whole.query(LEAF)
    engine = ReuseEngine(corpus, Failing(corpus, fail_at), reasoners.LabelReasoner())
    broke = False
    for p in (G0, LEAF):
        try:
            engine.query(p)
        except OSError:
            broke = True
            paid = engine.log.read().count()
            engine = ReuseEngine.resume(corpus, LabelOracle(corpus), reasoners.LabelReasoner(), engine.folder)
            rest = engine.query(p)
            assert rest.n_calls == (cold if p is G0 else leaf).n_calls - (paid - (0 if p is G0 else cold.n_calls)) and (fail_at == 1 or paid)
    assert broke
    log = engine.log.read()
    assert log.count() == cold.n_calls + leaf.n_calls == log.select("pid", "row_id").distinct().count()
    assert true_rows(engine.query(LEAF)) == true_rows(leaf)


def test_results_of_baselines_ask_nothing_again(corpus):
    asked = []

    def keep(text, rows):
        asked.append(rows.count())
        return rows.join(corpus.filter("grp = 'g1'").select("row_id"), "row_id", "left_semi")

    cold = ColdEngine(corpus, HostOracle(keep))
    result = cold.query(LEAF)
    assert result.rows.count() == 300 and result.rows.filter("reported").count() == 100
    similar = SimilarCache(corpus, HostOracle(keep), lambda t: [1.0])
    similar.query(LEAF)
    hit = similar.query(G0)
    assert hit.n_calls == 0 and hit.rows.filter("reported").count() == 100 and hit.rows.count() == 300
    assert asked == [300, 300]


def test_corrections_are_what_the_plan_got_wrong(spark, corpus):
    plan = corpus.select("row_id", F.when(F.col("leaf") == "g0_l0", "assumed").when(F.col("grp") == "g1", "pruned").otherwise("candidate").alias("role"), F.when(F.col("leaf") == "g0_l0", "backward:0").when(F.col("grp") == "g1", "forward:1").alias("stratum"))
    wrong = frozenset({"g0_l1", "g1_l0"})  # assumed rows are false, some pruned ones true
    oracle = LabelOracle(corpus)

    def ask(rows, tag):
        return oracle.answers(Predicate("x", wrong), rows.select("row_id")).withColumn("paid", F.lit(True))

    audit = audits.run_audit(plan, {"backward:0": 50, "forward:1": 100}, {}, 10, ask, audits.AuditConfig(mode="fixed", most_sample=10**6), 0, 0)
    got = {(r.row_id, r.stratum, r.answer) for r in audit.corrections(plan).collect()}
    rows = {r.row_id: r.leaf for r in corpus.collect()}
    assert got == {(i, "backward:0", False) for i, f in rows.items() if f == "g0_l0"} | {(i, "forward:1", True) for i, f in rows.items() if f == "g1_l0"}


def test_bounds_fail_no_more_often_than_they_may():
    for population, positives, sample in ((60, 7, 20), (40, 0, 10), (200, 30, 50), (50, 50, 5)):
        exact = sum(math.comb(positives, k) * math.comb(population - positives, sample - k) for k in range(min(sample, positives) + 1) if sample - k <= population - positives and bounds.upper_bound(population, sample, k, 0.05) < positives) / math.comb(population, sample)
        assert bounds.noncoverage(population, positives, sample, 0.05) == pytest.approx(exact, abs=1e-9) and exact <= 0.05


def test_values_and_bands_by_refined_histograms(spark):
    rng = random.Random(1)
    for values in ([rng.gauss(0, 1) for _ in range(3000)], [float(rng.randrange(4)) for _ in range(2000)], [1e9] + [rng.random() * 1e-6 for _ in range(1500)], [5.0] * 40):
        rows = spark.createDataFrame(list(enumerate(values)), "row_id long, score double").repartition(3)
        ranks = [0, 1, len(values) // 3, len(values) - 1]
        assert proxy.values_at(rows, "score", ranks, bins=16, most=20) == {r: sorted(values)[r] for r in ranks}
    spread = spark.createDataFrame([(i, float(i)) for i in range(100)], "row_id long, score double")
    assert sorted(r["count"] for r in proxy.score_bands(spread, 4).groupBy("band").count().collect()) == [25, 25, 25, 25]
    assert proxy.score_bands(spread.limit(0), 4).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(2.0 if i % 6 == 0 else 0.0, 1.0), rng.gauss(0, 1), 1.0]) for i in range(1200)]
    return spark.createDataFrame(rows, "row_id long, vector array<double>").cache()


def test_cutoff_by_brute_force(spark):
    chosen = []
    for seed, apart in ((6, 3.0), (7, 6.0), (8, 5.0), (9, 0.0)):
        rng = random.Random(seed)
        rows = [(i, rng.gauss(apart if i % 5 == 0 else 0.0, 1.0), i % 5 == 0) for i in range(300)]
        digest = lambda i: hashlib.md5(f"0|0|cutoff||{i}".encode()).hexdigest()
        order = sorted((digest(i), i, s) for i, s, a in rows if a)
        fitted, other = sorted(s for n, (_, _, s) in enumerate(order, 1) if n % 2), [s for n, (_, _, s) in enumerate(order, 1) if not n % 2]
        place = 0.05 * (len(fitted) - 1)
        cutoff = fitted[int(place)] + (fitted[int(place) + 1] - fitted[int(place)]) * (place - int(place))
        good = sum(s >= cutoff for s in other) >= 0.95 * len(other) and sum(s >= cutoff for _, s, _ in rows) <= 0.8 * len(rows)
        got = proxy.choose_cutoff(spark.createDataFrame(rows, "row_id long, score double, answer boolean"))
        assert got == (pytest.approx(cutoff) if good else None)
        chosen.append(got)
    assert None in chosen and any(c is not None for c in chosen)
    assert proxy.choose_cutoff(spark.createDataFrame(rows[:20], "row_id long, score double, answer boolean")) is None  # four positives
    flat = [(i, 1.0, a) for i, _, a in rows]
    assert proxy.choose_cutoff(spark.createDataFrame(flat, "row_id long, score double, answer boolean")) is None  # nothing to gain


def test_proxy_learns_remembers_and_forgets(spark, vectors):
    pilot = vectors.filter("row_id < 240").select("row_id", (F.col("row_id") % 6 == 0).alias("answer"))
    own = proxy.EmbeddingProxy(vectors, lambda t: [1.0, 0.0, 0.0])
    scored = {r.row_id: r.score for r in own.scores(LEAF, pilot).collect()}
    inside = [scored[i] > scored[j] for i, j in itertools.product(range(240, 300, 6), range(241, 300, 6))]
    assert sum(inside) > 0.8 * len(inside)
    own.scores(LEAF, pilot.limit(0))
    assert own.stats == {"fits": 1, "zero_shot": 0}  # remembered
    own.reset_training()
    plain = {r.row_id: r.score for r in own.scores(LEAF, pilot.filter("answer")).collect()}
    assert own.stats == {"fits": 2, "zero_shot": 1} and plain == {r.row_id: r.vector[0] for r in vectors.collect()}


def test_cascade_alone_and_in_the_engine(spark, vectors):
    corpus = vectors.select("row_id", F.when(F.col("row_id") % 6 == 0, "yes").otherwise("no").alias("leaf")).cache()
    predicate, truth = Predicate("yes?", frozenset({"yes"})), set(range(0, 1200, 6))
    cascade = proxy.ProxyCascade(proxy.EmbeddingProxy(vectors, lambda t: [1.0, 0.0, 0.0]))
    alone = proxy.ProxyCascadeEngine(corpus, LabelOracle(corpus), cascade)
    result = alone.query(predicate)
    found = true_rows(result)
    assert result.reuse == "proxy-cascade" and found <= truth and len(found) >= result.recall_bound * len(truth) and result.recall_bound >= 0.9
    assert result.calls["pilot"] == 200 and result.n_calls == alone.log.read().count() <= 1200
    assert alone.query(predicate).reuse == "proxy-cascade"
    inside = ReuseEngine(corpus, LabelOracle(corpus), reasoners.LabelReasoner(), proxy=cascade)
    inside.query(predicate)
    assert inside.query(predicate).reuse == "exact-hit"


def test_hashing_embedder_is_one_on_driver_and_column(spark, tmp_path):
    embed = proxy.HashingEmbedder(32)
    texts = ["The row is about ASIA.", "", None, "  two   words ", "é ß"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    got = proxy.embed_documents(docs, embed, f"file://{tmp_path}/vectors")
    assert {r.row_id: r.vector for r in got.collect()} == {i: embed(t or "") for i, t in enumerate(texts)}
    assert all(abs(sum(x * x for x in embed(t or "")) - 1) < 1e-9 for t in texts)


def test_nearest_entries_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(90)]
    entries = spark.createDataFrame(rows, "name int, position int, vector array<double>")
    queries = entries.filter("name % 7 = 3")
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    want = {}
    for i, _, v in rows:
        if i % 7 == 3 and norm(v):
            near = [(round(sum(a * b for a, b in zip(v, u, strict=True)) / (norm(v) * norm(u)), 6), -j) for j, _, u in rows[:i] if norm(u)]
            want[i] = -max(near)[1]
    for block in (10, 10_000):
        got = {r["name"]: r.entry for r in best_entries(queries, entries, block).collect() if r.similarity is not None}
        assert got == want


def test_nearest_entries_of_odd_vectors(spark):
    nan = float("nan")
    vectors = [None, [0.0, 0.0], [1.0, None], [3.0, 4.0], [1.0], [4.0, 3.0], [6.0, 8.0], [nan, 1.0], [1e-170, 0.0], [2.0, 1.5], [-1.0, 0.0], [], [3.0, 4.0]]
    rows = spark.createDataFrame([(f"v{i}", i, v) for i, v in enumerate(vectors)], "name string, position long, vector array<double>")
    got = {r.name: (r.entry, r.similarity) for r in best_entries(rows, rows.union(spark.createDataFrame([("lost", None, [3.0, 4.0])], rows.schema))).collect()}
    want = {"v1": ("v0", None), "v2": ("v0", None), "v3": ("v0", None), "v4": ("v0", None), "v5": ("v3", 0.96), "v6": ("v3", 1.0), "v7": ("v3", nan), "v8": ("v0", None), "v9": ("v7", nan), "v10": ("v7", nan), "v11": ("v0", None), "v12": ("v7", nan)}
    assert {n: (e, str(s)) for n, (e, s) in got.items()} == {n: (e, str(s)) for n, (e, s) in want.items()}
    assert best_entries(rows, rows.limit(0)).count() == 0 == best_entries(rows.limit(0), rows).count()


def test_nearest_entries_do_not_copy_entries(spark):
    """40 blocks of queries meet 4000 entries: a copy for each block would be 160,000 rows and more."""
    rows = spark.range(4000).select(F.col("id").alias("name"), F.col("id").alias("position"), F.array(F.col("id") % 7 + 1.0, F.col("id") % 5 + 1.0).alias("vector"))
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    found = best_entries(rows.filter("name % 20 = 0 AND name > 0"), rows, 5).collect()
    assert len(found) == 199
    for r in found:
        a, b = r.name % 7 + 1, r.name % 5 + 1
        assert r.name < 35 or (r.similarity == 1 and r.entry == next(j for j in range(35) if a * (j % 5 + 1) == b * (j % 7 + 1)))
    assert shuffled() - before < 4000


def test_calibrated_and_extensional_judges(spark, corpus):
    rng = random.Random(4)
    names = {"alpha": "ab", "beta": "b", "gamma": "c", "delta": "abc", "eps": "ab"}
    held = {n: set(x) for n, x in names.items()}

    def score(pairs):
        return [(0.9 + 0.05 * rng.random(), 0.02) if not held[p] & held[q] else (0.05, 0.9) if held[p] <= held[q] else (0.1, 0.3) for p, q in pairs]

    told = [(p, q, relation_of_sets(frozenset(held[p]), frozenset(held[q]))) for p in names for q in names if p != q]
    judge = reasoners.CalibratedReasoner(reasoners.PairScorer(score))
    assert [j.relation for j in judge.judge(Predicate("alpha"), [Predicate("eps")])] == ["equiv"]  # by threshold until it is fitted
    assert judge.fit(spark, told, c=100.0) >= 0.9
    got = {q: judge.judge(Predicate("alpha"), [Predicate(q)])[0] for q in ("beta", "gamma", "delta", "eps")}
    assert {q: j.relation for q, j in got.items()} == {"beta": "backward", "gamma": "disjoint", "delta": "forward", "eps": "equiv"} and all(0 < j.confidence <= 1 for j in got.values())
    assert len(reasoners.pair_features(judge.scorer, [("alpha", "beta")])[0]) == 6

    texts = {"g0": "grp = 'g0'", "g0l0": "leaf = 'g0_l0'", "g1": "grp = 'g1'", "all": "true"}
    seen = None
    for t, cond in texts.items():
        own = corpus.filter(cond).select(F.lit(t).alias("text"), "row_id")
        seen = own if seen is None else seen.union(own)
    by_rows = reasoners.ExtensionalReasoner(seen)
    assert [j.relation for j in by_rows.judge(Predicate("g0l0"), [Predicate(t) for t in ("g0", "g1", "all", "g0l0", "nothing")])] == ["forward", "disjoint", "forward", "equiv", "backward"]
    engine = ReuseEngine(corpus, LabelOracle(corpus), reasoners.ExtensionalReasoner(seen))
    engine.query(Predicate("g0", G0.labels))
    assert engine.query(Predicate("g0l0", LEAF.labels)).reuse == "rewrite"


def test_arbiter_takes_its_trust_from_judged_pairs(spark):
    replies = iter(["hm", "yes", "no", "hm", "hm", "no", "yes"])
    arbiter = reasoners.Arbiter(lambda kind, a, b: next(replies))
    assert arbiter.pair("p", "q") == Judgment("forward", 0.75) and arbiter.calls == 3
    assert arbiter.pair("p", "r").relation == "disjoint"
    judged = spark.createDataFrame([("forward", "forward"), ("forward", "overlap"), ("disjoint", "overlap")], "predicted string, relation string")
    assert arbiter.calibrate(judged) == {"forward": 0.5, "disjoint": 0.3} and not arbiter.memory


def test_workload_is_scored_against_labels_and_oracle(spark, corpus):
    noisy = LabelOracle(corpus, noise=0.1, seed=2, version="noisy")
    engine = ReuseEngine(corpus, noisy, reasoners.LabelReasoner())
    scored = metrics.run_workload(engine, [G0, LEAF, G0], LabelOracle(corpus), tags={"run": "r1"})
    rows = scored.orderBy("position").collect()
    assert [r.reuse for r in rows] == ["cold", "rewrite", "exact-hit"] and {r.run for r in rows} == {"r1"}
    labels, said = ({r.row_id for r in o.truth(LEAF).filter("answer").collect()} for o in (LabelOracle(corpus), noisy))
    got = true_rows(engine.query(LEAF))
    assert (rows[1].tp, rows[1].n_reported, rows[1].n_true) == (len(got & labels), len(got), len(labels))
    assert rows[1].recall_oracle == pytest.approx(len(got & said) / len(said))
    top = metrics.headline(scored, 300).first()
    assert top.queries == 3 and top.calls == sum(r.calls for r in rows) and top.reduction == pytest.approx(900 / top.calls) and top.exact_hits == 1
    assert metrics.coverage(scored).first().share == 1.0
    split = {r.tag: r.calls for r in metrics.cost_split(engine.log.charges()).collect()}
    assert sum(split.values()) == top.calls


def test_shortfalls_of_two_draws(spark):
    schema = "position int, tp long, n_true long, n_reported long, recall_bound double, precision_bound double"
    one = spark.createDataFrame([(0, 9, 10, 9, 0.95, 1.0), (1, 10, 10, 10, 1.0, 1.0), (2, 8, 10, 10, 0.7, 0.9)], schema)
    other = spark.createDataFrame([(0, 9, 10, 9, 0.99, None), (1, 10, 10, 10, 0.9, 1.0), (2, 8, 10, 10, 0.8, 0.8)], schema)
    assert tuple(metrics.shortfall_draws(one, other).first()) == (3, 2, 1, 1, 1)


def test_matrix_is_saved_whole_or_refused(spark, tmp_path):
    cache = spark.createDataFrame([("m", "1", c, r, (r + len(c)) % 2 == 0, 1, 1, "", w) for w in (0, 1) for c in ("a", "bb") for r in range(3)], answers.CACHED)
    rows, claims = spark.range(3).withColumnRenamed("id", "row_id"), spark.createDataFrame([("a",), ("bb",)], "claim string")
    matrix = answers.cached_matrix(cache, claims, rows, "m", "1")
    assert matrix.count() == 6
    with pytest.raises(KeyError, match="1 of 'bb'"):
        answers.cached_matrix(cache, claims, spark.range(4).withColumnRenamed("id", "row_id").filter("row_id <> 3").union(spark.range(0)), "m", "1") and answers.cached_matrix(cache.filter("NOT (claim = 'bb' AND row_id = 2)"), claims, rows, "m", "1")
    answers.save_matrix(matrix, f"file://{tmp_path}/m", model="m", corpus="three", tokens=12)
    loaded, told = answers.load_matrix(spark, f"file://{tmp_path}/m")
    assert told == {"model": "m", "corpus": "three", "tokens": 12} and ReplayOracle(loaded).answers(Predicate("a"), rows).count() == 3


def test_model_oracle_waits_and_tries_again(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, text string")

    def client():
        seen = {}

        def ask(claim, document):
            seen[document] = seen.get(document, 0) + 1
            if seen[document] < 3:
                raise TimeoutError("busy")
            return "yes"

        return ask

    model = ModelOracle(docs, client, wait=0.001, attempts=4, failures=(TimeoutError,))
    assert model.answers(LEAF, docs).filter("answer").count() == 2


def test_cache_is_filled_once_and_costed(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "row_id long, text string")
    claims = spark.createDataFrame([("even",), ("small",)], "claim string")
    client = lambda: lambda c, t: ("yes" if int(t.split()[1]) % 2 == 0 else "no", 10, 2)
    path = f"file://{tmp_path}/cache"
    assert answers.fill_cache(spark, path, claims.limit(1), rows, client, "m", "1") == 20
    assert answers.fill_cache(spark, path, claims, rows, client, "m", "1", first_row=5, last_row=9) == 5

    def breaks():
        def call(claim, document):
            if document == "text 15":
                raise OSError("gone")
            return "no", 10, 2

        return call

    with pytest.raises(Exception, match="gone"):
        answers.fill_cache(spark, path, claims, rows, breaks, "m", "1", chunk_cells=2)
    left = 40 - spark.read.schema(answers.CACHED).parquet(f"{path}/answers").count()
    assert 0 < left < 15  # what was committed before stays
    assert answers.fill_cache(spark, path, claims, rows, client, "m", "1", chunk_cells=3) == left
    assert answers.fill_cache(spark, path, claims, rows, client, "m", "1") == 0
    cost = answers.run_cost(spark, path).first()
    assert (cost.cells, cost.calls, cost.prompt_tokens) == (40, 40, 400)


def test_loaders_name_leaves_and_groups(spark, tmp_path):
    posts = spark.createDataFrame([(1, "comp.graphics", "x" * 60), (2, "rec.autos", "y" * 70), (3, "rec.autos", "short")], "id long, label string, body string")
    got = {r.row_id: (r.leaf, r.grp) for r in corpora.newsgroups(posts, "id", "label", "body", {"rec.autos": "cars"}, {"rec": "leisure"}).collect()}
    assert got == {1: ("comp.graphics", "comp"), 2: ("cars", "leisure")}
    (tmp_path / "n.csv").write_text('1,"T","B"\n2,T,B\n')
    news = corpora.news_csv(spark, f"file://{tmp_path}/n.csv", classes={1: "world"}, groups={"world": "news"}).collect()
    assert [(r.leaf, r.grp) for r in news] == [("world", "news"), ("2", "2")]
    docs = spark.createDataFrame([(1, ["C1", "C15", "CCAT"]), (2, ["C15", "C151"])], "row_id long, labels array<string>")
    kept, parents = corpora.topic_hierarchy(docs, {"C": "CCAT"}, 2)
    assert {r.row_id: r.labels for r in kept.collect()} == {1: ["C15"], 2: ["C15"]} and {r.code: r.parent for r in parents.collect()} == {"C15": "CCAT"}
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "label string, parent string")
    assert {r.label: r.root for r in corpora.roots_of(edges).collect()} == {"a": "a", "b": "a", "c": "a"}
    assert {r.label: r.children for r in corpora.children_of(edges).collect()} == {"a": ["b"], "b": ["c"], "c": []}
    assert corpora.load_corpus(spark, "synthetic", "", 50).count() <= 50


def test_corpora(spark, tmp_path):
    with pytest.raises(ValueError):
        corpora.load_corpus(spark, "nowhere", "/none")
    assert corpora.synthetic(spark, 60).select("leaf").distinct().count() == 6
    (tmp_path / "news.csv").write_text('1,"Title","Body, with ""quotes"""\n2,T,B\n')
    assert [r.text for r in corpora.news_csv(spark, f"file://{tmp_path}/news.csv").collect()] == ['Title. Body, with "quotes"', "T. B"]


def test_predicates_as_a_stream(spark, corpus, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(0, G0.text, sorted(G0.labels)), (1, LEAF.text, sorted(LEAF.labels))], "position int, text string, labels array<string>").coalesce(1).write.json(source)
    stream = spark.readStream.schema("position int, text string, labels array<string>").json(source)
    seen = []
    engine = engine_of(corpus)
    answer_stream(stream, engine, seen.append, str(tmp_path / "check")).awaitTermination()
    assert [r.reuse for r in seen] == ["cold", "rewrite"]
    # The batch runs again in a new engine over the folder, as after a lost driver: nothing is paid.
    again = engine_of(corpus, folder=engine.folder)
    answer_stream(stream, again, seen.append, str(tmp_path / "other")).awaitTermination()
    assert [(r.reuse, r.n_calls) for r in seen[2:]] == [("exact-hit", 0)] * 2 and true_rows(seen[3]) == true_rows(seen[1])
