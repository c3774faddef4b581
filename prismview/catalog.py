"""Registered queries of the view-reuse engine. Their DuckDB twins are in ``prismview.twins``.

Corpora are customers and orders with the nation (leaf) and region (group) of the
customer, documents with several labels, and embeddings. Views hold what a predicate
over nations reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismview import twins
from prismview.functions import bounds, text, vectors
from prismview.functions.sampling import sample_pool, sample_strata
from prismview.operators import metrics, proxy, reasoners
from prismview.operators.baselines import exact_cache
from prismview.operators.nearest import best_entries
from prismview.operators.engine import ReuseEngine
from prismview.operators.oracle import LabelOracle, flip_column
from prismview.plans import audit as audits
from prismview.plans import workloads
from prismview.plans.predicates import BACKWARD, DISJOINT, FORWARD, Judgment, Predicate, relation_of_counts, relation_of_labels, threshold_relation
from prismview.plans.rewrite import RewriteConfig, ViewUse, build_plan, choose_views, reported
from prismview.plans.slack import Observation, SlackModel, admit
from prismview.sources import answers, corpora
from prismview.twins import ARITHMETIC_ROWS, BOUND_ROWS, CERTIFIED, DECLARED, DRAWN, HOT_VIEWS, NOISE_RATE, NOISE_SEED, NOISE_TEXT, OFFERS, REGION_NATIONS, SEEN, SIZES, SPLIT, VIEWS

ASIA = frozenset(REGION_NATIONS["ASIA"])


def _predicate(name: str) -> Predicate:
    return Predicate(f"The row is about {name}.", frozenset(VIEWS[name]), name)


def _view_rows(corpus: DataFrame, names: list[str]) -> DataFrame:
    """``view_id, row_id`` of the rows that stated views report."""
    inside = F.array_compact(F.array(*[F.when(F.col("leaf").isin(list(VIEWS[n])), F.lit(i)) for i, n in enumerate(names)]))
    return corpus.select(F.explode(inside).alias("view_id"), "row_id")


def _plan(spark: SparkSession, sf_dir: str, uses: list[tuple[str, str]]) -> DataFrame:
    """Plan over customers from (rule, view name) in claim order."""
    corpus = corpora.customers(spark, sf_dir)
    names = [n for _, n in uses]
    return build_plan(corpus, [ViewUse(r, i, n, 0.99) for i, (r, n) in enumerate(uses)], _view_rows(corpus, names)).rows


def cold_filter(spark, sf_dir):
    corpus = corpora.orders(spark, sf_dir)
    return LabelOracle(corpus).truth(_predicate("ASIA"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NATION_2 answered from a cached view of its region, with a certificate."""
    return certified_query(spark, sf_dir)


def _engine(spark, corpus, **options) -> ReuseEngine:
    return ReuseEngine(corpus, LabelOracle(corpus), reasoners.LabelReasoner(), **options)


def exact_hit(spark, sf_dir):
    engine = _engine(spark, corpora.customers(spark, sf_dir))
    engine.query(_predicate("ASIA"))
    again = engine.query(Predicate("the row   IS about asia", frozenset(ASIA)))
    assert again.reuse == "exact-hit" and not again.n_calls
    return again.rows


def certified_query(spark, sf_dir):
    engine = _engine(spark, corpora.customers(spark, sf_dir))
    engine.query(_predicate("ASIA"))
    return engine.query(_predicate("NATION_2")).rows


def certified_workload(spark, sf_dir):
    """Calls and bounds of a short chain of related predicates, one row a query (no twin: samples decide the calls)."""
    corpus = corpora.orders(spark, sf_dir)
    engine = _engine(spark, corpus)
    done = [engine.query(_predicate(n)) for n in ("ASIA", "NATION_2", "ASIA_OR_EUROPE", "EUROPE")]
    rows = [(i, r.predicate.name, r.reuse, r.n_calls, r.recall_bound, r.precision_bound) for i, r in enumerate(done)]
    return spark.createDataFrame(rows, "position int, name string, reuse string, calls long, recall_bound double, precision_bound double")


def exact_cache_calls(spark, sf_dir):
    corpus = corpora.customers(spark, sf_dir)
    engine = exact_cache(corpus, LabelOracle(corpus))
    done = [engine.query(_predicate(n)) for n in ("ASIA", "NATION_2", "ASIA")]
    return spark.createDataFrame([(i, r.reuse, r.n_calls) for i, r in enumerate(done)], "position int, reuse string, calls long")


def normalize_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.normal_form(F.col("text")).alias("norm"))


def predicate_pid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.predicate_id(F.col("text")).alias("pid"))


def clean_documents(spark, sf_dir):
    """Cut as its twin is; ``whole_documents`` has the whole texts."""
    return corpora.texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", most=2000)


def whole_documents(spark, sf_dir):
    return corpora.texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def yes_no_parse(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    reply = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Yes, ", " no.", "true ", "'FALSE' ", "", "well yes ")]), (F.col("turn") % 6 + 1).cast("int")), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", text.yes_no(reply).alias("answer"))


def token_cost(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    sized = turns.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", F.length("text")).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).alias("output_tokens"))
    return sized.select("conv_id", F.round(text.call_cost(F.col("prompt_tokens"), F.col("output_tokens")), 9).alias("dollars"))


def _named_sets(spark, sf_dir) -> DataFrame:
    """Stated predicates over nations: each nation, each region."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    leaf = nation.select(F.col("n_name").alias("name"), F.array("n_name").alias("labels"))
    group = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name")).agg(F.array_sort(F.collect_set("n_name")).alias("labels"))
    return leaf.union(group)


def relation_setalgebra(spark, sf_dir):
    sets = _named_sets(spark, sf_dir)
    p, q = sets.alias("p"), sets.alias("q")
    return p.join(q, F.col("p.name") != F.col("q.name")).select(F.col("p.name").alias("p"), F.col("q.name").alias("q"), relation_of_labels(F.col("p.labels"), F.col("q.labels")).alias("relation"))


def _extensions(spark, sf_dir) -> DataFrame:
    of = corpora.customers(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("row_id"), "c_mktsegment"), "row_id")
    return of.select(F.explode(F.array("leaf", "grp", "c_mktsegment")).alias("name"), "row_id")


def relation_extensional(spark, sf_dir):
    counts = reasoners.extension_counts(_extensions(spark, sf_dir))
    return counts.select("p", "q", "n_p", "n_q", "n_both", relation_of_counts(F.col("n_p"), F.col("n_q"), F.col("n_both")).alias("relation"))


def relation_mix(spark, sf_dir):
    found = relation_extensional(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"))
    return found.select("relation", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


def threshold_head(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", *[((F.col("c_custkey") * k % 101) / 100).alias(n) for n, k in (("c_f", 7), ("e_f", 13), ("c_b", 29), ("e_b", 53))])
    found = threshold_relation(*[F.col(n) for n in ("c_f", "e_f", "c_b", "e_b")])
    return c.select("c_custkey", found["relation"].alias("relation"), F.round(found["confidence"], 6).alias("confidence"))


def superset_prune(spark, sf_dir):
    return _plan(spark, sf_dir, [(FORWARD, "ASIA")])


def positive_union(spark, sf_dir):
    return _plan(spark, sf_dir, [(BACKWARD, "NATION_2"), (BACKWARD, "NATION_2_7")])


def disjoint_elim(spark, sf_dir):
    return _plan(spark, sf_dir, [(DISJOINT, "EUROPE"), (DISJOINT, "NATION_3_4")])


def equiv_split(spark, sf_dir):
    """An equivalent view serves both ways: inside it assumed, outside it pruned."""
    uses = choose_views([(0, "a", Judgment("equiv", 0.95)), (1, "b", Judgment("overlap", 0.99)), (2, "c", Judgment("forward", 0.5))], RewriteConfig())
    corpus = corpora.customers(spark, sf_dir)
    return build_plan(corpus, uses, _view_rows(corpus, ["ASIA"])).rows


def multi_view_plan(spark, sf_dir):
    return _plan(spark, sf_dir, [(BACKWARD, "NATION_2"), (FORWARD, "ASIA_OR_EUROPE"), (FORWARD, "NOT_AFRICA"), (DISJOINT, "NATION_3_4")])


def conflict_demotion(spark, sf_dir):
    return _plan(spark, sf_dir, [(BACKWARD, "NATION_2_7"), (BACKWARD, "NATION_3_4"), (FORWARD, "ASIA"), (DISJOINT, "NATION_2")])


def view_ranking(spark, sf_dir):
    """Accepted uses of twelve judged views, ranked and cut to eight a rule."""
    uses = choose_views([(i, pid, Judgment(r, c)) for i, (pid, r, c) in enumerate(HOT_VIEWS)], RewriteConfig())
    return spark.createDataFrame([(i, u.rule, u.view_id, u.pid) for i, u in enumerate(uses)], "place int, rule string, view_id int, pid string")


def reported_mask(spark, sf_dir):
    corpus = corpora.customers(spark, sf_dir)
    plan = multi_view_plan(spark, sf_dir)
    asked = LabelOracle(corpus).answers(_predicate("ASIA"), plan.filter("role = 'candidate'"))
    return reported(plan, asked)


def stratum_sizes(spark, sf_dir):
    return multi_view_plan(spark, sf_dir).groupBy(F.coalesce("stratum", F.lit("candidates")).alias("stratum")).agg(F.count("*").alias("size"))


def hash_sample_pool(spark, sf_dir):
    rows = corpora.orders(spark, sf_dir).select("row_id", F.col("grp").alias("stratum"))
    return sample_pool(rows, DRAWN, 7, 3, "pruned").select("row_id", "stratum")


def hash_sample_strata(spark, sf_dir):
    rows = corpora.orders(spark, sf_dir).select("row_id", F.col("grp").alias("stratum"))
    return sample_strata(rows, SIZES, 7, 3, "assumed").select("row_id", "stratum")


def audit_attribution(spark, sf_dir):
    corpus = corpora.orders(spark, sf_dir)
    sample = sample_pool(corpus.select("row_id", F.col("grp").alias("stratum")), DRAWN, 7, 3, "pruned")
    asked = LabelOracle(corpus).answers(_predicate("NATION_2_7"), sample)
    return sample.join(asked, "row_id").groupBy("stratum").agg(F.count("*").alias("sampled"), F.count_if("answer").alias("positives"))


def sample_sizes(spark, sf_dir):
    config = audits.AuditConfig()
    rows = [(n, a, alpha, audits.assumed_size(config, n, alpha), audits.pool_size(config, n, a, alpha), audits.plain_size(audits.AuditConfig(mode="fraction"), n)) for n, a, alpha in ARITHMETIC_ROWS]
    return spark.createDataFrame(rows, "n long, allowance double, alpha double, assumed long, pool long, fraction long")


def hypergeom_bounds(spark, sf_dir):
    rows = [(n, m, k, a, bounds.upper_bound(n, m, k, a), bounds.lower_bound(n, m, k, a)) for n, m, k, a in BOUND_ROWS]
    return spark.createDataFrame(rows, "n int, m int, k int, alpha double, upper long, lower long")


def recall_precision_bounds(spark, sf_dir):
    per = corpora.customers(spark, sf_dir).groupBy("grp").agg(F.count_if(F.col("leaf").isin(list(VIEWS["NATION_2_7"]))).alias("found"), F.count("*").alias("n"))
    rows = [(r.grp, round(bounds.recall_bound(r.found, 3, r.n // 50), 9), round(bounds.precision_bound(r.found, 3, r.n // 40), 9)) for r in per.collect()]
    return spark.createDataFrame(rows, "grp string, recall_bound double, precision_bound double")


def escalation_order(spark, sf_dir):
    sizes = stratum_sizes(spark, sf_dir).filter("stratum <> 'candidates'").orderBy("stratum").collect()
    strata = [audits.Stratum(r.stratum, r.stratum.split(":")[0], r.size) for r in sizes]
    return spark.createDataFrame([(i, s.name, s.size) for i, s in enumerate(audits.escalation_order(strata, "size-desc"))], "place int, stratum string, size long")


def allowance_split(spark, sf_dir):
    share = audits.split_allowance(dict(SPLIT), 60.0, 0.01, audits.AuditConfig())
    return spark.createDataFrame([(k, round(v, 6)) for k, v in share.items()], "stratum string, share double")


def view_statistics(spark, sf_dir):
    engine = _engine(spark, corpora.customers(spark, sf_dir), audit=None)
    for n in ("ASIA", "NATION_2"):
        engine.query(_predicate(n))
    return engine.store.statistics().select(F.col("view_id").cast("int").alias("view_id"), "n_positive", "n_verified")


def view_lineage(spark, sf_dir):
    engine = _engine(spark, corpora.customers(spark, sf_dir), audit=None)
    for n in ("ASIA", "EUROPE", "NATION_2"):
        engine.query(_predicate(n))
    return engine.store.lineage()


def call_charges(spark, sf_dir):
    engine = _engine(spark, corpora.customers(spark, sf_dir), audit=None)
    for n in ("ASIA", "NATION_2"):
        engine.query(_predicate(n))
    return engine.log.charges()


def noise_flip(spark, sf_dir):
    keys = corpora.orders(spark, sf_dir).select("row_id")
    return keys.select("row_id", flip_column(F.col("row_id"), NOISE_TEXT, NOISE_SEED, NOISE_RATE).alias("flip"))


def answer_cache(spark, sf_dir):
    """Event users as rows of an append-only cache: the last answer of each cell."""
    return answers.latest_answers(_cache(spark, sf_dir)).select("claim", "row_id", "answer", "written")


def _cache(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.lit("m").alias("model"), F.lit("1").alias("pver"), F.col("o_orderpriority").alias("claim"), F.col("o_custkey").alias("row_id"), (F.col("o_orderkey") % 3 == 0).alias("answer"), F.lit(200).cast("long").alias("prompt_tokens"), F.lit(3).cast("long").alias("output_tokens"), F.col("o_orderkey").cast("string").alias("raw"), F.col("o_orderkey").alias("written"))


def missing_cells(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    return answers.missing_cells(cache.select("claim").distinct(), corpora.customers(spark, sf_dir), cache, "m", "1")


def incomplete_claims(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    return answers.incomplete_claims(_cache(spark, sf_dir), n)


def cosine_scores(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = e.filter("vec_id = 0").select(F.col("embedding").alias("query"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("query")), 5).alias("score"))  # one query vector


def embedding_cache_best(spark, sf_dir):
    """Every twentieth vector is a query; entries are all vectors before it."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("name"), F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    found = best_entries(e.filter("name % 20 = 0 AND name > 0"), e)
    return found.select(F.col("name"), F.col("entry"), F.round("similarity", 4).alias("similarity"))


def hash_embed_trigram(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    counts = n.select("n_nationkey", F.posexplode(text.trigram_counts(F.concat(F.lit("The row is about "), "n_name"), 64)).alias("slot", "n"))
    return counts.filter("n > 0").select("n_nationkey", "slot", F.col("n").cast("int").alias("n"))


def score_bands(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").cast("double").alias("score"))
    return proxy.score_bands(c, 4)


def proxy_cutoff(spark, sf_dir):
    """The quantile that a cutoff is taken from, per segment."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.groupBy("c_mktsegment").agg(F.round(F.percentile(F.col("c_acctbal").cast("double"), 0.05), 6).alias("cutoff"), F.round(F.avg((F.col("c_acctbal") >= 0).cast("double")), 6).alias("kept"))


def pilot_cutoff(spark, sf_dir):
    """The score below which customers may go, by a pilot of all of them."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    pilot = c.select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").cast("double").alias("score"), ((F.col("c_acctbal") > 3000) & (F.col("c_custkey") % 3 == 0)).alias("answer"))
    cutoff = proxy.choose_cutoff(pilot)
    return spark.createDataFrame([] if cutoff is None else [(round(cutoff, 6),)], "cutoff double")


def embed_texts(spark, sf_dir):
    """Unit vectors of the turns of conversations, their slots that are not zero."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    slots = turns.select("conv_id", "turn", F.posexplode(proxy.HashingEmbedder(64).column(F.col("text"))).alias("slot", "value"))
    return slots.filter("value > 0").select("conv_id", "turn", "slot", F.round("value", 6).alias("value"))


def proxy_cascade(spark, sf_dir):
    """Calls of a query behind a trained proxy (no twin: a fitted model decides them)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("leaf"))
    mean = e.filter("label = 1").select(F.posexplode("embedding")).groupBy("pos").agg(F.avg("col").alias("x")).orderBy("pos")  # a question's vector
    centre = [r.x for r in mean.collect()]
    rows = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    engine = _engine(spark, corpus, proxy=proxy.ProxyCascade(proxy.EmbeddingProxy(rows, lambda t: centre)))
    done = engine.query(Predicate("The vector has label 1.", frozenset({"1"}), "label 1"))
    return spark.createDataFrame([(k, v) for k, v in sorted(done.calls.items())], "tag string, calls long")


def calibrated_head(spark, sf_dir):
    """Predicted relations of labelled pairs by a fitted head (no twin: a fitted model)."""
    pairs = relation_setalgebra(spark, sf_dir)
    h = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1000)) / 1000.0
    e_f = F.when(F.col("relation").isin("forward", "equiv"), 0.8).otherwise(0.1) + 0.1 * h("p", "q")
    e_b = F.when(F.col("relation").isin("backward", "equiv"), 0.8).otherwise(0.1) + 0.1 * h("q", "p")
    features = pairs.select("p", "q", "relation", F.array(e_f, e_b, F.when(F.col("relation") == "disjoint", 0.9).otherwise(0.1).cast("double")).alias("features"))
    return reasoners.predict_calibrated(reasoners.fit_calibrated(features), features).select("p", "q", "relation", "predicted", F.round("confidence", 6).alias("confidence"))


def slack_rates(spark, sf_dir):
    model = SlackModel()
    for kind, source, x, y, w in SEEN:
        model.observe(Observation(kind, source, x, y, w))
    return spark.createDataFrame([(k, s, round(model.rate(k, s), 9)) for k, s in sorted({(r[0], r[1]) for r in SEEN})], "kind string, source string, rate double")


def slack_admit(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in admit(list(OFFERS), 0.05)], "taken string")


def metrics_prf(spark, sf_dir):
    corpus = corpora.orders(spark, sf_dir)
    scored = corpus.select("grp", F.col("leaf").isin(list(VIEWS["ASIA_OR_EUROPE"])).alias("reported"), (F.col("leaf").isin(list(VIEWS["NOT_AFRICA"])) & (F.col("row_id") % 7 != 0)).alias("truth"))
    out = metrics.precision_recall(scored, "grp")
    return out.select("grp", "tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _certified(spark) -> DataFrame:
    return spark.createDataFrame(list(CERTIFIED), "method string, calls long, precision double, recall double, recall_bound double, precision_bound double, tp long, n_true long, n_reported long")


def workload_summary(spark, sf_dir):
    out = metrics.summarize(_certified(spark))
    return out.select("method", "queries", "calls", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "certificates", "recall_violations", "precision_violations", F.round("mean_recall_bound", 9).alias("mean_recall_bound"))


def certificate_shortfall(spark, sf_dir):
    return metrics.shortfall(_certified(spark)).select("method", "calls", F.col("recall_short").cast("long").alias("recall_short"), F.col("precision_short").cast("long").alias("precision_short"))


def _judged(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    names = F.array(*[F.lit(r) for r in ("equiv", "forward", "backward", "disjoint", "overlap")])
    pick = lambda k: F.element_at(names, (F.col("o_orderkey") * k % 5 + 1).cast("int"))
    return o.select(pick(3).alias("relation"), F.when(F.col("o_custkey") % 4 == 0, pick(7)).otherwise(pick(3)).alias("predicted"), ((F.col("o_custkey") % 101) / 100).alias("confidence"))


def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_judged(spark, sf_dir))


def relation_scores(spark, sf_dir):
    return metrics.relation_scores(_judged(spark, sf_dir)).select("of", "tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def arbiter_trust(spark, sf_dir):
    return reasoners.arbiter_trust(_judged(spark, sf_dir)).select("predicted", F.round("confidence", 9).alias("confidence"))


def pair_accuracy(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    names = F.array(*[F.lit(r) for r in ("equiv", "forward", "backward", "disjoint", "overlap")])
    pick = lambda k: F.element_at(names, (F.col("o_orderkey") * k % 5 + 1).cast("int"))
    told = o.select(pick(3).alias("relation"), F.when(F.col("o_custkey") % 4 == 0, pick(7)).otherwise(pick(3)).alias("predicted"), (F.col("o_custkey") % 3 == 0).alias("escalated"))
    return metrics.pair_accuracy(told).select("escalated", "pairs", F.round("accuracy", 9).alias("accuracy"))


def unit_cost(spark, sf_dir):
    """Orders as runs of a model."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = o.select(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 7).alias("calls"), (F.col("o_orderkey") % 11 / 10).alias("seconds"), (F.col("o_custkey") % 300).alias("prompt_tokens"), (F.col("o_custkey") % 5).alias("output_tokens"))
    return metrics.unit_cost(runs).select("model", "calls", F.round("tokens_a_call", 6).alias("tokens_a_call"), F.round("calls_a_second", 6).alias("calls_a_second"), F.round("dollars_a_call", 12).alias("dollars_a_call"))


def host_comparison(spark, sf_dir):
    """Calls of a host's filter over customers by region, alone and behind cached answers of every third order."""
    corpus = corpora.customers(spark, sf_dir)
    alone = corpus.groupBy(F.col("grp").alias("query")).agg(F.count("*").alias("calls"))
    reused = corpus.groupBy(F.col("grp").alias("query")).agg(F.count_if(F.col("row_id") % 3 != 0).alias("calls"))
    return metrics.host_comparison(alone, reused).select("query", "alone", "reused", F.round("saved", 9).alias("saved"))


def calibration_ece(spark, sf_dir):
    judged = _judged(spark, sf_dir).withColumn("correct", F.col("relation") == F.col("predicted"))
    return metrics.calibration_error(judged).select(F.round("ece", 9).alias("ece"))


def reliability_bins(spark, sf_dir):
    judged = _judged(spark, sf_dir).withColumn("correct", F.col("relation") == F.col("predicted"))
    return metrics.reliability(judged).select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


def oracle_agreement_kappa(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("row_id"))
    told = o.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col("row_id") % k == 0).alias("answer")) for m, k in (("a", 2), ("b", 3), ("c", 4))])).alias("m"), "text", "row_id").select("m.model", "text", "row_id", "m.answer")
    return metrics.agreement(told).select("model_a", "model_b", "n", *[F.round(c, 9).alias(c) for c in ("agreement", "kappa", "jaccard")])


def run_agreement(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("query"), F.col("o_orderkey").alias("row_id"))
    one, other = o.withColumn("answer", F.col("row_id") % 3 == 0), o.withColumn("answer", (F.col("row_id") % 3 == 0) & (F.col("row_id") % 5 != 0))
    return metrics.run_agreement(one, other).select("query", F.round("agreement", 9).alias("agreement"), F.round("flipped", 9).alias("flipped"))


def predecessor_fractions(spark, sf_dir):
    sets = _named_sets(spark, sf_dir)
    order = F.row_number().over(Window.orderBy("name"))  # thirty stated predicates
    return metrics.predecessors(sets.select(order.alias("position"), F.col("name").alias("key"), "labels"))


def implication_slack(spark, sf_dir):
    declared = spark.createDataFrame(list(DECLARED), "a string, b string")
    return metrics.implication_slack(declared, _extensions(spark, sf_dir)).select("a", "b", *[F.round(c, 9).alias(c) for c in ("slack", "reverse_slack", "jaccard")])


def implication_summary(spark, sf_dir):
    return metrics.slack_summary(implication_slack(spark, sf_dir)).select("n", "exact", *[F.round(c, 6).alias(c) for c in ("median", "mean", "largest")], "near")


def paired_ratios(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = o.select((F.col("o_orderkey") % 2).alias("rep"), F.floor(F.col("o_orderkey") / 4).alias("query"), F.when(F.col("o_orderkey") % 4 < 2, "host").otherwise("reuse").alias("arm"), (F.col("o_custkey") % 5 == 0).cast("int").alias("retries"), F.col("o_totalprice").cast("double").alias("seconds"))
    return metrics.paired_ratios(runs, "reuse", "host", "seconds").select("rep", "pairs", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "of_sums")])


def compare_tables(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_nationkey").cast("double").alias("c_nationkey"))
    other = c.filter("c_custkey % 10 <> 3").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return metrics.compare_results(c, other, ["c_custkey"], ["c_acctbal", "c_nationkey"]).select("c_custkey", "column", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"))


def stratified_subsample(spark, sf_dir):
    return corpora.stratified_sample(corpora.customers(spark, sf_dir), 100, 25, 5).select("row_id", "leaf")


def uniform_subsample(spark, sf_dir):
    return corpora.uniform_sample(corpora.customers(spark, sf_dir), 50, 5).select("row_id")


def document_labels(spark, sf_dir):
    return corpora.labelled_documents(spark, sf_dir).select("row_id", F.concat_ws(",", "labels").alias("labels"))


def frequent_labels(spark, sf_dir):
    kept = corpora.frequent_labels(corpora.labelled_documents(spark, sf_dir), 60)
    return kept.select("row_id", F.concat_ws(",", "labels").alias("labels"))


def parent_codes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    codes = docs.select(F.explode(F.array("source", F.substring("source", 1, 3), F.concat("lang", F.lit("x")), F.upper("lang"))).alias("code")).distinct()
    return corpora.parent_codes(codes, {"s": "SRC", "e": "ECAT"})


def _hierarchy(spark, sf_dir) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("label"), F.col("r_name").alias("parent"))
    roots = region.select(F.col("r_name").alias("label"), F.lit("WORLD").alias("parent"))
    return up.union(roots).union(spark.createDataFrame([("WORLD", None)], "label string, parent string"))


def hierarchy_descendants(spark, sf_dir):
    return corpora.descendants(_hierarchy(spark, sf_dir))


def selectivity(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    return _extensions(spark, sf_dir).groupBy("name").agg(F.round(F.count("*") / F.lit(n), 9).alias("selectivity"))


def taxonomy(spark, sf_dir) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("leaf"), F.col("r_name").alias("grp"))  # 5 regions


def predicate_universe(spark, sf_dir):
    return workloads.universe(taxonomy(spark, sf_dir)).select("kind", "name", F.col("wording").cast("int").alias("wording"), "text", F.concat_ws(",", "labels").alias("labels"))


def relation_pairs(spark, sf_dir):
    """As many ordered pairs of the universe for each relation, by hash."""
    return workloads.labelled_pairs(workloads.universe(taxonomy(spark, sf_dir)), 40, 3)


def session_workload(spark, sf_dir):
    return workloads.sessions(taxonomy(spark, sf_dir), 60, 5).select("position", "kind", "name", "wording", "text")


def two_tier_judge(spark, sf_dir):
    """Relations measured on customers, and those of the label sets where a measurement is of no use."""
    measured = relation_extensional(spark, sf_dir).select("p", "q", "relation", F.lit(0.9).alias("confidence"))
    return reasoners.two_tier_relations(measured, relation_setalgebra(spark, sf_dir).select("p", "q", "relation", F.lit(0.99).alias("confidence")))


def distinct_texts(spark, sf_dir):
    """Questions that have one normal form: how often, and where first."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user' AND text IS NOT NULL")
    return turns.groupBy(text.normal_form(F.col("text")).alias("norm")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


def hierarchy_roots(spark, sf_dir):
    return corpora.roots_of(_hierarchy(spark, sf_dir))


def hierarchy_children(spark, sf_dir):
    return corpora.children_of(_hierarchy(spark, sf_dir)).select("label", F.concat_ws(",", "children").alias("children"))


QUERIES = (
    cold_filter, exact_hit, certified_query, certified_workload, exact_cache_calls, normalize_text, predicate_pid, clean_documents, whole_documents, yes_no_parse, token_cost,
    relation_setalgebra, relation_extensional, relation_mix, threshold_head, superset_prune, positive_union, disjoint_elim, equiv_split, multi_view_plan,
    conflict_demotion, view_ranking, reported_mask, stratum_sizes, hash_sample_pool, hash_sample_strata, audit_attribution, sample_sizes, hypergeom_bounds,
    recall_precision_bounds, escalation_order, allowance_split, view_statistics, view_lineage, call_charges, noise_flip, answer_cache, missing_cells,
    incomplete_claims, cosine_scores, embedding_cache_best, hash_embed_trigram, score_bands, proxy_cutoff, proxy_cascade, calibrated_head, slack_rates,
    slack_admit, metrics_prf, workload_summary, certificate_shortfall, confusion_matrix, relation_scores, arbiter_trust, calibration_ece, reliability_bins,
    oracle_agreement_kappa, run_agreement, predecessor_fractions, implication_slack, implication_summary, paired_ratios, compare_tables,
    stratified_subsample, uniform_subsample, document_labels, frequent_labels, parent_codes, hierarchy_descendants, selectivity,
    predicate_universe, relation_pairs, session_workload, two_tier_judge, distinct_texts, hierarchy_roots, hierarchy_children, pilot_cutoff, embed_texts, pair_accuracy, unit_cost, host_comparison,
)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return dict(twins.SQL)
