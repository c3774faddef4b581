"""DuckDB twins of the registered queries, and the constants that both sides share."""

from __future__ import annotations

import hashlib

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
#: Nations lie in region (key modulo five).
REGION_NATIONS = {r: tuple(f"NATION_{n}" for n in range(25) if n % 5 == i) for i, r in enumerate(REGIONS)}
#: Nations that stated predicates hold for.
VIEWS = {
    **REGION_NATIONS,
    "NATION_2": ("NATION_2",),
    "NATION_2_7": ("NATION_2", "NATION_7"),
    "NATION_3_4": ("NATION_3", "NATION_4"),
    "ASIA_OR_EUROPE": REGION_NATIONS["ASIA"] + REGION_NATIONS["EUROPE"],
    "NOT_AFRICA": tuple(n for r in REGIONS[1:] for n in REGION_NATIONS[r]),
}
NOISE_TEXT, NOISE_SEED, NOISE_RATE = "The row is about ASIA.", 11, 0.05
DRAWN = 500
SIZES = {"ASIA": 40, "EUROPE": 7, "AFRICA": 100}
ARITHMETIC_ROWS = tuple((n, a, alpha) for n in (5, 50, 1_000, 60_000) for a in (0.5, 3.0, 80.0, 100_000.0) for alpha in (0.05, 0.0125, 0.001))
BOUND_ROWS = tuple((n, m, k, alpha) for n, m in ((30, 10), (80, 20), (150, 60), (150, 150)) for k in (0, 1, 4) for alpha in (0.05, 0.01))
SPLIT = {"a": 900, "b": 2500, "c": 40000, "d": 6400}
SEEN = (("forward", "p1", 0.5, 0.02, 100.0), ("forward", "p2", 0.25, 0.1, 40.0), ("disjoint", "p1", 0.8, 0.0, 300.0), ("forward", "p1", 0.9, 0.3, 0.0), ("disjoint", "p3", 1.5, -0.2, 10.0))
OFFERS = (("a", 1000, 0.01), ("b", 4000, 0.03), ("c", 500, 0.0), ("d", 900, 0.02), ("e", 10, 0.001))
HOT_VIEWS = tuple((f"p{i:02d}", r, c) for i, (r, c) in enumerate((("forward", 0.9), ("forward", 0.8), ("forward", 0.79), ("equiv", 0.85), ("backward", 0.9), ("backward", 0.89), ("disjoint", 0.95), ("disjoint", 0.2), ("overlap", 0.99), ("forward", 0.9), ("equiv", 0.99), ("backward", 0.97))))
CERTIFIED = (
    ("cold", 1000, 1.0, 1.0, None, None, 40, 40, 40),
    ("reuse", 300, 0.99, 0.95, 0.9, 0.95, 38, 40, 39),
    ("reuse", 250, 0.9, 0.88, 0.9, 0.97, 35, 40, 39),
    ("reuse", 0, 1.0, 0.97, 0.92, None, 39, 40, 39),
)
DECLARED = (("NATION_2", "ASIA"), ("NATION_2", "EUROPE"), ("ASIA", "NATION_7"), ("BUILDING", "ASIA"), ("nowhere", "ASIA"))


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


CUST = "(SELECT c_custkey AS row_id, n_name AS leaf, r_name AS grp, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
ORD = f"(SELECT o_orderkey AS row_id, leaf, grp FROM orders JOIN {CUST} c ON o_custkey = c.row_id)"
SETS = "(SELECT n_name AS name, [n_name] AS labels FROM nation UNION ALL SELECT r_name, list_sort(list(n_name)) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)"
RELATION = "CASE WHEN list_has_all({q}, {p}) AND list_has_all({p}, {q}) THEN 'equiv' WHEN list_has_all({q}, {p}) THEN 'forward' WHEN list_has_all({p}, {q}) THEN 'backward' WHEN NOT list_has_any({p}, {q}) THEN 'disjoint' ELSE 'overlap' END"
EXT = f"(SELECT leaf AS name, row_id FROM {CUST} UNION ALL SELECT grp, row_id FROM {CUST} UNION ALL SELECT c_mktsegment, row_id FROM {CUST})"
COUNTS = f"""(SELECT x.name AS p, y.name AS q, x.n AS n_p, y.n AS n_q, coalesce(z.c, 0) AS n_both
FROM (SELECT name, count(DISTINCT row_id) AS n FROM {EXT} GROUP BY 1) x JOIN (SELECT name, count(DISTINCT row_id) AS n FROM {EXT} GROUP BY 1) y ON x.name <> y.name
LEFT JOIN (SELECT a.name AS p, b.name AS q, count(*) AS c FROM {EXT} a JOIN {EXT} b USING (row_id) GROUP BY 1, 2) z ON z.p = x.name AND z.q = y.name)"""
EXTENSIONAL = f"""(SELECT p, q, n_p, n_q, n_both,
CASE WHEN (n_p - n_both) / n_p <= 0.02 AND (n_q - n_both) / n_q <= 0.02 THEN 'equiv' WHEN (n_p - n_both) / n_p <= 0.02 THEN 'forward' WHEN (n_q - n_both) / n_q <= 0.02 THEN 'backward'
WHEN n_both / least(n_p, n_q) <= 0.02 THEN 'disjoint' ELSE 'overlap' END AS relation FROM {COUNTS})"""


def _plan(uses: list[tuple[str, str]]) -> str:
    """Plan over customers by a CASE of memberships, conflicts first."""
    holds = [f"leaf {'NOT IN' if rule == 'forward' else 'IN'} {_in(VIEWS[name])}" for rule, name in uses]
    inside = [h for h, (rule, _) in zip(holds, uses, strict=True) if rule == "backward"]
    against = [h for h, (rule, _) in zip(holds, uses, strict=True) if rule != "backward"]
    whens = [f"WHEN ({' OR '.join(inside)}) AND ({' OR '.join(against)}) THEN NULL"] if inside and against else []
    whens += [f"WHEN {h} THEN '{rule}:{i}'" for i, (h, (rule, _)) in enumerate(zip(holds, uses, strict=True))]
    return f"(SELECT row_id, leaf, CASE {' '.join(whens)} END AS stratum FROM {CUST})"


ROLE = "CASE WHEN stratum IS NULL THEN 'candidate' WHEN starts_with(stratum, 'backward:') THEN 'assumed' ELSE 'pruned' END"
MULTI = [("backward", "NATION_2"), ("forward", "ASIA_OR_EUROPE"), ("forward", "NOT_AFRICA"), ("disjoint", "NATION_3_4")]


def plan_sql(uses: list[tuple[str, str]]) -> str:
    return f"SELECT row_id, {ROLE} AS role, stratum FROM {_plan(uses)}"


def _sample_key(phase: str, stratum: str, seed: int = 7, query: int = 3) -> str:
    return f"md5('{seed}|{query}|{phase}|' || {stratum} || '|' || row_id)"


def _values(rows, names: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") v({names}))"


def _certified() -> str:
    return _values(CERTIFIED, "method, calls, precision, recall, recall_bound, precision_bound, tp, n_true, n_reported")


CACHE = "(SELECT o_orderpriority AS claim, o_custkey AS row_id, o_orderkey % 3 = 0 AS answer, o_orderkey AS written FROM orders)"
JUDGED = "(SELECT ['equiv','forward','backward','disjoint','overlap'][o_orderkey * 3 % 5 + 1] AS relation, CASE WHEN o_custkey % 4 = 0 THEN ['equiv','forward','backward','disjoint','overlap'][o_orderkey * 7 % 5 + 1] ELSE ['equiv','forward','backward','disjoint','overlap'][o_orderkey * 3 % 5 + 1] END AS predicted, (o_custkey % 101) / 100 AS confidence FROM orders)"
LABELS = "(SELECT doc_id AS row_id, list_sort(list_filter(['lang:' || lang, 'source:' || source, 'quality:' || quality, 'toxic:' || toxic], lambda x: x IS NOT NULL)) AS labels FROM documents LEFT JOIN labels USING (doc_id))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_BASE = int.from_bytes(hashlib.sha1(f"{NOISE_TEXT}|{NOISE_SEED}".encode()).digest()[:8], "big")
_WRAP = "18446744073709551616::UHUGEINT"


def _mix() -> str:
    """Fixed values of the noise mix in 128-bit arithmetic modulo 2^64."""
    m1, m2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
    start = f"SELECT row_id, ((((row_id::UHUGEINT + {_BASE}::UHUGEINT) % {_WRAP}) * {m1}::UHUGEINT) % {_WRAP}) AS a FROM {ORD}"
    one = f"SELECT row_id, (xor(a::UBIGINT, (a::UBIGINT >> 31))::UHUGEINT * {m2}::UHUGEINT) % {_WRAP} AS b FROM ({start})"
    return f"SELECT row_id, (xor(b::UBIGINT, (b::UBIGINT >> 27)) >> 11)::DOUBLE / 9007199254740992 < {NOISE_RATE} AS flip FROM ({one})"


def _bounds() -> str:
    choose = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
    term = f"exp({choose('t', 'i')} + {choose('(n - t)', '(m - i)')} - {choose('n', 'm')})"
    return f"""WITH r AS {_values(BOUND_ROWS, "n, m, k, alpha")},
t AS (SELECT *, unnest(range(k, n - (m - k) + 1)) AS t FROM r),
i AS (SELECT *, unnest(range(greatest(0, m - (n - t)), least(m, t) + 1)) AS i FROM t),
p AS (SELECT n, m, k, alpha, t, sum(CASE WHEN i <= k THEN {term} ELSE 0 END) AS below, sum(CASE WHEN i >= k THEN {term} ELSE 0 END) AS above FROM i GROUP BY ALL)
SELECT n, m, k, alpha, CASE WHEN m >= n THEN k ELSE max(t) FILTER (below > alpha - 1e-12) END AS upper, CASE WHEN m >= n THEN k ELSE min(t) FILTER (above > alpha - 1e-12) END AS lower FROM p GROUP BY n, m, k, alpha"""


def _slack() -> str:
    clean = f"(SELECT kind, source, least(x, 1) AS x, least(greatest(y, 0), 1) AS y, w FROM {_values(SEEN, 'kind, source, x, y, w')} WHERE w > 0 AND x > 0)"
    sums = lambda by: f"(SELECT {by + ', ' if by else ''}sum(w * x * y) AS xy, sum(w * x * x) AS xx FROM {clean} {'GROUP BY ' + by if by else ''})"
    return f"""SELECT s.kind, s.source, round((s.xy + 0.05 * (k.xy + 0.05 * (g.xy + 0.05 * 0.05) / (g.xx + 0.05)) / (k.xx + 0.05)) / (s.xx + 0.05), 9) AS rate
FROM {sums('kind, source')} s JOIN {sums('kind')} k USING (kind), {sums('')} g"""


def _admit() -> str:
    ranked = f"(SELECT key, slack, row_number() OVER (ORDER BY n / greatest(slack, 0.002) DESC, key) AS place FROM {_values(OFFERS, 'key, n, slack')})"
    return f"""WITH RECURSIVE o AS {ranked}, g AS (SELECT 0 AS place, 0.0::DOUBLE AS spent, NULL::VARCHAR AS taken UNION ALL
SELECT o.place, g.spent + CASE WHEN g.spent + o.slack <= 0.05 THEN o.slack ELSE 0 END, CASE WHEN g.spent + o.slack <= 0.05 THEN o.key END FROM g JOIN o ON o.place = g.place + 1)
SELECT taken FROM g WHERE taken IS NOT NULL"""


def _prf(source: str, by: str) -> str:
    """Precision, recall and F1 with their conventions for empty sides; the rounding is the query's."""
    counts = f"(SELECT {by}, count(*) FILTER (reported AND truth) AS tp, count(*) FILTER (reported) AS a, count(*) FILTER (truth) AS b FROM {source} GROUP BY 1)"
    pr = f"(SELECT {by}, tp, CASE WHEN a = 0 THEN 1 ELSE tp / a END AS p, CASE WHEN b = 0 THEN 1 ELSE tp / b END AS r FROM {counts})"
    return f"SELECT {by}, tp, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM {pr}"


TRUTH = lambda name: f"leaf IN {_in(VIEWS[name])}"
_clean = "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ +| +$', '', 'g')"
_reply = "['Yes, ', ' no.', 'true ', '''FALSE'' ', '', 'well yes '][turn % 6 + 1] || coalesce(text, '')"
_bare = f"regexp_replace(lower(trim({_reply})), '^[\\s\"''.`*(\\[]+|[\\s\"''.`*)\\]]+$', '', 'g')"

SQL = {
    "cold_filter": f"SELECT row_id, {TRUTH('ASIA')} AS answer FROM {ORD}",
    "exact_hit": f"SELECT row_id, {TRUTH('ASIA')} AS reported FROM {CUST}",
    "certified_query": f"SELECT row_id, {TRUTH('NATION_2')} AS reported FROM {CUST}",
    "exact_cache_calls": "SELECT * FROM (SELECT unnest([0, 1, 2]) AS position, unnest(['cold', 'cold', 'exact-hit']) AS reuse, unnest([n, n, 0]) AS calls FROM (SELECT count(*) AS n FROM customer))",
    "normalize_text": "SELECT doc_id, trim(regexp_replace(translate(lower(text), '.,', '  '), '\\s+', ' ', 'g')) AS norm FROM documents",
    "predicate_pid": "SELECT doc_id, substr(sha1(text), 1, 12) AS pid FROM documents",
    "clean_documents": f"SELECT doc_id AS row_id, substr({_clean}, 1, 2000) AS text FROM documents WHERE length(substr({_clean}, 1, 2000)) >= 50",
    "whole_documents": f"SELECT doc_id AS row_id, {_clean} AS text FROM documents WHERE length({_clean}) >= 50",
    "yes_no_parse": f"SELECT conv_id, turn, CASE WHEN regexp_matches(b, '^(yes|true)') THEN true WHEN regexp_matches(b, '^(no|false)') THEN false ELSE contains(b, 'yes') END AS answer FROM (SELECT conv_id, turn, {_bare} AS b FROM conversations)",
    "token_cost": "SELECT conv_id, round(coalesce(sum(length(text)) FILTER (role = 'user'), 0) * (0.15 / 1e6) + coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) * (0.60 / 1e6), 9) AS dollars FROM conversations GROUP BY 1",
    "relation_setalgebra": f"SELECT p.name AS p, q.name AS q, {RELATION.format(p='p.labels', q='q.labels')} AS relation FROM {SETS} p JOIN {SETS} q ON p.name <> q.name",
    "relation_extensional": f"SELECT * FROM {EXTENSIONAL}",
    "relation_mix": f"SELECT relation, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM {EXTENSIONAL} GROUP BY 1",
    "threshold_head": """WITH f AS (SELECT c_custkey, (c_custkey * 7 % 101) / 100 AS c_f, (c_custkey * 13 % 101) / 100 AS e_f, (c_custkey * 29 % 101) / 100 AS c_b, (c_custkey * 53 % 101) / 100 AS e_b FROM customer)
SELECT c_custkey, CASE WHEN e_f >= 0.7 AND e_b >= 0.7 THEN 'equiv' WHEN e_f >= 0.7 THEN 'forward' WHEN e_b >= 0.7 THEN 'backward' WHEN greatest(c_f, c_b) >= 0.7 THEN 'disjoint' ELSE 'overlap' END AS relation,
round(CASE WHEN e_f >= 0.7 AND e_b >= 0.7 THEN least(e_f, e_b) WHEN e_f >= 0.7 THEN e_f WHEN e_b >= 0.7 THEN e_b WHEN greatest(c_f, c_b) >= 0.7 THEN greatest(c_f, c_b) ELSE 1 - greatest(e_f, e_b, c_f, c_b) END, 6) AS confidence FROM f""",
    "superset_prune": plan_sql([("forward", "ASIA")]),
    "positive_union": plan_sql([("backward", "NATION_2"), ("backward", "NATION_2_7")]),
    "disjoint_elim": plan_sql([("disjoint", "EUROPE"), ("disjoint", "NATION_3_4")]),
    "equiv_split": f"SELECT row_id, CASE WHEN {TRUTH('ASIA')} THEN 'assumed' ELSE 'pruned' END AS role, CASE WHEN {TRUTH('ASIA')} THEN 'backward:0' ELSE 'forward:0' END AS stratum FROM {CUST}",
    "multi_view_plan": plan_sql(MULTI),
    "conflict_demotion": plan_sql([("backward", "NATION_2_7"), ("backward", "NATION_3_4"), ("forward", "ASIA"), ("disjoint", "NATION_2")]),
    "view_ranking": f"""WITH v AS (SELECT *, row_number() OVER () - 1 AS view_id FROM {_values(HOT_VIEWS, 'pid, relation, c')}),
s AS (SELECT v.*, r.rule, r.o FROM v JOIN (VALUES ('backward', 0), ('forward', 1), ('disjoint', 2)) r(rule, o) ON r.rule = v.relation OR (v.relation = 'equiv' AND r.rule <> 'disjoint')
WHERE c >= CASE relation WHEN 'equiv' THEN 0.8 WHEN 'forward' THEN 0.8 ELSE 0.9 END),
k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY c DESC, pid) AS nth FROM s)
SELECT row_number() OVER (ORDER BY o, nth) - 1 AS place, rule, view_id, pid FROM k WHERE nth <= 8""",
    "reported_mask": f"SELECT row_id, CASE WHEN stratum IS NULL THEN {TRUTH('ASIA')} ELSE starts_with(stratum, 'backward:') END AS reported FROM {_plan(MULTI)}",
    "stratum_sizes": f"SELECT coalesce(stratum, 'candidates') AS stratum, count(*) AS size FROM {_plan(MULTI)} GROUP BY 1",
    "hash_sample_pool": f"SELECT row_id, grp AS stratum FROM {ORD} ORDER BY {_sample_key('pruned', chr(39) * 2)}, row_id LIMIT {DRAWN}",
    "hash_sample_strata": f"SELECT row_id, grp AS stratum FROM {ORD} WHERE grp IN {_in(tuple(SIZES))} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {_sample_key('assumed', 'grp')}, row_id) <= CASE grp {' '.join(f'WHEN {chr(39)}{g}{chr(39)} THEN {n}' for g, n in SIZES.items())} END",
    "audit_attribution": f"SELECT stratum, count(*) AS sampled, count(*) FILTER ({TRUTH('NATION_2_7')}) AS positives FROM (SELECT grp AS stratum, leaf FROM {ORD} ORDER BY {_sample_key('pruned', chr(39) * 2)}, row_id LIMIT {DRAWN}) GROUP BY 1",
    "sample_sizes": f"""SELECT n, allowance, alpha, CASE WHEN n <= 10 THEN n ELSE least(n, 4000, greatest(20, ceil(ln(alpha) / ln(0.9))::BIGINT)) END AS assumed,
CASE WHEN n <= 10 OR allowance < 1 THEN n WHEN allowance >= n THEN least(n, 20) ELSE least(n, 4000, greatest(20, ceil(ln(alpha) / ln(1 - allowance / n))::BIGINT)) END AS pool,
CASE WHEN n <= 10 THEN n ELSE least(n, 4000, greatest(20, ceil(0.1 * n)::BIGINT)) END AS fraction FROM {_values(ARITHMETIC_ROWS, 'n, allowance, alpha')}""",
    "hypergeom_bounds": _bounds(),
    "recall_precision_bounds": f"""SELECT grp, round(CASE WHEN f + 3 + n // 50 = 0 THEN 1 ELSE (f + 3) / (f + 3 + n // 50) END, 9) AS recall_bound, round(CASE WHEN f + n // 40 = 0 THEN 1 ELSE least(1, (f + 3) / (f + n // 40)) END, 9) AS precision_bound
FROM (SELECT grp, count(*) FILTER ({TRUTH('NATION_2_7')}) AS f, count(*) AS n FROM {CUST} GROUP BY 1)""",
    "escalation_order": f"SELECT row_number() OVER (ORDER BY size DESC, stratum) - 1 AS place, stratum, size FROM (SELECT stratum, count(*) AS size FROM {_plan(MULTI)} WHERE stratum IS NOT NULL GROUP BY 1)",
    "allowance_split": f"SELECT k AS stratum, round(60.0 * sqrt(n) / sum(sqrt(n)) OVER (), 6) AS share FROM {_values(tuple(SPLIT.items()), 'k, n')}",
    "view_statistics": f"SELECT unnest([0, 1]) AS view_id, unnest([a, b]) AS n_positive, unnest([n, a]) AS n_verified FROM (SELECT count(*) AS n, count(*) FILTER ({TRUTH('ASIA')}) AS a, count(*) FILTER ({TRUTH('NATION_2')}) AS b FROM {CUST})",
    "view_lineage": "SELECT * FROM (SELECT unnest([1, 2, 2]) AS view_id, unnest([substr(sha1('The row is about EUROPE.'), 1, 12), substr(sha1('The row is about NATION_2.'), 1, 12), substr(sha1('The row is about NATION_2.'), 1, 12)]) AS pid, unnest([substr(sha1('The row is about ASIA.'), 1, 12), substr(sha1('The row is about ASIA.'), 1, 12), substr(sha1('The row is about EUROPE.'), 1, 12)]) AS source_pid)",
    "call_charges": f"SELECT unnest([0, 1]) AS query_index, 'candidates' AS tag, unnest([n, a]) AS calls FROM (SELECT count(*) AS n, count(*) FILTER ({TRUTH('ASIA')}) AS a FROM {CUST})",
    "noise_flip": _mix(),
    "answer_cache": f"SELECT claim, row_id, answer, written FROM {CACHE} QUALIFY row_number() OVER (PARTITION BY claim, row_id ORDER BY written DESC) = 1",
    "missing_cells": f"SELECT row_id, claim FROM {CUST} c, (SELECT DISTINCT claim FROM {CACHE}) k WHERE NOT EXISTS (SELECT 1 FROM {CACHE} x WHERE x.claim = k.claim AND x.row_id = c.row_id)",
    "incomplete_claims": f"SELECT claim, count(DISTINCT row_id) AS answered FROM {CACHE} GROUP BY 1 HAVING count(DISTINCT row_id) < (SELECT count(*) FROM customer)",
    "cosine_scores": f"SELECT e.vec_id, round({DOT.format(a='e.embedding', b='q.embedding')}, 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q",
    "embedding_cache_best": f"""WITH s AS (SELECT q.vec_id AS name, e.vec_id AS entry, round({DOT.format(a='q.embedding', b='e.embedding')} / (sqrt({DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({DOT.format(a='e.embedding', b='e.embedding')})), 6) AS s
FROM embeddings q JOIN embeddings e ON e.vec_id < q.vec_id WHERE q.vec_id % 20 = 0 AND q.vec_id > 0)
SELECT name, entry, round(s, 4) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY s DESC, entry) = 1""",
    "hash_embed_trigram": "SELECT n_nationkey, slot, count(*) AS n FROM (SELECT n_nationkey, ('0x' || substr(md5(substr(t, i, 3)), 1, 8))::BIGINT % 64 AS slot FROM (SELECT n_nationkey, lower('The row is about ' || n_name) AS t, unnest(range(1, greatest(length('The row is about ' || n_name) - 2, 1) + 1)) AS i FROM nation)) GROUP BY 1, 2",
    "score_bands": "SELECT c_custkey AS row_id, (c_acctbal < q[1])::INT + (c_acctbal < q[2])::INT + (c_acctbal < q[3])::INT AS band FROM customer, (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer)",
    "proxy_cutoff": "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.05), 6) AS cutoff, round(avg((c_acctbal >= 0)::INT), 6) AS kept FROM customer GROUP BY 1",
    "slack_rates": _slack(),
    "slack_admit": _admit(),
    "metrics_prf": _prf(f"(SELECT grp, {TRUTH('ASIA_OR_EUROPE')} AS reported, {TRUTH('NOT_AFRICA')} AND row_id % 7 <> 0 AS truth FROM {ORD})", "grp"),
    "workload_summary": f"""SELECT method, count(*) AS queries, sum(calls)::BIGINT AS calls, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, count(recall_bound) AS certificates,
count(*) FILTER (recall_bound > recall + 1e-12) AS recall_violations, count(*) FILTER (precision_bound > precision + 1e-12) AS precision_violations, round(avg(recall_bound), 9) AS mean_recall_bound FROM {_certified()} GROUP BY 1""",
    "certificate_shortfall": f"SELECT method, calls, greatest(ceil(round(recall_bound * n_true, 9)) - tp, 0)::BIGINT AS recall_short, greatest(ceil(round(precision_bound * n_reported, 9)) - tp, 0)::BIGINT AS precision_short FROM {_certified()}".replace("greatest(ceil(round(recall_bound * n_true, 9)) - tp, 0)", "CASE WHEN recall_bound IS NULL THEN 0 ELSE greatest(ceil(round(recall_bound * n_true, 9)) - tp, 0) END").replace("greatest(ceil(round(precision_bound * n_reported, 9)) - tp, 0)", "CASE WHEN precision_bound IS NULL THEN 0 ELSE greatest(ceil(round(precision_bound * n_reported, 9)) - tp, 0) END"),
    "confusion_matrix": f"SELECT relation, predicted, count(*) AS n FROM {JUDGED} GROUP BY 1, 2",
    "relation_scores": _prf(f"(SELECT k AS of, predicted = k AS reported, relation = k AS truth FROM {JUDGED}, (SELECT unnest(['equiv','forward','backward','disjoint','overlap']) AS k))", "of"),
    "arbiter_trust": f"SELECT predicted, round(greatest(0.3, avg((predicted = relation)::INT)), 9) AS confidence FROM {JUDGED} GROUP BY 1",
    "calibration_ece": f"SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM (SELECT least(floor(confidence * 10), 9) AS b, count(*) AS n, avg(confidence) AS c, avg((relation = predicted)::INT) AS a FROM {JUDGED} GROUP BY 1)",
    "reliability_bins": f"SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, round(avg(confidence), 9) AS confidence, round(avg((relation = predicted)::INT), 9) AS accuracy FROM {JUDGED} GROUP BY 1",
    "oracle_agreement_kappa": """WITH t AS (SELECT m, o_orderkey AS id, o_orderkey % k = 0 AS a FROM orders, (VALUES ('a', 2), ('b', 3), ('c', 4)) v(m, k)),
p AS (SELECT x.m AS model_a, y.m AS model_b, count(*) AS n, count(*) FILTER (x.a = y.a) AS s, count(*) FILTER (x.a) AS na, count(*) FILTER (y.a) AS nb, count(*) FILTER (x.a AND y.a) AS n_both, count(*) FILTER (x.a OR y.a) AS either FROM t x JOIN t y ON x.id = y.id AND x.m < y.m GROUP BY 1, 2),
e AS (SELECT *, (na * nb + (n - na) * (n - nb)) / (n::DOUBLE * n) AS c FROM p)
SELECT model_a, model_b, n, round(s / n, 9) AS agreement, round(CASE WHEN c = 1 THEN 1 ELSE (s / n - c) / (1 - c) END, 9) AS kappa, round(CASE WHEN either = 0 THEN 1 ELSE n_both / either END, 9) AS jaccard FROM e""",
    "run_agreement": "SELECT o_orderpriority AS query, round(avg((x = y)::INT), 9) AS agreement, round(coalesce(count(*) FILTER (x <> y) / nullif(count(*) FILTER (x OR y), 0), 0), 9) AS flipped FROM (SELECT o_orderpriority, o_orderkey % 3 = 0 AS x, o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AS y FROM orders) GROUP BY 1",
    "predecessor_fractions": f"""WITH s AS (SELECT row_number() OVER (ORDER BY name) AS position, name AS key, labels FROM {SETS}),
p AS (SELECT n.position, o.key = n.key AS same, {RELATION.format(p='n.labels', q='o.labels')} AS r, o.key IS NOT NULL AS has FROM s n LEFT JOIN s o ON o.position < n.position)
SELECT position, coalesce(bool_or(same), false) AS repeat, coalesce(bool_or(has AND r = 'equiv' AND NOT same), false) AS equiv, coalesce(bool_or(has AND r IN ('forward', 'backward')), false) AS containment, coalesce(bool_or(has AND r = 'disjoint'), false) AS disjoint FROM p GROUP BY 1""",
    "implication_slack": f"SELECT d.a, d.b, round(1 - n_both / n_p, 9) AS slack, round(1 - n_both / n_q, 9) AS reverse_slack, round(n_both / (n_p + n_q - n_both), 9) AS jaccard FROM {_values(DECLARED, 'a, b')} d JOIN {COUNTS} c ON c.p = d.a AND c.q = d.b",
    "implication_summary": f"SELECT count(*) AS n, count(*) FILTER (s = 0) AS exact, round(median(s), 6) AS median, round(avg(s), 6) AS mean, round(max(s), 6) AS largest, count(*) FILTER (s <= 0.10) AS near FROM (SELECT round(1 - n_both / n_p, 9) AS s FROM {_values(DECLARED, 'a, b')} d JOIN {COUNTS} c ON c.p = d.a AND c.q = d.b)",
    "paired_ratios": """WITH r AS (SELECT o_orderkey % 2 AS rep, o_orderkey // 4 AS query, CASE WHEN o_orderkey % 4 < 2 THEN 'host' ELSE 'reuse' END AS arm, (o_custkey % 5 = 0)::INT AS retries, o_totalprice AS s FROM orders),
c AS (SELECT * FROM r QUALIFY max(retries) OVER (PARTITION BY rep, query) = 0), p AS (SELECT rep, query, max(s) FILTER (arm = 'reuse') AS a, max(s) FILTER (arm = 'host') AS b FROM c GROUP BY 1, 2)
SELECT rep, count(a / b) AS pairs, round(quantile_cont(a / b, 0.25), 6) AS q1, round(quantile_cont(a / b, 0.5), 6) AS median, round(quantile_cont(a / b, 0.75), 6) AS q3, round(sum(a) / sum(b), 6) AS of_sums FROM p GROUP BY 1""",
    "compare_tables": """WITH r AS (SELECT c_custkey, c_acctbal + (c_custkey % 7 = 0)::INT AS a, c_nationkey AS n FROM customer WHERE c_custkey % 10 <> 3),
j AS (SELECT c.c_custkey, c.c_acctbal AS la, r.a AS ra, c.c_nationkey::DOUBLE AS ln, r.n::DOUBLE AS rn FROM customer c LEFT JOIN r USING (c_custkey)),
x AS (SELECT c_custkey, 'c_acctbal' AS "column", la AS "left", ra AS "right" FROM j UNION ALL SELECT c_custkey, 'c_nationkey', ln, rn FROM j)
SELECT c_custkey, "column", round("left", 4) AS "left", round("right", 4) AS "right" FROM x WHERE "right" IS NULL OR abs("left" - "right") > 1e-6 * greatest(abs("left"), abs("right"))""",
    "stratified_subsample": f"SELECT row_id, leaf FROM (SELECT row_id, leaf FROM {CUST} QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY {_sample_key('leaf', 'leaf', 5, 0)}, row_id) <= 4) ORDER BY {_sample_key('all', chr(39) * 2, 5, 0)}, row_id LIMIT 100",
    "uniform_subsample": f"SELECT row_id FROM {CUST} ORDER BY {_sample_key('uniform', chr(39) * 2, 5, 0)}, row_id LIMIT 50",
    "document_labels": f"SELECT row_id, array_to_string(labels, ',') AS labels FROM {LABELS}",
    "frequent_labels": f"SELECT row_id, string_agg(l, ',' ORDER BY l) AS labels FROM (SELECT DISTINCT row_id, unnest(labels) AS l FROM {LABELS}) WHERE l IN (SELECT l FROM (SELECT row_id, unnest(labels) AS l FROM {LABELS}) GROUP BY 1 HAVING count(DISTINCT row_id) >= 60) GROUP BY 1",
    "parent_codes": """WITH c AS (SELECT DISTINCT code FROM (SELECT unnest([source, substr(source, 1, 3), lang || 'x', upper(lang)]) AS code FROM documents)),
n AS (SELECT c.code, max_by(p.code, length(p.code)) AS near FROM c LEFT JOIN c p ON starts_with(c.code, p.code) AND length(c.code) > length(p.code) AND p.code NOT IN ('SRC', 'ECAT') GROUP BY 1)
SELECT code, CASE WHEN code NOT IN ('SRC', 'ECAT') THEN coalesce(near, CASE substr(code, 1, 1) WHEN 's' THEN 'SRC' WHEN 'e' THEN 'ECAT' END) END AS parent FROM n""",
    "hierarchy_descendants": """WITH RECURSIVE h AS (SELECT n_name AS label, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region UNION ALL SELECT 'WORLD', NULL),
d AS (SELECT label AS ancestor, label FROM h UNION SELECT d.ancestor, h.label FROM d JOIN h ON h.parent = d.label) SELECT ancestor, label FROM d""",
    "selectivity": f"SELECT name, round(count(*) / (SELECT count(*) FROM customer), 9) AS selectivity FROM {EXT} GROUP BY 1",
}

TAXONOMY = "(SELECT n_name AS leaf, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey)"
GROUPS = f"(SELECT grp, list_sort(list(leaf)) AS leaves, row_number() OVER (ORDER BY grp) - 1 AS g FROM {TAXONOMY} GROUP BY grp HAVING count(*) > 1)"
NEXT = f"(SELECT leaf, lead(leaf) OVER (ORDER BY leaf) AS other FROM {TAXONOMY})"
LABEL_SETS = f"(SELECT 'leaf' AS kind, leaf AS name, [leaf] AS labels FROM {TAXONOMY} UNION ALL SELECT 'group', grp, leaves FROM {GROUPS} UNION ALL SELECT 'pair', leaf || '+' || other, list_sort([leaf, other]) FROM {NEXT} WHERE other IS NOT NULL)"
UNIVERSE = f"""(SELECT kind, name, 0 AS wording, CASE kind WHEN 'pair' THEN 'Origin of the record: ' || split_part(name, '+', 1) || ' or else ' || split_part(name, '+', 2) || '?' ELSE 'Origin of the record: ' || name || '?' END AS text, labels FROM {LABEL_SETS}
UNION ALL SELECT kind, name, 1, CASE kind WHEN 'pair' THEN 'Keep what ' || split_part(name, '+', 1) || ' and ' || split_part(name, '+', 2) || ' account for together.' ELSE 'Was ' || name || ' where it came from?' END, labels FROM {LABEL_SETS}
UNION ALL SELECT kind, name, 2, 'Keep what ' || name || ' accounts for.', labels FROM {LABEL_SETS} WHERE kind <> 'pair')"""


def _draw(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}/' || {key}), 1, 7))::INT"


HIERARCHY = "(SELECT n_name AS label, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region UNION ALL SELECT 'WORLD', NULL)"

SQL |= {
    "predicate_universe": f"SELECT kind, name, wording, text, array_to_string(labels, ',') AS labels FROM {UNIVERSE}",
    "relation_pairs": f"""SELECT p, q, relation FROM (SELECT p.text AS p, q.text AS q, {RELATION.format(p='p.labels', q='q.labels')} AS relation FROM {UNIVERSE} p JOIN {UNIVERSE} q ON p.text <> q.text)
QUALIFY row_number() OVER (PARTITION BY relation ORDER BY {_draw(3, "p || '/' || q")}, p, q) <= 40""",
    "session_workload": f"""WITH s AS (SELECT i::INT AS position, (i // 6)::INT AS session, (i % 6)::INT AS step FROM range(60) r(i)),
c AS (SELECT s.*, g.grp, leaves[{_draw(5, "'leaf/' || session")} % len(leaves) + 1] AS leaf, leaves[{_draw(5, "'other/' || session")} % len(leaves) + 1] AS another
      FROM s JOIN {GROUPS} g ON g.g = {_draw(5, "'group/' || session")} % (SELECT count(*) FROM {GROUPS})),
k AS (SELECT c.*, n.other, CASE WHEN step IN (0, 4) THEN 'group' WHEN step = 3 AND n.other IS NOT NULL THEN 'pair' ELSE 'leaf' END AS kind, (step IN (2, 4))::INT AS wording FROM c LEFT JOIN {NEXT} n USING (leaf)),
x AS (SELECT position, kind, wording, CASE WHEN kind = 'group' THEN grp WHEN kind = 'pair' THEN leaf || '+' || other WHEN step = 5 THEN another ELSE leaf END AS name FROM k)
SELECT position, kind, name, wording, u.text FROM x JOIN {UNIVERSE} u USING (kind, name, wording)""",
    "two_tier_judge": f"""SELECT p, q, CASE WHEN a.relation = 'overlap' THEN b.relation ELSE a.relation END AS relation, CASE WHEN a.relation = 'overlap' THEN 0.99 ELSE 0.9 END::DOUBLE AS confidence, a.relation = 'overlap' AS escalated
FROM {EXTENSIONAL} a JOIN (SELECT p.name AS p, q.name AS q, {RELATION.format(p='p.labels', q='q.labels')} AS relation FROM {SETS} p JOIN {SETS} q ON p.name <> q.name) b USING (p, q)""",
    "distinct_texts": "SELECT trim(regexp_replace(translate(lower(text), '.,', '  '), '\\s+', ' ', 'g')) AS norm, count(*) AS n, min(conv_id) AS first FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1",
    "hierarchy_roots": f"SELECT label, 'WORLD' AS root FROM {HIERARCHY}",
    "hierarchy_children": f"SELECT h.label, coalesce(string_agg(c.label, ',' ORDER BY c.label), '') AS children FROM {HIERARCHY} h LEFT JOIN {HIERARCHY} c ON c.parent = h.label GROUP BY 1",
    "pilot_cutoff": f"""WITH p AS (SELECT c_custkey AS row_id, c_acctbal::DOUBLE AS score, c_acctbal > 3000 AND c_custkey % 3 = 0 AS answer FROM customer),
h AS (SELECT *, CASE WHEN answer THEN row_number() OVER (PARTITION BY answer ORDER BY md5('0|0|cutoff||' || row_id), row_id) % 2 END AS half FROM p),
f AS (SELECT count(*) FILTER (answer) AS positives, quantile_cont(score, {(1 - 0.9) * 0.5!r}) FILTER (half = 1) AS cutoff FROM h),
k AS (SELECT avg((score >= cutoff)::INT) FILTER (half = 0) AS recall, avg((score >= cutoff)::INT) AS share FROM h, f)
SELECT round(cutoff, 6) AS cutoff FROM f, k WHERE positives >= 8 AND recall >= 0.95 AND share <= 0.8""",
    "embed_texts": """WITH t AS (SELECT conv_id, turn, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM conversations),
g AS (SELECT conv_id, turn, unnest(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: (('0x' || substr(md5(substr(t, i, 3)), 1, 8))::BIGINT % 64)::INT)) AS slot FROM t),
c AS (SELECT conv_id, turn, slot, count(*) AS n FROM g GROUP BY 1, 2, 3)
SELECT conv_id, turn, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM c""",
    "pair_accuracy": """WITH j AS (SELECT ['equiv','forward','backward','disjoint','overlap'][o_orderkey * 3 % 5 + 1] AS r, ['equiv','forward','backward','disjoint','overlap'][o_orderkey * CASE WHEN o_custkey % 4 = 0 THEN 7 ELSE 3 END % 5 + 1] AS p, o_custkey % 3 = 0 AS escalated FROM orders)
SELECT escalated, count(*) AS pairs, round(avg((r = p)::INT), 9) AS accuracy FROM j GROUP BY 1""",
    "unit_cost": """SELECT o_orderpriority AS model, sum(o_orderkey % 7)::BIGINT AS calls, round(sum(o_custkey % 300 + o_custkey % 5) / sum(o_orderkey % 7), 6) AS tokens_a_call, round(sum(o_orderkey % 7) / sum((o_orderkey % 11)::DOUBLE / 10), 6) AS calls_a_second,
round((sum(o_custkey % 300) * (0.15 / 1e6) + sum(o_custkey % 5) * (0.60 / 1e6)) / sum(o_orderkey % 7), 12) AS dollars_a_call FROM orders GROUP BY 1""",
    "host_comparison": f"SELECT grp AS query, count(*) AS alone, count(*) FILTER (row_id % 3 <> 0) AS reused, round(1 - count(*) FILTER (row_id % 3 <> 0) / count(*), 9) AS saved FROM {CUST} GROUP BY 1",
}
