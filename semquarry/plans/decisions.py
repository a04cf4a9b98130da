"""Queries of decisions, over cases that the events' numbers give, each with the same rules as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as rules
from ..functions import policy
from ..operators import metrics
from .surface import query, read

_DOMAINS = ["preference", "legal_advice", "code", "medical_text", "project_state"]
_PREDICATES = ["grant", "like", "delete", "visit", "share"]
_MODALITIES = ["must", "may", "shall_not"]
_LEVELS = ["trivial", "simple", "moderate", "complex"]


def _chosen(by: str, values: list[str]) -> str:
    """SQL for the value that a number names; null for numbers beyond them."""
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: Columns of a case, as SQL, which Spark and others read alike; i is the event's number.
_COLUMNS = {
    "conf": "(i * 37 % 101) / 100.0D", "density": "(i * 53 % 101) / 100.0D", "plain": "i % 400 + 1", "code": "i * 7 % 400", "budget": "CASE WHEN i % 4 <> 0 THEN i % 3 * 150 END", "review": "i % 13 = 0",
    "domain": _chosen("i % 6", _DOMAINS), "validated": "i % 2 = 0", "level": _chosen("i % 5", _LEVELS),
    "c1": "(i % 101) / 100.0D", "c2": "(i * 3 % 101) / 100.0D", "c3": "(i * 7 % 101) / 100.0D", "c4": "(i * 11 % 101) / 100.0D", "c5": "(i * 13 % 101) / 100.0D", "c6": "(i * 17 % 101) / 100.0D",
    "predicate": _chosen("i % 5", _PREDICATES), "modality": _chosen("i % 4", _MODALITIES), "negated": "i % 3 = 0", "missing": "i % 5",
}
_CASES = f"c AS (SELECT event_id AS id, event_type, user_id, {', '.join(f'{sql} AS {name}' for name, sql in _COLUMNS.items())} FROM (SELECT *, event_id AS i FROM events))".replace("100.0D", "100.0::DOUBLE")


def cases(spark, d) -> DataFrame:
    rows = read(spark, d, "events").withColumn("i", F.col("event_id"))
    return rows.select(F.col("event_id").alias("id"), "event_type", "user_id", *[F.expr(sql).alias(name) for name, sql in _COLUMNS.items()])


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_FORCED = f"coalesce(lower(domain) IN ({_in(rules.PROHIBITED + policy.NATURAL_ONLY)}), false)"
_GOOD = "((c1 >= 0.7)::INT + (c2 >= 0.7)::INT + (c3 >= 0.7)::INT)"
_MODE = f"""WHEN {_FORCED} THEN 'natural|domain_forces_natural' WHEN review THEN 'natural|human_review_required' WHEN conf < 0.7 THEN 'natural|low_confidence' WHEN density >= 0.5 THEN 'natural|high_literal_density'
WHEN conf >= 0.9 AND (plain - code) / plain::DOUBLE >= 0.15 AND budget > 0 AND code <= budget THEN 'lunum|fits_within_budget' WHEN conf >= 0.9 AND (plain - code) / plain::DOUBLE >= 0.15 AND NOT coalesce(budget > 0, false) THEN 'lunum|token_savings_sufficient'
WHEN {_GOOD} = 2 THEN 'mixed|clause_level_mixed' WHEN code > 0 AND budget > 0 AND code <= budget THEN 'lunum|decent_confidence' ELSE 'natural|default_natural'"""


@query(f"WITH {_CASES} SELECT id, split_part(m, '|', 1) AS mode, split_part(m, '|', 2) AS reason FROM (SELECT id, CASE {_MODE} END AS m FROM c)")
def context_mode(spark, d):
    """The mode of each context by eight ordered rules, and the rule that decided."""
    m = rules.context_mode(*[F.col(x) for x in ("domain", "review", "conf", "density", "plain", "code", "budget")], F.array("c1", "c2", "c3"))
    return cases(spark, d).select("id", m.alias("m")).select("id", "m.mode", "m.reason")


@query(f"WITH {_CASES} SELECT id, unnest(range(0, 3))::INT AS clause, CASE WHEN unnest([c1, c2, c3]) >= 0.7 THEN 'lunum' ELSE 'natural' END AS mode, {_GOOD} = 2 AS mixed, {_FORCED} AS forced FROM c")
def clause_modes(spark, d):
    """Each clause's own mode, whether the clauses are mixed, and whether the domain forces the natural one."""
    rows = cases(spark, d).select("id", F.posexplode(F.array("c1", "c2", "c3")).alias("clause", "c"), rules.mixed_clauses(F.array("c1", "c2", "c3")).alias("mixed"), rules.forces_natural(F.col("domain")).alias("forced"))
    return rows.select("id", "clause", F.when(F.col("c") >= rules.LEAST_CONFIDENCE, "lunum").otherwise("natural").alias("mode"), "mixed", "forced")


_RULE_SQL = f"""r AS (SELECT id,
CASE WHEN domain IS NULL THEN {{'p': true, 'c': 'no_domain_specified', 's': 1.0::DOUBLE}} WHEN domain IN ({_in(rules.PROHIBITED)}) THEN {{'p': false, 'c': 'prohibited_domain', 's': 0.0::DOUBLE}} WHEN domain IN ({_in(policy.NATURAL_ONLY)}) THEN {{'p': false, 'c': 'natural_only_category', 's': 0.0::DOUBLE}} ELSE {{'p': true, 'c': 'domain_allowed', 's': 1.0::DOUBLE}} END AS a,
CASE WHEN review THEN {{'p': false, 'c': 'human_review_required', 's': 0.0::DOUBLE}} ELSE {{'p': true, 'c': 'no_human_review_required', 's': 1.0::DOUBLE}} END AS b,
CASE WHEN conf < 0.7 THEN {{'p': false, 'c': 'confidence_below_minimum', 's': conf}} ELSE {{'p': true, 'c': 'confidence_sufficient', 's': conf}} END AS c,
CASE WHEN density >= 0.5 THEN {{'p': false, 'c': 'high_literal_density', 's': 1 - density}} ELSE {{'p': true, 'c': 'literal_density_acceptable', 's': 1 - density}} END AS d,
CASE WHEN validated THEN {{'p': true, 'c': 'semantics_validated', 's': 1.0::DOUBLE}} ELSE {{'p': true, 'c': 'semantics_unvalidated', 's': 0.5::DOUBLE}} END AS e,
CASE WHEN level IS NULL THEN {{'p': true, 'c': 'complexity_unknown', 's': 1.0::DOUBLE}} WHEN level = 'complex' AND conf < 0.9 THEN {{'p': true, 'c': 'complex_moderate_confidence', 's': 0.5::DOUBLE}} WHEN level = 'moderate' AND conf < 0.9 THEN {{'p': true, 'c': 'moderate_moderate_confidence', 's': 0.75::DOUBLE}} WHEN level = 'trivial' THEN {{'p': true, 'c': 'trivial_semantics', 's': 1.0::DOUBLE}} ELSE {{'p': true, 'c': 'simple_semantics', 's': 0.8::DOUBLE}} END AS f,
CASE WHEN budget IS NULL THEN {{'p': true, 'c': 'budget_unknown', 's': 1.0::DOUBLE}} WHEN code > budget THEN {{'p': false, 'c': 'over_budget', 's': greatest(0, 1 - (code - budget) / budget::DOUBLE)}} ELSE {{'p': true, 'c': 'within_budget', 's': 1 - code / budget::DOUBLE}} END AS g FROM c WHERE budget IS NULL OR budget > 0)"""
_ORDER = ["domain_safety", "human_review", "parse_confidence", "literal_density", "validated_semantics", "semantic_complexity", "token_budget"]
_NAMED_RULES = ", ".join(f"{{'rule': '{name}', 'v': {column}}}" for name, column in zip(_ORDER, "abcdefg", strict=True))


@query(f"WITH {_CASES}, {_RULE_SQL} SELECT id, x.rule AS rule, x.v.p AS passed, x.v.c AS code, round(x.v.s, 6) AS score FROM (SELECT id, unnest([{_NAMED_RULES}]) AS x FROM r)")
def context_rules(spark, d):
    """The seven rules of a context's eligibility, one row each."""
    found = rules.eligibility_rules(*[F.col(x) for x in ("domain", "review", "conf", "density", "validated", "level", "budget", "code")])
    rows = cases(spark, d).where("budget is null or budget > 0").select("id", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), rule.alias("v")) for name, rule in found.items()])).alias("x"))
    return rows.select("id", "x.rule", "x.v.passed", "x.v.code", F.round("x.v.score", 6).alias("score"))


@query(f"WITH {_CASES}, {_RULE_SQL} SELECT id, CASE WHEN NOT (a.p AND b.p AND c.p AND g.p) THEN 'natural' WHEN NOT d.p THEN 'below' ELSE 'lunum' END AS mode FROM r")
def context_recommendation(spark, d):
    """natural where a hard rule or the budget fails, ``below`` where only the literals' density does, else compact."""
    found = rules.eligibility_rules(*[F.col(x) for x in ("domain", "review", "conf", "density", "validated", "level", "budget", "code")])
    hard = found["domain_safety"]["passed"] & found["human_review"]["passed"] & found["parse_confidence"]["passed"] & found["token_budget"]["passed"]
    return cases(spark, d).where("budget is null or budget > 0").select("id", policy.decision([(~hard, "natural"), (~found["literal_density"]["passed"], "below")], "lunum").alias("mode"))


@query(f"WITH {_CASES} SELECT id, CASE WHEN n >= 7 AND (m >= 3 OR k > 0) THEN 'complex' WHEN n >= 4 AND k > 0 OR n >= 5 AND m >= 3 THEN 'moderate' WHEN n >= 2 AND (g > 0 OR k > 0 OR m >= 2) THEN 'simple' ELSE 'trivial' END AS object, CASE WHEN r >= 5 OR k >= 2 OR (m > 0 AND g > 0) THEN 'complex' WHEN r >= 3 OR k >= 1 OR (m > 0 AND r >= 2) THEN 'moderate' WHEN r >= 2 OR m > 0 OR g > 0 THEN 'simple' ELSE 'trivial' END AS clause FROM (SELECT id, id % 9 AS n, id // 9 % 3 AS k, id // 27 % 4 AS m, id // 108 % 2 AS g, id // 216 % 6 AS r FROM c)")
def complexity(spark, d):
    """Levels of objects and of clauses by their numbers of parts."""
    n, k, m, g, r = F.col("id") % 9, F.floor(F.col("id") / 9) % 3, F.floor(F.col("id") / 27) % 4, F.floor(F.col("id") / 108) % 2, F.floor(F.col("id") / 216) % 6
    return cases(spark, d).select("id", rules.semantic_complexity(n, k, m, g).alias("object"), rules.clause_complexity(r, k, m > 0, g > 0).alias("clause"))


@query(f"WITH {_CASES} SELECT id, CASE WHEN negated AND (id % 4 = 0 OR id % 7 = 0) THEN 'critical' WHEN id % 11 = 0 THEN 'high' WHEN id % 4 = 0 OR id % 7 = 0 THEN 'high' WHEN negated THEN 'medium' ELSE 'low' END AS risk FROM c")
def record_risk(spark, d):
    i = F.col("id")
    return cases(spark, d).select("id", rules.record_risk(F.col("negated"), i % 4 == 0, i % 7 == 0, i % 11 == 0).alias("risk"))


_RISKY = f"IN ({_in(rules.RISKY_PREDICATES)})"
_WHY_RISKY = f"list_filter([CASE WHEN predicate {_RISKY} THEN 'predicate ''' || predicate || ''' is safety-critical' END, CASE WHEN modality IN ({_in(rules.RISKY_MODALITIES)}) THEN 'modality ''' || modality || ''' on ''' || predicate || ''' implies obligation/prohibition' END, CASE WHEN negated AND predicate {_RISKY} THEN 'negated safety-critical predicate ''' || predicate || '''' END, CASE WHEN level {_RISKY} THEN level END], lambda x: x IS NOT NULL)"


@query(f"WITH {_CASES} SELECT id, len({_WHY_RISKY}) > 0 AS risky, array_to_string({_WHY_RISKY}, '; ') AS reasons FROM c")
def high_risk(spark, d):
    """Whether a clause is of high risk, and why."""
    why = rules.risk_reasons(*[F.col(x) for x in ("predicate", "modality", "negated", "level")])
    return cases(spark, d).select("id", (F.size(why) > 0).alias("risky"), F.array_join(why, "; ").alias("reasons"))


_HARD = "list_filter([CASE WHEN conf < 0.7 - 0.15 THEN 'confidence ' || printf('%.3f', conf) || ' below minimum 0.7' END, CASE WHEN id % 6 = 0 THEN 'missing expected roles: theme, time' END, CASE WHEN missing > 2 THEN missing || ' missing features exceeds maximum 2' END], lambda x: x IS NOT NULL)"
_SOFT = "list_filter([CASE WHEN conf >= 0.7 - 0.15 AND conf < 0.7 THEN 'confidence ' || printf('%.3f', conf) || ' in review band [0.550, 0.700)' END, CASE WHEN predicate = 'visit' THEN 'predicate ''visit'' not in controlled vocabulary' END], lambda x: x IS NOT NULL)"


@query(f"WITH {_CASES} SELECT id, CASE WHEN len({_HARD}) > 0 THEN 'fallback' WHEN len({_SOFT}) > 0 THEN 'review' ELSE 'store' END AS action, array_to_string(list_concat({_HARD}, {_SOFT}), '; ') AS reasons, CASE WHEN len({_HARD}) > 0 THEN 'fallback' WHEN len({_SOFT}) > 0 OR len({_WHY_RISKY}) > 0 THEN 'review' ELSE 'store' END AS with_risk FROM c")
def fallback_reasons(spark, d):
    """store, review or fallback of a parse with its reasons, and the same where a high risk turns store to review."""
    missing = F.when(F.col("id") % 6 == 0, F.array(F.lit("theme"), F.lit("time"))).otherwise(F.array().cast("array<string>"))
    found = rules.fallback(F.col("conf"), missing, F.when(F.col("predicate") == "visit", F.col("predicate")), F.col("missing"))
    risky = F.size(rules.risk_reasons(*[F.col(x) for x in ("predicate", "modality", "negated", "level")])) > 0
    rows = cases(spark, d).select("id", found.alias("f"), risky.alias("risky"))
    return rows.select("id", "f.action", F.array_join("f.reasons", "; ").alias("reasons"), F.when((F.col("f.action") == "store") & F.col("risky"), "review").otherwise(F.col("f.action")).alias("with_risk"))


_LEAST = "least(c1, c2, c3, c4, c5, c6)"
_PARSED = f"round(least(1, greatest(0, (c1 * 0.2 + c2 * 0.15 + c3 * 0.15 + c4 * 0.15 + c5 * 0.2 + c6 * 0.15) * CASE WHEN {_LEAST} < 0.6 THEN {_LEAST} / 0.6 ELSE 1 END)), 6)"


@query(f"WITH {_CASES} SELECT id, s AS score, enough, CASE WHEN s < 0.55 OR NOT enough THEN 'fallback' WHEN s < 0.7 THEN 'review' ELSE 'store' END AS action FROM (SELECT id, {_PARSED} AS s, {_LEAST} >= 0.6 AS enough FROM c)")
def parse_confidence(spark, d):
    """Confidence from six kinds of evidence, whether there is enough of each, and what follows."""
    evidence = [F.col(f"c{k}") for k in range(1, 7)]
    rows = cases(spark, d).select("id", F.round(rules.parse_confidence(*evidence), 6).alias("score"), rules.enough_evidence(*evidence).alias("enough"))
    return rows.withColumn("action", rules.uncertainty_action(F.col("score"), F.col("enough")))


@query(f"WITH {_CASES} SELECT id, array_to_string(list_filter([CASE WHEN c1 >= 0.35 AND c1 < 0.5 THEN 'prohibited_domain_proximity' END, CASE WHEN conf < 0.85 THEN 'low_confidence' END, CASE WHEN id % 3 = 1 THEN 'safety_invariant_near_miss' END, CASE WHEN density >= 0.5 THEN 'protected_literal_density' END], lambda x: x IS NOT NULL), ',') AS triggers FROM c")
def human_review(spark, d):
    """Why a person must look at a record, the most urgent first; empty where no one must."""
    found = rules.review_triggers(F.col("c1"), F.col("conf"), F.col("id") % 3, F.col("density"))
    return cases(spark, d).select("id", F.array_join(found, ",").alias("triggers"))


_SCORE = "(conf * 0.5 + (n - lo) / n::DOUBLE * 0.3 + (n - am) / n::DOUBLE * 0.2)"


@query(f"WITH {_CASES} SELECT id, round(s, 6) AS score, l AS level, l = 'abstain' OR (l = 'low' AND am > n * 0.5) AS abstain FROM (SELECT *, CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.7 THEN 'medium' WHEN s >= 0.5 THEN 'low' ELSE 'abstain' END AS l FROM (SELECT *, round({_SCORE}, 6) AS s FROM (SELECT id, conf, 4 AS n, id % 5 AS lo, id // 5 % 5 AS am FROM c)))")
def abstention(spark, d):
    """Score and level of a parse, and whether to abstain."""
    found = rules.abstention(F.col("conf"), F.lit(4), F.col("id") % 5, F.floor(F.col("id") / 5) % 5)
    rows = cases(spark, d).select("id", found.alias("a"), (F.floor(F.col("id") / 5) % 5).alias("am")).withColumn("s", F.round("a.score", 6))
    level = policy.decision([(F.col("s") >= 0.9, "high"), (F.col("s") >= 0.7, "medium"), (F.col("s") >= 0.5, "low")], "abstain")
    return rows.select("id", F.col("s").alias("score"), level.alias("level"), ((level == "abstain") | (level == "low") & (F.col("am") > 2)).alias("abstain"))


@query(f"WITH {_CASES} SELECT id, array_to_string(list_filter([CASE WHEN t > 4096 THEN 'too_many_tokens' END, CASE WHEN t <= 4096 AND t > 3276.8 THEN 'near_token_limit' END, CASE WHEN conf < 0.8 THEN 'preservation_below_minimum' END], lambda x: x IS NOT NULL), ',') AS issues, t <= 4096 AND conf >= 0.8 AS passed FROM (SELECT *, plain * 12 AS t FROM c)")
def prompt_gate(spark, d):
    """Errors and warnings of prompts by their tokens and by what they preserve."""
    issues = rules.prompt_gate(F.col("plain") * 12, F.col("conf"))
    return cases(spark, d).select("id", F.array_join(issues, ",").alias("issues"), (F.size(F.filter(issues, lambda x: x != "near_token_limit")) == 0).alias("passed"))


@query(f"WITH {_CASES} SELECT id, CASE WHEN NOT validated THEN 'blocked' WHEN c1 < 0.85 OR c2 < 0.9 OR c3 < 0.95 THEN 'fallback-natural' ELSE 'compact' END AS verdict FROM c")
def compaction_gates(spark, d):
    safety = F.when(F.col("validated"), 1.0).otherwise(0.5)
    return cases(spark, d).select("id", rules.compaction_verdict({"semantic": F.col("c1"), "literal": F.col("c2"), "role": F.col("c3"), "safety": safety}).alias("verdict"))


_RATES = {"valid": "avg((conf >= 0.02)::INT)", "exact": "avg((conf >= 0.1)::INT)", "recall": "avg(c1)", "precision": "avg(c2)", "safety": "avg((id % 997 <> 0)::INT)", "fallback": "avg((conf < 0.08)::INT)"}
_FAILED = " ".join(f"CASE WHEN round({sql}, 6) {'>' if gate == 'fallback' else '<'} {rules.PARSE_GATES[gate]} THEN '{gate}' END," for gate, sql in _RATES.items()).rstrip(",")


@query(f"WITH {_CASES} SELECT user_id AS scope, array_to_string(list_filter([{_FAILED}], lambda x: x IS NOT NULL), ',') AS failed FROM c GROUP BY user_id")
def parse_gates(spark, d):
    """Gates that each scope fails, by its mean rates."""
    rows = cases(spark, d).groupBy(F.col("user_id").alias("scope")).agg(*[F.round(F.expr(sql), 6).alias(gate) for gate, sql in _RATES.items()])
    return rows.select("scope", F.array_join(rules.failed_parse_gates({gate: F.col(gate) for gate in rules.PARSE_GATES}), ",").alias("failed"))


_NAMED_RATES = ", ".join(f"{{'gate': '{gate}', 'v': round({sql}, 6)}}" for gate, sql in _RATES.items())
_PASSED = " ".join(f"WHEN '{gate}' THEN x.v {'<=' if gate == 'fallback' else '>='} {least}" for gate, least in rules.PARSE_GATES.items())


@query(f"WITH {_CASES}, u AS (SELECT scope, unnest(x) AS x FROM (SELECT user_id AS scope, [{_NAMED_RATES}] AS x FROM c GROUP BY user_id)) SELECT x.gate AS gate, bool_and(CASE x.gate {_PASSED} END) AS passed, count(*) AS scopes FROM u GROUP BY 1")
def parse_gates_overall(spark, d):
    """Whether each gate is passed in every scope."""
    found = parse_gates(spark, d).select(F.split("failed", ",").alias("f"))
    rows = found.select(F.explode(F.array(*[F.struct(F.lit(gate).alias("gate"), (~F.array_contains("f", gate)).alias("ok")) for gate in rules.PARSE_GATES])).alias("x"))
    return rows.groupBy("x.gate").agg(F.bool_and("x.ok").alias("passed"), F.count(F.lit(1)).alias("scopes"))


@query(f"WITH {_CASES} SELECT id, CASE WHEN conf < 0.5 THEN 'fail' WHEN conf < 0.7 OR c1 < 0.3 OR c2 < 0.2 THEN 'warn' ELSE 'pass' END AS result, round(conf - 0.6, 6) AS delta FROM c")
def downstream_gate(spark, d):
    found = rules.downstream_gate(F.col("conf"), 0.7, 0.5, {"recall": (F.col("c1"), 0.3), "precision": (F.col("c2"), 0.2)})
    return cases(spark, d).select("id", found.alias("result"), F.round(F.col("conf") - 0.6, 6).alias("delta"))


_ROLES, _ENDPOINTS, _METHODS = ["read-only", "parse", "admin", "guest"], ["semantics", "fingerprints", "evidence", "tenants", "health"], ["GET", "POST", "DELETE"]
_PERMITTED = ", ".join(f"('{r}', '{e}', '{m}')" for r, endpoints in rules.PERMISSIONS.items() for e, methods in endpoints.items() for m in methods)


@query(f"WITH a AS (SELECT event_id AS id, [{_in(_ROLES)}][event_id % 4 + 1] AS role, [{_in(_ENDPOINTS)}][event_id % 5 + 1] AS endpoint, [{_in(_METHODS)}][event_id % 3 + 1] AS method FROM events) SELECT a.*, p.role IS NOT NULL AS allowed FROM a LEFT JOIN (VALUES {_PERMITTED}) p(role, endpoint, method) ON a.role = p.role AND a.endpoint = p.endpoint AND a.method = p.method")
def role_access(spark, d):
    """Whether a consumer's role allows a method at an endpoint."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), pick(_ROLES).alias("role"), pick(_ENDPOINTS).alias("endpoint"), pick(_METHODS).alias("method"))
    return rows.withColumn("allowed", rules.allowed(F.col("role"), F.col("endpoint"), F.col("method")))


@query("SELECT event_id AS id, CASE WHEN h <> '' THEN 'weight-hash' WHEN n IS NOT NULL AND a IS NOT NULL THEN 'gguf-metadata' WHEN n IS NOT NULL AND f IS NOT NULL THEN 'name-only' ELSE 'unknown' END AS method, CASE WHEN h <> '' THEN regexp_full_match(h, '[a-f0-9]{64}') ELSE n IS NOT NULL AND (a IS NOT NULL OR f IS NOT NULL) END AS identified FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN sha256(event_id::VARCHAR) WHEN event_id % 5 = 1 THEN 'ABC' ELSE '' END AS h, CASE WHEN event_id % 3 <> 0 THEN event_type END AS n, CASE WHEN event_id % 2 = 0 THEN 'arch' END AS a, CASE WHEN event_id % 7 <> 0 THEN 'family' END AS f FROM events)")
def model_identity(spark, d):
    """How a model is known: by a digest of its weights, its metadata or its name."""
    i = F.col("event_id")
    digest = F.when(i % 5 == 0, F.sha2(i.cast("string"), 256)).when(i % 5 == 1, "ABC").otherwise("")
    found = rules.model_identity(digest, F.when(i % 3 != 0, F.col("event_type")), F.when(i % 2 == 0, "arch"), F.when(i % 7 != 0, "family"))
    return read(spark, d, "events").select(i.alias("id"), found.alias("m")).select("id", "m.method", "m.identified")


#: Service levels by event type: availability, p50, p95, p99 in ms, errors, requests.
_SLOS = [("view", 0.5, 60.0, 150.0, 400.0, 0.6, 10.0), ("click", 0.99, 40.0, 200.0, 300.0, 0.2, 1e6), ("purchase", 0.3, 1000.0, 1000.0, 9000.0, 0.9, 1.0), ("search", 1.0, 0.0, 100.0, 200.0, 0.0, 0.0)]
_SLO_ROWS = ", ".join(str(row) for row in _SLOS)
_MEASURED = "m AS (SELECT event_type, round(avg((value < 100)::INT), 6) AS av, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, round(avg((value >= 100)::INT), 6) AS er, count(*)::DOUBLE AS th FROM events GROUP BY event_type)"
_LATENCY = lambda k: f"round(CASE WHEN s.{k} = 0 THEN CASE WHEN m.{k} = 0 THEN 100 ELSE -100 END ELSE (s.{k} - m.{k}) / s.{k} * 100 END, 4)::DOUBLE AS {k}_margin"


@query(f"WITH {_MEASURED}, s AS (SELECT * FROM (VALUES {_SLO_ROWS}) t(event_type, av, p50, p95, p99, er, th)), j AS (SELECT event_type, {_LATENCY('p50')}, {_LATENCY('p95')}, {_LATENCY('p99')}, {_LATENCY('er')}, round(CASE WHEN s.av = 1 THEN CASE WHEN m.av >= 1 THEN 100 ELSE -100 END ELSE ((1 - s.av) - (1 - m.av)) / (1 - s.av) * 100 END, 4)::DOUBLE AS av_margin, round(CASE WHEN s.th = 0 THEN 100 ELSE (m.th - s.th) / s.th * 100 END, 4)::DOUBLE AS th_margin, list_filter([CASE WHEN m.av < s.av THEN 'availability' END, CASE WHEN m.p50 > s.p50 THEN 'p50' END, CASE WHEN m.p95 > s.p95 THEN 'p95' END, CASE WHEN m.p99 > s.p99 THEN 'p99' END, CASE WHEN m.er > s.er THEN 'errors' END, CASE WHEN m.th < s.th THEN 'throughput' END], lambda x: x IS NOT NULL) AS v FROM m JOIN s USING (event_type)) SELECT * EXCLUDE (v), len(v) = 0 AS met, array_to_string(v, ',') AS violations FROM j")
def all_slos(spark, d):
    """Every measured service against its levels: margins in percent, and what is violated."""
    m = read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") < 100).cast("int")), 6).alias("av"), *[F.round(metrics.nearest_rank("value", p), 6).alias(k) for k, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.round(F.avg((F.col("value") >= 100).cast("int")), 6).alias("er"), F.count(F.lit(1)).cast("double").alias("th"))
    names = ["av", "p50", "p95", "p99", "er", "th"]
    slos = spark.createDataFrame(_SLOS, "event_type string, " + ", ".join(f"_{k} double" for k in names))
    kinds = {"av": "availability", "th": "throughput"}
    margins = [F.round(rules.margin(F.col(k), F.col(f"_{k}"), kinds.get(k, "latency")), 4).alias(f"{k}_margin") for k in names]
    violated = policy.reasons((F.col("av") < F.col("_av"), "availability"), *[(F.col(k) > F.col(f"_{k}"), k if k != "er" else "errors") for k in ("p50", "p95", "p99", "er")], (F.col("th") < F.col("_th"), "throughput"))
    return m.join(slos, "event_type").select("event_type", *margins, (F.size(violated) == 0).alias("met"), F.array_join(violated, ",").alias("violations"))


@query("SELECT event_id AS id, n <= 100 AS within_rate, length(props) <= 20 AS within_size FROM (SELECT *, event_id % 150 AS n FROM events)")
def request_limits(spark, d):
    """Whether a request's count and its bytes are within their limits."""
    return read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 150 <= 100).alias("within_rate"), (F.octet_length("props") <= 20).alias("within_size"))


#: Versions: state, end of support, schemas.
_VERSIONS = [("0.1.0", "obsolete", "2024-01-01", ["lunum-sem/0.1-draft"]), ("0.2.0", "deprecated", "2030-01-01", ["lunum-sem/0.1-draft", "lunum-sem/0.2"]), ("0.3.0", "stable", "2031-01-01", ["lunum-sem/0.2"])]
_VERSION_ROWS = ", ".join(f"('{v}', '{state}', DATE '{end}', [{_in(schemas)}])" for v, state, end, schemas in _VERSIONS)
_ASKED = ["0.1.0", "0.2.0", "0.3.0", "9.9.9"]


@query(f"WITH v AS (SELECT * FROM (VALUES {_VERSION_ROWS}) t(version, state, ends, schemas)), a AS (SELECT event_id AS id, ts, [{_in(_ASKED)}][event_id % 4 + 1] AS version, ['lunum-sem/0.1-draft', 'lunum-sem/0.2'][event_id % 2 + 1] AS schema FROM events) SELECT id, coalesce(state, 'obsolete') AS state, coalesce(list_contains(schemas, schema), false) AS supported, coalesce(datediff('day', ts::DATE, ends), -1) AS days_left, coalesce(state = 'stable' OR (state = 'deprecated' AND datediff('day', ts::DATE, ends) > 0), false) AS updates FROM a LEFT JOIN v USING (version)")
def version_support(spark, d):
    """State of a version at a time, whether it reads a schema, and whether it still gets updates."""
    known = spark.createDataFrame(_VERSIONS, "version string, state string, ends string, schemas array<string>")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("day"), pick(_ASKED).alias("version"), pick(["lunum-sem/0.1-draft", "lunum-sem/0.2"]).alias("schema")).join(F.broadcast(known), "version", "left")
    left = F.datediff(F.to_date("ends"), "day")
    return rows.select("id", F.coalesce("state", F.lit("obsolete")).alias("state"), F.coalesce(F.array_contains("schemas", F.col("schema")), F.lit(False)).alias("supported"), F.coalesce(left, F.lit(-1)).cast("long").alias("days_left"), F.coalesce((F.col("state") == "stable") | (F.col("state") == "deprecated") & (left > 0), F.lit(False)).alias("updates"))
