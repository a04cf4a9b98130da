"""Queries of pilots and their state: step transitions, memories by script, health, profiles' quality, opt-ins, failover."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from .decisions import _CASES, cases
from .exchange import rule_parse, template_realization
from .lifecycle import _in
from .reports import _pick
from .surface import SQL as _SQL
from .surface import query, read

_STATUSES = ["running", "running", "completed", "failed"]


@query(f"WITH e AS (SELECT user_id AS plan, event_id % 4 AS step, event_id, ts, [{_in(_STATUSES)}][event_id // 4 % 4 + 1] AS status FROM events) SELECT plan, step, arg_max(status, event_id) AS status, min(ts) FILTER (WHERE status = 'running') AS started, arg_max(ts, event_id) FILTER (WHERE status <> 'running') AS ended, count(*) AS transitions FROM e GROUP BY ALL")
def step_transitions(spark, d):
    """Each step after all its transitions: its status, when it first ran, and when it last came to an end."""
    i = F.col("event_id")
    e = read(spark, d, "events").select(F.col("user_id").alias("plan"), (i % 4).alias("step"), "event_id", "ts", _pick(_STATUSES, F.floor(i / 4) % 4).alias("status"))
    ended = F.col("status") != "running"
    return e.groupBy("plan", "step").agg(F.max_by("status", "event_id").alias("status"), F.min(F.when(~ended, F.col("ts"))).alias("started"), F.max_by(F.when(ended, F.col("ts")), F.when(ended, F.col("event_id"))).alias("ended"), F.count(F.lit(1)).alias("transitions"))


_OPERATIONS = "o AS (SELECT CASE WHEN regexp_matches(text, '[α-ωΑ-Ω]') THEN 'greek' WHEN regexp_matches(text, '[äöüßéèàçñáóíúêôîûëïœ]') THEN 'latin-marked' ELSE 'latin' END AS script, unnest([{'op': 'store', 'ok': true}, {'op': 'retrieve', 'ok': text = trim(text, ' ' || chr(10))}, {'op': 'update', 'ok': doc_id % 50 <> 0}, {'op': 'round-trip', 'ok': NOT contains(text, chr(10))}], recursive := true) FROM documents)"


@query(f"WITH {_OPERATIONS} SELECT script, op, count(*) AS total, count(*) FILTER (WHERE ok) AS preserved, round(avg(ok::INT), 6) AS rate, CASE WHEN avg(ok::INT) >= 0.95 THEN 'pass' WHEN avg(ok::INT) >= 0.8 THEN 'degraded' ELSE 'fail' END AS verdict FROM o GROUP BY GROUPING SETS ((script), (op), ())")
def memory_pilot(spark, d):
    """Share of memories that operations preserve, by script and by operation, and a verdict for each."""
    t = F.col("text")
    script = F.when(t.rlike("[α-ωΑ-Ω]"), "greek").when(t.rlike("[äöüßéèàçñáóíúêôîûëïœ]"), "latin-marked").otherwise("latin")
    ops = {"store": F.lit(True), "retrieve": t == F.btrim("text", F.lit(" \n")), "update": F.col("doc_id") % 50 != 0, "round-trip": ~F.contains(t, F.lit("\n"))}
    rows = read(spark, d, "documents").select(script.alias("script"), F.explode(F.array(*[F.struct(F.lit(k).alias("op"), ok.alias("ok")) for k, ok in ops.items()])).alias("x")).select("script", "x.op", "x.ok")
    rate = F.avg(F.col("ok").cast("int"))
    return rows.groupingSets([[F.col("script")], [F.col("op")], []], F.col("script"), F.col("op")).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("ok"), 1)).alias("preserved"), F.round(rate, 6).alias("rate"), policy.decision([(rate >= 0.95, "pass"), (rate >= 0.8, "degraded")], "fail").alias("verdict"))


_HEALTH = "h AS (SELECT user_id AS pilot, avg((value >= 5)::INT) * 100 AS retention, avg((event_id % 40 <> 0)::INT) * 100 AS stability, avg((value < 150)::INT) * 100 AS fidelity, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY user_id)"


@query(f"WITH {_HEALTH} SELECT pilot, array_to_string(list_filter([CASE WHEN retention < 90 THEN 'retention' END, CASE WHEN stability < 97 THEN 'fingerprint' END, CASE WHEN fidelity < 95 THEN 'round-trip' END, CASE WHEN p95 > 140 THEN 'latency' END], lambda x: x IS NOT NULL), ',') AS failed, retention < 80 OR stability < 90 AS rollback FROM h")
def pilot_health(spark, d):
    """Criteria that a pilot fails, and whether it must be rolled back."""
    share = lambda c: F.avg(c.cast("int")) * 100
    h = read(spark, d, "events").groupBy(F.col("user_id").alias("pilot")).agg(share(F.col("value") >= 5).alias("retention"), share(F.col("event_id") % 40 != 0).alias("stability"), share(F.col("value") < 150).alias("fidelity"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))
    failed = policy.reasons((F.col("retention") < 90, "retention"), (F.col("stability") < 97, "fingerprint"), (F.col("fidelity") < 95, "round-trip"), (F.col("p95") > 140, "latency"))
    return h.select("pilot", F.array_join(failed, ",").alias("failed"), ((F.col("retention") < 80) | (F.col("stability") < 90)).alias("rollback"))


_METRICS = ["semantic-retention", "literal-preservation", "role-accuracy", "compression-ratio", "round-trip-fidelity"]
_BASELINES = {"semantic-retention": 0.9, "literal-preservation": 0.95, "role-accuracy": 0.9, "compression-ratio": 0.8, "round-trip-fidelity": 0.92}
_VALUES = "q AS (SELECT id, c1 AS v1, c2 AS v2, CASE WHEN c1 >= 0.95 THEN 1.0 ELSE c1 END::DOUBLE AS v3, c3 AS v4, (c1 + c2) / 2 AS v5 FROM c)"
_MARGINS = "v1 - 0.9, v2 - 0.95, v3 - 0.9, 0.8 - v4, v5 - 0.92"


@query(f"WITH {_CASES}, {_VALUES}, m AS (SELECT id, list_transform([{_MARGINS}], lambda x: round(x, 6)) AS g FROM q) SELECT id, list_min(g) >= 0 AS acceptable, [{_in(_METRICS)}][list_position(g, list_min(g))] AS weakest, len(list_filter(g, lambda x: x >= 0)) AS passed FROM m")
def profile_quality(spark, d):
    """Five measures of a profile against their baselines: whether all are met, how many, and the weakest, the first of equal ones."""
    c = {k: F.col(f"c{k}") for k in (1, 2, 3)}
    values = [c[1], c[2], F.when(c[1] >= 0.95, 1.0).otherwise(c[1]), c[3], (c[1] + c[2]) / 2]
    margins = F.array(*[F.round((-1 if name == "compression-ratio" else 1) * (v - _BASELINES[name]), 6) for name, v in zip(_METRICS, values, strict=True)])
    rows = cases(spark, d).select("id", margins.alias("g")).withColumn("least", F.array_min("g"))
    return rows.select("id", (F.col("least") >= 0).alias("acceptable"), F.element_at(F.array(*map(F.lit, _METRICS)), F.array_position("g", F.col("least")).cast("int")).alias("weakest"), F.size(F.filter("g", lambda x: x >= 0)).alias("passed"))


@query(f"WITH {_CASES}, q AS (SELECT id, round((c1 + c2 + c3 + c4) / 4, 6) AS n, round((least(c1 + 0.1, 1) + c2 + c3 + least(c4 + 0.1, 1)) / 4, 6) AS l, round((c1 + least(c2 + 0.05, 1) + least(c3 + 0.03, 1) + c4) / 4, 6) AS m FROM c) SELECT id, n AS natural_score, l AS code_score, m AS mixed_score, CASE WHEN m > greatest(n, l) THEN 'mixed' WHEN l > n THEN 'lunum' ELSE 'natural' END AS best FROM q")
def context_quality(spark, d):
    """Heuristic scores of a context's three forms from accuracy, completeness, clarity and preservation; the best, the plainer of equal ones."""
    up = lambda c, by: F.least(F.col(c) + by, F.lit(1.0))
    mean = lambda *cs: F.round(sum(cs[1:], cs[0]) / 4, 6)
    c = F.col
    rows = cases(spark, d).select("id", mean(c("c1"), c("c2"), c("c3"), c("c4")).alias("natural_score"), mean(up("c1", 0.1), c("c2"), c("c3"), up("c4", 0.1)).alias("code_score"), mean(c("c1"), up("c2", 0.05), up("c3", 0.03), c("c4")).alias("mixed_score"))
    return rows.withColumn("best", F.when(c("mixed_score") > F.greatest("natural_score", "code_score"), "mixed").when(c("code_score") > c("natural_score"), "lunum").otherwise("natural"))


@query(f"WITH r AS ({_SQL['template_realization']}) SELECT ['en', 'el', 'es'][id % 3 + 1] AS lang, count(*) AS clauses, count(*) FILTER (WHERE known) AS realized, round(avg(length(text)), 6) AS mean_length FROM r GROUP BY 1")
def realization_report(spark, d):
    """Clauses by language, those that a template realizes, and their sentences' mean length."""
    rows = template_realization(spark, d)
    return rows.groupBy(_pick(["en", "el", "es"], F.col("id") % 3).alias("lang")).agg(F.count(F.lit(1)).alias("clauses"), F.count(F.when(F.col("known"), 1)).alias("realized"), F.round(F.avg(F.char_length("text")), 6).alias("mean_length"))


@query(f"WITH p AS ({_SQL['rule_parse']}) SELECT ['en', 'el', 'es', 'id'][id % 4 + 1] AS lang, predicate, count(*) AS clauses, count(*) FILTER (WHERE roles <> '') AS with_roles, count(DISTINCT id) AS sentences FROM p GROUP BY CUBE (1, 2)")
def parse_report(spark, d):
    """Clauses that rules find, by language and predicate with all totals."""
    rows = rule_parse(spark, d).select(_pick(["en", "el", "es", "id"], F.col("id") % 4).alias("lang"), "predicate", "roles", "id")
    return rows.cube("lang", "predicate").agg(F.count(F.lit(1)).alias("clauses"), F.count(F.when(F.col("roles") != "", 1)).alias("with_roles"), F.countDistinct("id").alias("sentences"))


@query("WITH o AS (SELECT ['legal_advice', 'medical_diagnosis', 'financial_advice'][o_orderkey % 3 + 1] AS domain, o_orderkey AS id, o_custkey % 4 >= 3 AS evidenced, CASE WHEN o_orderkey % 5 <> 0 THEN 'someone' ELSE ' ' END AS approver, o_orderstatus = 'F' AS revokes FROM orders), v AS (SELECT *, revokes OR (evidenced AND trim(approver) <> '') AS counts FROM o) SELECT domain, count(*) FILTER (WHERE NOT counts) AS refused, coalesce(NOT arg_max(revokes, id) FILTER (WHERE counts), false) AS opted_in FROM v GROUP BY domain")
def domain_opt_ins(spark, d):
    """Domains that are opted into: by the last opt-in with evidence and an approver, unless it was revoked since."""
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(_pick(["legal_advice", "medical_diagnosis", "financial_advice"], k % 3).alias("domain"), k.alias("id"), (F.col("o_custkey") % 4 >= 3).alias("evidenced"), F.when(k % 5 != 0, "someone").otherwise(" ").alias("approver"), (F.col("o_orderstatus") == "F").alias("revokes"))
    counts = F.col("revokes") | F.col("evidenced") & (F.trim("approver") != "")
    return o.groupBy("domain").agg(F.count(F.when(~counts, 1)).alias("refused"), F.coalesce(~F.max_by(F.when(counts, F.col("revokes")), F.when(counts, F.col("id"))), F.lit(False)).alias("opted_in"))


@query("SELECT conv_id, turn, coalesce(content, source, '') AS plain, coalesce(c1, c2, c3) AS code FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text END AS content, CASE WHEN turn % 3 <> 0 THEN lower(text) END AS source, CASE WHEN turn % 4 = 0 THEN 'a' END AS c1, CASE WHEN turn % 4 = 1 THEN 'b' END AS c2, CASE WHEN turn % 4 = 2 THEN 'c' END AS c3 FROM conversations)")
def message_normalize(spark, d):
    """A message's text and code from the fields that it may have them in."""
    k = F.col("turn")
    m = read(spark, d, "conversations").select("conv_id", "turn", F.when(k % 2 == 0, F.col("text")).alias("content"), F.when(k % 3 != 0, F.lower("text")).alias("source"), *[F.when(k % 4 == n, name).alias(f"c{n + 1}") for n, name in enumerate("abc")])
    return m.select("conv_id", "turn", F.coalesce("content", "source", F.lit("")).alias("plain"), F.coalesce("c1", "c2", "c3").alias("code"))


@query("WITH h AS (SELECT user_id AS service, event_type AS component, avg((value > 80)::INT) AS bad FROM events GROUP BY ALL), s AS (SELECT *, CASE WHEN bad > 0.2 THEN 'unhealthy' WHEN bad > 0.05 THEN 'degraded' ELSE 'ok' END AS state FROM h) SELECT service, CASE WHEN bool_or(state = 'unhealthy') THEN 'unhealthy' WHEN bool_or(state = 'degraded') THEN 'degraded' ELSE 'ok' END AS state, coalesce(string_agg(component, ',' ORDER BY component) FILTER (WHERE state = 'unhealthy'), '') AS failover FROM s GROUP BY service")
def failover_plan(spark, d):
    """The worst state of each service's components, and the components to fail over, in order."""
    h = read(spark, d, "events").groupBy(F.col("user_id").alias("service"), F.col("event_type").alias("component")).agg(F.avg((F.col("value") > 80).cast("int")).alias("bad"))
    s = h.withColumn("state", policy.decision([(F.col("bad") > 0.2, "unhealthy"), (F.col("bad") > 0.05, "degraded")], "ok"))
    has = lambda state: F.bool_or(F.col("state") == state)
    bad = F.array_sort(F.collect_list(F.when(F.col("state") == "unhealthy", F.col("component"))))
    return s.groupBy("service").agg(policy.decision([(has("unhealthy"), "unhealthy"), (has("degraded"), "degraded")], "ok").alias("state"), F.array_join(bad, ",").alias("failover"))
