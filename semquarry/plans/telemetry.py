"""Queries over events and relational tables: latencies, telemetry, sessions, chains, lineage, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..operators import metrics, ordering, state
from .surface import query, read

_E = "events"


@query("SELECT event_type, count(value) AS n, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_disc(value, 0.95), 6) AS p95_nearest FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return metrics.latency_summary(read(spark, d, _E), "value", ["event_type"])


@query("SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean, round(quantile_disc(value, 0.5), 3) AS median_low, round(median(value), 3) AS median_mid, round(coalesce(stddev_samp(value), 0), 3) AS sd, round(stddev_pop(value), 3) AS sd_pop, round(quantile_disc(value, 0.75) - quantile_disc(value, 0.25), 3) AS iqr FROM events GROUP BY event_type")
def descriptive_stats(spark, d):
    return metrics.descriptive(read(spark, d, _E), "value", ["event_type"])


BOUNDS = [1, 5, 10, 25, 50, 100, 250, 500, 1000]
_BUCKET = "CASE " + " ".join(f"WHEN value <= {b} THEN {float(b)}" for b in BOUNDS) + " ELSE 'inf'::DOUBLE END"


@query(f"SELECT event_type, ({_BUCKET})::DOUBLE AS upto, count(*) AS n FROM events GROUP BY 1, 2")
def latency_histogram(spark, d):
    return metrics.histogram(read(spark, d, _E), F.col("value"), BOUNDS, ["event_type"])


@query("SELECT user_id, sum(n)::BIGINT AS total, arg_max(event_type, n * 1000 - ascii(event_type)) AS dominant, CASE WHEN sum(n) >= 60 THEN 'high' WHEN sum(n) >= 40 THEN 'medium' ELSE 'low' END AS urgency FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id HAVING sum(n) >= 20")
def hotspots(spark, d):
    by_type = read(spark, d, _E).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return by_type.groupBy("user_id").agg(total.alias("total"), F.max_by("event_type", F.col("n") * 1000 - F.ascii("event_type")).alias("dominant")).where("total >= 20").withColumn("urgency", F.when(F.col("total") >= 60, "high").when(F.col("total") >= 40, "medium").otherwise("low"))


_GROUPING = "SELECT event_type, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type), (hour(ts)), ())"


@query(_GROUPING)
def correction_grouping_sets(spark, d):
    rows = read(spark, d, _E).select("event_type", F.hour("ts").cast("long").alias("hour"), "value")
    return rows.groupingSets([[F.col("event_type")], [F.col("hour")], []], F.col("event_type"), F.col("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, event_id, round((epoch_us(ts) - epoch_us(before)) / 1e6, 6) AS gap_s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND epoch_us(ts) - epoch_us(before) > 3600000000")
def session_gaps(spark, d):
    """Pauses of over an hour between a user's events; a user's events are taken day by day."""
    rows = read(spark, d, _E).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    found = ordering.previous(rows, "user_id", ["_at", "event_id"], "_at", F.floor(F.col("_at") / 86_400_000_000), "earlier")
    gap = F.col("_at") - F.col("earlier")
    return found.where(gap > 3600000000).select("user_id", "event_id", F.round(gap / 1e6, 6).alias("gap_s"))


def _timed(spark, d):
    return read(spark, d, _E).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("value") < 60).alias("ok"), "event_type", "ts")


_ORDERED = "o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, value < 60 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(f"WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, event_id, k, sec AS opened, 1 AS n, true AS allowed FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.sec - f.opened >= 86400 THEN o.sec ELSE f.opened END, CASE WHEN o.sec - f.opened >= 86400 THEN 1 ELSE least(f.n + 1, 2) END, o.sec - f.opened >= 86400 OR f.n < 2 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) SELECT user_id, event_id, allowed FROM f")
def rate_limit_fixed(spark, d):
    return state.fold(_timed(spark, d).select("user_id", "event_id", "at"), "user_id", ["at", "event_id"], state.limiter(86400.0, 2), "allowed", "boolean").select("user_id", "event_id", "allowed")


_STATE = "CASE f.state WHEN 'closed' THEN CASE WHEN NOT o.ok AND f.n + 1 >= 3 THEN 'open' ELSE 'closed' END WHEN 'open' THEN CASE WHEN o.ok THEN 'half-open' ELSE 'open' END ELSE CASE WHEN o.ok THEN 'closed' ELSE 'open' END END"
_FAILED = "CASE f.state WHEN 'closed' THEN CASE WHEN o.ok THEN 0 ELSE f.n + 1 END WHEN 'half-open' THEN CASE WHEN o.ok THEN 0 ELSE f.n END ELSE f.n END"


@query(f"WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, event_id, k, (NOT ok)::INT AS n, 'closed' AS state FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, {_FAILED}, {_STATE} FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) SELECT user_id, event_id, state FROM f")
def circuit_breaker_fold(spark, d):
    return state.fold(_timed(spark, d).select("user_id", "event_id", "at", "ok"), "user_id", ["at", "event_id"], state.breaker(3), "state", "string").select("user_id", "event_id", "state")


_SESSION = "s AS (SELECT user_id, event_id, ts, ['add', 'update', 'contradict', 'retrieve', 'expire'][event_id % 5 + 1] AS type, 'k' || event_id % 3 AS item FROM events), b AS (SELECT *, last_value(CASE WHEN type IN ('add', 'update') THEN 'live' WHEN type <> 'retrieve' THEN type END IGNORE NULLS) OVER (PARTITION BY user_id, item ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM s)"


@query(f"WITH {_SESSION} SELECT user_id, event_id, CASE WHEN type = 'add' AND old = 'live' THEN 'conflict' WHEN type = 'retrieve' THEN CASE WHEN old = 'live' THEN 'fresh' WHEN old IS NULL THEN 'missing' ELSE 'stale' END ELSE type END AS label FROM b")
def session_conflicts(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ["add", "update", "contradict", "retrieve", "expire"])), (F.col("event_id") % 5 + 1).cast("int"))
    rows = _timed(spark, d).select("user_id", "event_id", "at", kinds.alias("type"), F.concat(F.lit("k"), F.col("event_id") % 3).alias("item"))
    return state.fold(rows, "user_id", ["at", "event_id"], state.session(), "label", "string").select("user_id", "event_id", "label")


# Orders as records: their phase, how long they have had it, and their policy's times by order priority.
_TTL = {"active": 10, "frozen": 30, "warm": 90, "cold": 200}


@query("WITH r AS (SELECT o_orderkey, ['active', 'frozen', 'warm', 'cold', 'deleted'][o_orderkey % 5 + 1] AS phase, (o_custkey % 300)::BIGINT AS days, o_orderkey % 11 = 0 AS hold FROM orders) SELECT o_orderkey, phase, CASE WHEN hold OR phase = 'deleted' THEN phase WHEN phase = 'active' AND days >= 10 THEN 'frozen' WHEN phase = 'frozen' AND days >= 30 THEN 'warm' WHEN phase = 'warm' AND days >= 90 THEN 'cold' WHEN phase = 'cold' AND days >= 200 THEN 'deleted' ELSE phase END AS next FROM r")
def retention_phase(spark, d):
    """One step of each record's phases, by the time that it has been in its phase."""
    phase = F.element_at(F.array(*map(F.lit, policy.PHASES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = read(spark, d, "orders").select("o_orderkey", phase.alias("phase"), (F.col("o_custkey") % 300 * 86400).alias("elapsed"), (F.col("o_orderkey") % 11 == 0).alias("hold"))
    return rows.select("o_orderkey", "phase", policy.next_phase(F.col("phase"), F.col("elapsed"), F.col("hold"), {k: F.lit(v * 86400) for k, v in _TTL.items()}).alias("next"))


@query("SELECT l_orderkey, (l_linenumber + 1)::BIGINT AS gap_from, (nxt - 1)::BIGINT AS gap_to FROM (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nxt FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey + l_linenumber) % 3 <> 0)) WHERE nxt > l_linenumber + 1")
def audit_gap_detect(spark, d):
    out = ordering.gaps(read(spark, d, "lineitem").where("(l_orderkey + l_linenumber) % 3 <> 0"), ["l_orderkey"], "l_linenumber")
    return out.select("l_orderkey", F.col("gap_from").cast("long").alias("gap_from"), F.col("gap_to").cast("long").alias("gap_to"))


@query("SELECT a.event_id, a.user_id, round(b.value, 6) AS value_as_of FROM (SELECT * FROM events WHERE event_id % 4 = 0) a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 4 <> 0 GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def checkpoint_asof(spark, d):
    events = read(spark, d, _E)
    left = events.where("event_id % 4 = 0").select("event_id", "user_id", "ts")
    right = events.where("event_id % 4 <> 0").select("user_id", "ts", "value")
    return ordering.as_of(left, right, "user_id", "ts", "ts", "value", F.to_date).select("event_id", "user_id", F.round("value_as_of", 6).alias("value_as_of"))


@query("WITH c AS (SELECT user_id, event_id, row_number() OVER w - 1 AS idx, sha256(event_id::VARCHAR) AS own, CASE WHEN event_id % 97 = 0 THEN 'forged' ELSE lag(sha256(event_id::VARCHAR)) OVER w END AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id FROM (SELECT *, lag(own) OVER (PARTITION BY user_id ORDER BY idx) AS want FROM c) WHERE prev IS DISTINCT FROM want")
def hash_chain_verify(spark, d):
    w = ordering.Window.partitionBy("user_id").orderBy("event_id")
    own = F.sha2(F.col("event_id").cast("string"), 256)
    chain = read(spark, d, _E).select("user_id", "event_id", (F.row_number().over(w) - 1).alias("idx"), own.alias("own"), F.when(F.col("event_id") % 97 == 0, "forged").otherwise(F.lag(own).over(w)).alias("prev"))
    return ordering.chain_breaks(chain, ["user_id"], "idx", "own", "prev").select("user_id", "event_id")


@query("WITH RECURSIVE e AS (SELECT c_custkey AS p, c_custkey * 2 AS c FROM customer UNION SELECT c_custkey, c_custkey * 2 + 1 FROM customer), walk AS (SELECT p AS ancestor, c AS node, 1 AS depth FROM e WHERE p <> c UNION ALL SELECT w.ancestor, e.c, w.depth + 1 FROM walk w JOIN e ON w.node = e.p AND e.p <> e.c) SELECT ancestor, node, min(depth)::INTEGER AS depth FROM walk GROUP BY 1, 2")
def lineage_recursive(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("p"))
    edges = c.select("p", F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1)).alias("c"))
    return ordering.lineage(edges, "p", "c")


@query("SELECT event_type, availability, p95, availability >= 0.5 AND p95 <= 200 AS met, round((200 - p95) / 200 * 100, 4) AS margin_pct FROM (SELECT event_type, round(avg((value < 100)::INTEGER), 6) AS availability, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY event_type)")
def slo_join(spark, d):
    measured = read(spark, d, _E).groupBy("event_type").agg(F.round(F.avg((F.col("value") < 100).cast("int")), 6).alias("availability"), F.round(metrics.nearest_rank("value", 0.95), 6).alias("p95"))
    slo = F.broadcast(spark.createDataFrame([(0.5, 200.0)], "_least double, _most double"))  # one row
    return measured.join(slo).select("event_type", "availability", "p95", ((F.col("availability") >= F.col("_least")) & (F.col("p95") <= F.col("_most"))).alias("met"), F.round((F.col("_most") - F.col("p95")) / F.col("_most") * 100, 4).alias("margin_pct"))


@query("SELECT o_orderpriority, list_sort(list(c))[1] AS first_best, count(*) AS ties, n FROM (SELECT o_orderpriority, o_orderstatus AS c, count(*) AS n, rank() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC) AS r FROM orders GROUP BY 1, 2) WHERE r = 1 GROUP BY o_orderpriority, n")
def best_model_ties(spark, d):
    counted = read(spark, d, "orders").groupBy("o_orderpriority", F.col("o_orderstatus").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("r", F.rank().over(ordering.Window.partitionBy("o_orderpriority").orderBy(F.desc("n")))).where("r = 1")
    return ranked.groupBy("o_orderpriority", "n").agg(F.min("c").alias("first_best"), F.count(F.lit(1)).alias("ties"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def except_features(spark, d):
    orders = read(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_custkey").subtract(orders.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def ring_buffer_latest(spark, d):
    return ordering.top_k(read(spark, d, _E), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "event_type")


@query("SELECT CASE WHEN c < 0.55 OR m > 2 THEN 'fallback' WHEN c < 0.7 OR m > 0 THEN 'review' WHEN h THEN 'review' ELSE 'store' END AS decision, count(*) AS n FROM (SELECT value / 100 AS c, event_id % 4 AS m, event_type = 'purchase' AS h FROM events) GROUP BY 1")
def fallback_decision(spark, d):
    decided = policy.fallback_decision(F.col("value") / 100, F.col("event_id") % 4, F.col("event_type") == "purchase")
    return read(spark, d, _E).groupBy(decided.alias("decision")).agg(F.count(F.lit(1)).alias("n"))
