"""Queries of records' and states' lives: creation, profiles, migration, submission, recovery, deletion, round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pairs, policy, sem
from .records import _FORM, _PAIRS, _SCORES, _TWINS, changed, objects
from .reports import _pick
from .surface import query, read

#: Parts of names of small and of large models.
SMALL, LARGE = ["8b", "7b", "3b", "1.5b", "1b", "small", "mini"], ["70b", "65b", "40b", "34b", "large", "xl", "max"]
_MODELS = ["Qwen-7B", "Llama-3.3-70B", "Gemma-2-27B", "mini-max", "generic"]


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _names(values: list[str], column: str) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{v}')" for v in values) + ")"


def _named(values: list[str], column: str) -> F.Column:
    out = F.lit(False)
    for v in values:
        out = out | F.contains(F.lower(column), F.lit(v))
    return out


_PROFILED = f"t2 AS (SELECT *, [{_in(_MODELS)}][id % 5 + 1] AS model, (id % 7) / 6.0 AS safe, (id % 5) / 4.0 AS short, (id % 3) / 2.0 AS tight, (id % 11) / 20.0 AS rs, (id % 13) / 20.0 AS rt FROM (SELECT event_id AS id FROM events))"
_BEST = f"CASE WHEN {_names(SMALL, 'model')} THEN CASE WHEN short >= 0.8 THEN 'short' WHEN tight >= 0.7 THEN 'tight' ELSE 'safe' END WHEN {_names(LARGE, 'model')} THEN CASE WHEN safe >= 0.95 THEN 'safe' WHEN short >= 0.9 THEN 'short' ELSE 'safe' END WHEN short >= 0.9 AND rs >= 0.2 THEN 'short' WHEN safe >= 0.95 THEN 'safe' WHEN tight >= 0.9 AND rt > rs THEN 'tight' ELSE 'short' END"


@query(f"WITH {_PROFILED} SELECT id, model, {_BEST} AS profile FROM t2")
def profile_selection(spark, d):
    """The profile for a model by its size, by what the profiles preserve and by how much they save."""
    i = F.col("event_id")
    rows = read(spark, d, "events").select(i.alias("id"), _pick(_MODELS, i % 5).alias("model"), (i % 7 / 6).alias("safe"), (i % 5 / 4).alias("short"), (i % 3 / 2).alias("tight"), (i % 11 / 20).alias("rs"), (i % 13 / 20).alias("rt"))
    c = F.col
    small = F.when(c("short") >= 0.8, "short").when(c("tight") >= 0.7, "tight").otherwise("safe")
    large = F.when(c("safe") >= 0.95, "safe").when(c("short") >= 0.9, "short").otherwise("safe")
    other = F.when((c("short") >= 0.9) & (c("rs") >= 0.2), "short").when(c("safe") >= 0.95, "safe").when((c("tight") >= 0.9) & (c("rt") > c("rs")), "tight").otherwise("short")
    return rows.select("id", "model", F.when(_named(SMALL, "model"), small).when(_named(LARGE, "model"), large).otherwise(other).alias("profile"))


#: Known models, their families, profiles and accepted profiles.
MODEL_PROFILES = [("Qwen3-Coder-30B-A3B", "qwen", "short", "safe,short"), ("Qwen3.6-35B-A3B", "qwen", "short", "safe,short"), ("Qwen3.5-4B-MTP", "qwen", "safe", "safe"), ("Llama-3.3-70B", "llama", "safe", "safe"), ("Llama-3.1-8B", "llama", "short", "safe,short"), ("Gemma-2-27B", "gemma", "short", "safe,short")]
_MODEL_ROWS = ", ".join(str(row) for row in MODEL_PROFILES)
_ASKED_MODELS = [*[m for m, *_ in MODEL_PROFILES], "unknown"]


@query(f"WITH m(model, family, profile, accepted) AS (VALUES {_MODEL_ROWS}), a AS (SELECT event_id AS id, [{_in(_ASKED_MODELS)}][event_id % 7 + 1] AS model, ['safe', 'short', 'tight'][event_id % 3 + 1] AS wanted FROM events) SELECT id, family, profile, CASE WHEN family IS NULL THEN 'unknown model' WHEN NOT list_contains(string_split(accepted, ','), wanted) THEN 'profile not accepted' END AS rejection FROM a LEFT JOIN m USING (model)")
def model_profiles(spark, d):
    """Each request's model profile, and why a strict selection would reject it."""
    known = F.broadcast(spark.createDataFrame(MODEL_PROFILES, "model string, family string, profile string, accepted string"))
    i = F.col("event_id")
    asked = read(spark, d, "events").select(i.alias("id"), _pick(_ASKED_MODELS, i % 7).alias("model"), _pick(["safe", "short", "tight"], i % 3).alias("wanted"))
    rejection = F.when(F.col("family").isNull(), "unknown model").when(~F.array_contains(F.split("accepted", ","), F.col("wanted")), "profile not accepted")
    return asked.join(known, "model", "left").select("id", "family", "profile", rejection.alias("rejection"))


@query(f"SELECT family, count(*) AS models FROM (VALUES {_MODEL_ROWS}) m(model, family, profile, accepted) GROUP BY family")
def model_families(spark, d):
    return spark.createDataFrame(MODEL_PROFILES, "model string, family string, profile string, accepted string").groupBy("family").agg(F.count(F.lit(1)).alias("models"))


_RISK = "CASE WHEN id % 7 = 0 THEN 'high' ELSE 'low' END"
_CONFIDENCE = "(id % 20) / 20.0 + 0.05"
_RECORD_WHY = f"array_to_string(list_filter([CASE WHEN {_CONFIDENCE} < 0.9 THEN 'confidence_below_0.90' END, CASE WHEN {_RISK} <> 'low' THEN 'risk_high' END, CASE WHEN id % 4 = 0 THEN 'category_not_allowlisted_fact' END], lambda x: x IS NOT NULL), ',')"


@query(f"WITH {_TWINS} SELECT id, 'lfp:0.1:sha256:' || substr(sha256({_FORM}), 1, 32) AS fp, 'R ' || CASE WHEN n THEN 'not ' ELSE '' END || CASE WHEN m THEN 'must ' ELSE '' END || 'placed_order ' || a || ' ' || v AS code, {_RECORD_WHY} AS reasons FROM t")
def create_records(spark, d):
    """Records of parsed objects: fingerprint, rendering and why they must stay in natural form. Without a category its kind is one."""
    i = F.col("id")
    category = F.when(i % 4 == 0, "fact").otherwise("preference")
    why = policy.eligibility_reasons(F.lit(""), category, F.when(i % 7 == 0, "high").otherwise("low"), i % 20 / 20 + 0.05, F.lit(True))
    return objects(spark, d).select("id", sem.sem_fingerprint("sem").alias("fp"), sem.rendered("sem").alias("code"), F.array_join(why, ",").alias("reasons"))


_FORM_02 = _FORM.replace('"modality":"must"', '"modality":"certainty"')


@query(f"WITH {_TWINS} SELECT id, 'lfp:0.2:sha256:' || substr(sha256({_FORM_02}), 1, 32) AS fp, CASE WHEN m THEN 1 ELSE 0 END AS warnings, NOT m AS preserved FROM t")
def migrate_forward(spark, d):
    """Fingerprints in the later schema, warnings, and whether the digest stays the same."""
    digest = lambda c: F.element_at(F.split(c, ":"), 4)
    rows = objects(spark, d).select("id", sem.sem_fingerprint("sem").alias("old"), sem.forward_fingerprint("sem").alias("fp"), sem.forward_warnings("sem").alias("w"))
    return rows.select("id", "fp", F.size("w").alias("warnings"), (digest(F.col("old")) == digest(F.col("fp"))).alias("preserved"))


@query(f"WITH {_TWINS} SELECT id % 2 AS twin, count(*) AS total, count(*) FILTER (WHERE m) AS changed, count(*) FILTER (WHERE NOT m) AS kept FROM t GROUP BY 1")
def migration_dry_run(spark, d):
    """How many fingerprints' digests a migration would change."""
    rows = migrate_forward(spark, d)
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy((F.col("id") % 2).alias("twin")).agg(F.count(F.lit(1)).alias("total"), count(~F.col("preserved")).alias("changed"), count(F.col("preserved")).alias("kept"))


@query(f"WITH {_TWINS} SELECT id, CASE WHEN id % 3 = 0 THEN 'lsf:1.0:sha256:' || substr(sha256('object ' || id), 1, 24) ELSE 'lfp:1.0:sha256:' || substr(sha256({_FORM}), 1, 32) END AS fp FROM t")
def computed_fingerprints(spark, d):
    """Contract fingerprints: of objects semantic ones, of other texts surface ones."""
    value = F.when(F.col("id") % 3 == 0, F.concat(F.lit("  Object "), "id")).otherwise(F.col("sem"))
    return objects(spark, d).select("id", sem.computed_fingerprint(value).alias("fp"))


# Submissions: events of one user and type are tries of one key; some fail.
_SUBMITTED = "s AS (SELECT event_id AS id, user_id || ':' || event_type AS key, ts, value < 60 AS ok FROM events)"


@query(f"WITH {_SUBMITTED}, w AS (SELECT *, coalesce(bool_or(ok) OVER p, false) AS done, coalesce(count(*) FILTER (WHERE NOT ok) OVER p, 0) AS failed FROM s WINDOW p AS (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT id, CASE WHEN done THEN 'duplicate-replayed' WHEN ok THEN 'applied' ELSE 'failed' END AS outcome, first AS attempts FROM (SELECT *, CASE WHEN done THEN (SELECT count(*) FROM s x WHERE x.key = w.key AND NOT x.ok AND x.id < (SELECT min(y.id) FROM s y WHERE y.key = w.key AND y.ok)) + 1 ELSE failed + 1 END AS first FROM w)")
def idempotent_submit(spark, d):
    """What each try of a key comes to: applied, failed, or the replay of one that was applied; attempts count failures before it."""
    s = read(spark, d, "events").select(F.col("event_id").alias("id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), (F.col("value") < 60).alias("ok"))
    p = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    w = s.withColumn("done", F.coalesce(F.max("ok").over(p), F.lit(False))).withColumn("failed", F.when(~F.col("done"), F.count(F.when(~F.col("ok"), 1)).over(p)))
    # attempts stay what they were when the key was applied
    attempts = F.last("failed", ignorenulls=True).over(Window.partitionBy("key").orderBy("id")) + 1
    return w.withColumn("attempts", attempts).select("id", F.when(F.col("done"), "duplicate-replayed").when(F.col("ok"), "applied").otherwise("failed").alias("outcome"), "attempts")


@query(f"WITH {_SUBMITTED}, k AS (SELECT key, bool_or(ok) AS done, coalesce(min(ts) FILTER (WHERE ok), min(ts)) AS anchor FROM s GROUP BY key), n AS (SELECT max(ts) AS now FROM s) SELECT key, done, epoch_us(now) - epoch_us(anchor) > 604800000000 AS pruned FROM k, n")
def idempotency_prune(spark, d):
    """Which keys are forgotten a week after they were applied or, if never, first seen."""
    events = read(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("value") < 60).alias("ok"))
    k = events.groupBy("key").agg(F.max("ok").alias("done"), F.coalesce(F.min(F.when(F.col("ok"), F.col("t"))), F.min("t")).alias("anchor"))
    now = F.broadcast(events.agg(F.max("t").alias("now")))  # one row
    return k.join(now).select("key", "done", (F.col("now") - F.col("anchor") > 7 * 86_400_000_000).alias("pruned"))


@query("WITH s AS (SELECT l_orderkey AS plan, l_linenumber AS step, ['completed', 'running', 'failed', 'pending', 'abandoned'][l_partkey % 5 + 1] AS status, l_quantity > 20 AS last_ok FROM lineitem) SELECT plan, step, CASE WHEN status = 'completed' THEN 'replayed' ELSE 'skipped' END AS replay, CASE WHEN status = 'running' AND last_ok THEN 'pending' WHEN status = 'running' THEN 'abandoned' ELSE status END AS recovered FROM s")
def step_recovery(spark, d):
    """What a replay does with each step of a plan, and its status after an interruption."""
    status = _pick(["completed", "running", "failed", "pending", "abandoned"], F.col("l_partkey") % 5)
    s = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("step"), status.alias("status"), (F.col("l_quantity") > 20).alias("ok"))
    recovered = F.when((F.col("status") == "running") & F.col("ok"), "pending").when(F.col("status") == "running", "abandoned").otherwise(F.col("status"))
    return s.select("plan", "step", F.when(F.col("status") == "completed", "replayed").otherwise("skipped").alias("replay"), recovered.alias("recovered"))


@query("SELECT o_orderkey AS plan, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'missing planId' END, CASE WHEN o_orderkey % 7 = 0 THEN 'missing agentId' END, CASE WHEN o_orderkey % 4 = 3 THEN 'invalid role: guest' END, CASE WHEN o_orderkey % 11 = 0 THEN 'step missing id' END], lambda x: x IS NOT NULL), '; ') AS errors FROM orders")
def agent_state_errors(spark, d):
    """What a stored state lacks, in order."""
    k = F.col("o_orderkey")
    state = read(spark, d, "orders").select(k.alias("plan"), F.when(k % 5 != 0, "p").alias("planId"), F.when(k % 7 != 0, "a").alias("agentId"), _pick(["orchestrator", "worker", "auditor", "guest"], k % 4).alias("role"), F.when(k % 11 != 0, "s").alias("stepId"))
    errors = policy.reasons((F.col("planId").isNull(), "missing planId"), (F.col("agentId").isNull(), "missing agentId"), (~F.col("role").isin("orchestrator", "worker", "reviewer", "auditor"), F.concat(F.lit("invalid role: "), "role")), (F.col("stepId").isNull(), "step missing id"))
    return state.select("plan", F.array_join(errors, "; ").alias("errors"))


@query("WITH r AS (SELECT o_orderkey, ['cold', 'deleted'][o_orderkey % 2 + 1] AS phase, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS deleted_at, CASE WHEN o_orderkey % 5 <> 0 THEN 'ttl' END AS trigger_, o_orderkey % 11 = 0 AS held FROM orders), n AS (SELECT quantile_disc(o_orderdate, 0.9) AS now FROM orders) SELECT o_orderkey, phase = 'deleted' AND deleted_at IS NOT NULL AND coalesce(deleted_at <= now, false) AS deleted, array_to_string(list_filter([CASE WHEN phase <> 'deleted' THEN 'phase' END, CASE WHEN deleted_at IS NULL THEN 'no time' WHEN deleted_at > now THEN 'in the future' END, CASE WHEN trigger_ IS NULL THEN 'no trigger' END, CASE WHEN held THEN 'on hold' END], lambda x: x IS NOT NULL), ',') AS issues FROM r, n")
def deletion_verify(spark, d):
    """Whether a record is deleted, and what speaks against it."""
    k = F.col("o_orderkey")
    orders = read(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    now = F.broadcast(orders.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY unix_micros(o_orderdate))").alias("now")))  # one row
    r = orders.join(now).select("o_orderkey", _pick(["cold", "deleted"], k % 2).alias("phase"), F.when(k % 3 != 0, F.unix_micros("o_orderdate")).alias("at"), F.when(k % 5 != 0, "ttl").alias("trigger"), (k % 11 == 0).alias("held"), "now")
    late = F.col("at") > F.col("now")
    issues = policy.reasons((F.col("phase") != "deleted", "phase"), (F.col("at").isNull(), "no time"), (late, "in the future"), (F.col("trigger").isNull(), "no trigger"), (F.col("held"), "on hold"))
    return r.select("o_orderkey", ((F.col("phase") == "deleted") & F.coalesce(~late, F.lit(False))).alias("deleted"), F.array_join(issues, ",").alias("issues"))


_CLASSES = ["public", "internal", "confidential", "restricted"]


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN '***' || right(o_clerk_, 8) ELSE o_clerk_ END AS handle FROM (SELECT o_orderkey, 'record-' || lpad(o_orderkey::VARCHAR, 9, '0') AS o_clerk_ FROM orders)")
def privacy_redaction(spark, d):
    """Handles of records of a higher privacy class than internal, but for their ends."""
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(k, F.concat(F.lit("record-"), F.lpad(k.cast("string"), 9, "0")).alias("h"), _pick(_CLASSES, k % 4).alias("class"))
    rank = F.array_position(F.array(*map(F.lit, _CLASSES)), F.col("class"))
    return rows.select("o_orderkey", F.when(rank > 2, F.concat(F.lit("***"), F.right("h", F.lit(8)))).otherwise(F.col("h")).alias("handle"))


@query(f"WITH {_PAIRS}, {_SCORES} SELECT id, array_to_string(list_filter([CASE WHEN kind BETWEEN 1 AND 5 THEN 'hard_invariant_mismatch' END, CASE WHEN recall < 0.75 THEN 'low_recall' END, CASE WHEN precision < 0.8 THEN 'low_precision' END], lambda x: x IS NOT NULL), ',') AS failures, CASE WHEN kind BETWEEN 1 AND 5 OR recall < 0.75 OR precision < 0.8 THEN 'fallback' ELSE 'commit' END AS route FROM r")
def round_trips(spark, d):
    """What fails when an object comes back changed, and where it goes."""
    found = changed(spark, d).select("id", pairs.gated_compare("a", "b").alias("c"))
    failures = policy.reasons((F.size("c.firings") > 0, "hard_invariant_mismatch"), (F.col("c.recall") < 0.75, "low_recall"), (F.col("c.precision") < 0.8, "low_precision"))
    return found.select("id", F.array_join(failures, ",").alias("failures"), F.when(F.size(failures) > 0, "fallback").otherwise("commit").alias("route"))


@query(f"WITH {_PAIRS}, {_SCORES}, g AS (SELECT id // 50 AS item, kind, recall, CASE WHEN kind IN (0, 6) THEN 'same' ELSE kind::VARCHAR END AS outcome FROM r), c AS (SELECT item, outcome, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT item, max(n) AS most, sum(n) AS total, count(*) AS distinct_ FROM c GROUP BY item), u AS (SELECT item, max(recall) - min(recall) AS margin FROM g GROUP BY item) SELECT item, distinct_ AS outcomes, round(most / total, 6) AS agreement, round(margin, 6) AS margin, (distinct_ > 1 AND most / total < 0.6) OR margin > 0.2 AS ambiguous FROM m JOIN u USING (item)")
def ambiguity(spark, d):
    """Whether an item's candidates disagree: by the share of their most frequent outcome, and by the span of their recall."""
    found = changed(spark, d).select(F.floor(F.col("id") / 50).alias("item"), F.when(F.col("kind").isin(0, 6), "same").otherwise(F.col("kind").cast("string")).alias("outcome"), pairs.gated_compare("a", "b")["recall"].alias("recall"))
    counts = found.groupBy("item", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("recall").alias("hi"), F.min("recall").alias("lo"))
    m = counts.groupBy("item").agg(F.count(F.lit(1)).alias("outcomes"), (F.max("n") / F.sum("n")).alias("a"), (F.max("hi") - F.min("lo")).alias("margin"))
    return m.select("item", "outcomes", F.round("a", 6).alias("agreement"), F.round("margin", 6).alias("margin"), ((F.col("outcomes") > 1) & (F.col("a") < 0.6) | (F.col("margin") > 0.2)).alias("ambiguous"))


_SEARCH = "round((recall + precision) / 2, 6)"


@query(f"WITH {_PAIRS}, {_SCORES} SELECT id, {_SEARCH} AS score FROM r WHERE {_SEARCH} >= 0.9")
def similarity_search(spark, d):
    """Pairs whose mean of recall and precision is at least 0.9."""
    found = changed(spark, d).select("id", pairs.gated_compare("a", "b").alias("c"))
    return found.select("id", F.round((F.col("c.recall") + F.col("c.precision")) / 2, 6).alias("score")).where("score >= 0.9")


@query(f"WITH {_PAIRS}, {_SCORES} SELECT grp, id, rank::INTEGER AS rank FROM (SELECT id // 20 AS grp, id, row_number() OVER (PARTITION BY id // 20 ORDER BY kind = 0 DESC, recall DESC, id) AS rank FROM r WHERE recall > 0.3 OR kind = 0) WHERE rank <= 3")
def cross_language_match(spark, d):
    """The best three of each group: exact matches first, then by recall."""
    found = changed(spark, d).select("id", F.floor(F.col("id") / 20).alias("grp"), pairs.gated_compare("a", "b").alias("c")).where("c.recall > 0.3 or c.exact_canonical")
    w = Window.partitionBy("grp").orderBy(F.desc("c.exact_canonical"), F.desc("c.recall"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("grp", "id", "rank")


@query("SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'web'")
def tag_lookup(spark, d):
    """Documents with one of two tags."""
    tags = F.array("lang", "source")
    return read(spark, d, "documents").where(F.arrays_overlap(tags, F.array(F.lit("de"), F.lit("web")))).select("doc_id")


@query("WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey > 1 AND c_custkey % 3 <> 0), w AS (SELECT a AS start, b AS now, 1 AS steps FROM e UNION ALL SELECT w.start, e.b, w.steps + 1 FROM w JOIN e ON w.now = e.a) SELECT start, max(steps)::BIGINT AS steps, min(now) AS last FROM w GROUP BY start")
def supersession_chains(spark, d):
    """How far each record's chain of successors goes, and its end."""
    from ..operators import ordering

    edges = read(spark, d, "customer").where("c_custkey > 1 and c_custkey % 3 <> 0").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 2).alias("b"))
    walks = ordering.lineage(edges, "a", "b")
    return walks.groupBy(F.col("ancestor").alias("start")).agg(F.max("depth").cast("long").alias("steps"), F.min("node").alias("last"))
