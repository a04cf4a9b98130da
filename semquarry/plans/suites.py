"""Queries of suites of checks: sensitivity, calibration, attacks, properties, consistency, plans, goldens, memory contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pairs, policy, sem, text
from .lifecycle import _in
from .records import _FORM, _PAIRS, _SCORES, _TWINS, changed, objects, profile_round_trip
from .reports import _pick
from .surface import _LEAK_ROWS, _LEAKS, NORM, TELEGRAPH, _quoted, query, read

#: Dimensions of the sensitivity suite with their magnitudes, and components with their weights and whether critical.
DIMENSIONS = [("threshold-variation", 0.05), ("input-perturbation", 0.03), ("weight-shift", 0.1), ("feature-dropout", 0.08), ("noise-injection", 0.04)]
COMPONENTS = [("exact-match", 0.25, False), ("feature-recall", 0.2, False), ("role-identity", 0.15, True), ("negation-check", 0.15, True), ("modality-check", 0.15, True), ("literal-integrity", 0.1, False)]


def seed(column: F.Column) -> F.Column:
    """A number in [0, 1] from a text, by a 32-bit hash of its characters."""
    codes = F.transform(F.split(column, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * 16777619, F.lit(2**32))) / 4294967295.0


_SEED = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(k) + 1), lambda i: unicode(k[i])::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) / 4294967295.0::DOUBLE"
_DIMENSION_ROWS = ", ".join(f"('{d}', {m}::DOUBLE)" for d, m in DIMENSIONS)
_COMPONENT_ROWS = ", ".join(f"('{c}', {w}::DOUBLE, {str(k).lower()})" for c, w, k in COMPONENTS)


@query(f"WITH s AS (SELECT d, m, c, w, critical, {_SEED} AS s FROM (SELECT *, d || ':' || c AS k FROM (VALUES {_DIMENSION_ROWS}) x(d, m), (VALUES {_COMPONENT_ROWS}) y(c, w, critical))), r AS (SELECT *, round((0.85::DOUBLE + w * 0.3::DOUBLE + s * 0.05::DOUBLE) * 1000) / 1000 AS base FROM s), p AS (SELECT *, round((round((base + (s - 0.5::DOUBLE) * m * 0.6::DOUBLE) * 1000) / 1000 - base) * 1000) / 1000 AS delta FROM r) SELECT d AS dimension, c AS component, base AS baseline, delta, abs(delta) <= CASE WHEN critical THEN 0.02 ELSE 0.05 END AS stable, abs(delta) <= m * 0.5 AS confident FROM p")
def scorer_sensitivity(spark, d):
    """How each component of a score moves under each perturbation, by the suite's seeded model."""
    dims, parts = spark.createDataFrame(DIMENSIONS, "dimension string, m double"), spark.createDataFrame(COMPONENTS, "component string, w double, critical boolean")
    rows = dims.crossJoin(parts).withColumn("s", seed(F.concat_ws(":", "dimension", "component")))
    thousandths = lambda x: F.round(x * 1000) / 1000
    rows = rows.withColumn("baseline", thousandths(0.85 + F.col("w") * 0.3 + F.col("s") * 0.05))
    rows = rows.withColumn("delta", thousandths(thousandths(F.col("baseline") + (F.col("s") - 0.5) * F.col("m") * 0.6) - F.col("baseline")))
    return rows.select("dimension", "component", "baseline", "delta", (F.abs("delta") <= F.when(F.col("critical"), 0.02).otherwise(0.05)).alias("stable"), (F.abs("delta") <= F.col("m") * 0.5).alias("confident"))


_THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(11)]


@query(f"WITH {_PAIRS}, {_SCORES}, q AS (SELECT kind IN (0, 6) AS same, round((recall + precision) / 2, 6) AS score FROM r), c AS (SELECT t, count(*) FILTER (WHERE score >= t AND same) AS tp, count(*) FILTER (WHERE score >= t AND NOT same) AS fp, count(*) FILTER (WHERE score < t AND same) AS fn, count(*) AS n FROM q, (SELECT unnest({_THRESHOLDS})::DOUBLE AS t) GROUP BY t), f AS (SELECT t AS threshold, tp, fp, fn, round((n - fp - fn) / n::DOUBLE, 6) AS accuracy, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1 FROM c) SELECT *, f1 = (SELECT max(f1) FROM f) AS best FROM f")
def calibration(spark, d):
    """Confusion of the pairs at each threshold of their score, and which thresholds have the best f1."""
    c = pairs.gated_compare("a", "b")
    s = changed(spark, d).select(F.col("kind").isin(0, 6).alias("same"), c.alias("c")).select("same", F.round((F.col("c.recall") + F.col("c.precision")) / 2, 6).alias("score"))
    swept = s.groupBy("same", "score").agg(F.count(F.lit(1)).alias("n")).withColumn("threshold", F.explode(F.array(*map(F.lit, _THRESHOLDS))))  # counts are swept, not pairs
    above, total = F.col("score") >= F.col("threshold"), lambda k: F.coalesce(F.sum(F.when(k, F.col("n"))), F.lit(0))
    f = swept.groupBy("threshold").agg(total(above & F.col("same")).alias("tp"), total(above & ~F.col("same")).alias("fp"), total(~above & F.col("same")).alias("fn"), F.sum("n").alias("n"))
    wrong = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f = f.select("threshold", "tp", "fp", "fn", F.round((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n"), 6).alias("accuracy"), F.round(F.when(wrong == 0, 0.0).otherwise(2 * F.col("tp") / wrong), 6).alias("f1"))
    return f.join(F.broadcast(f.agg(F.max("f1").alias("_best")))).withColumn("best", F.col("f1") == F.col("_best")).drop("_best")  # eleven rows


# Attacks: objects with a fault that their ids choose.
_ATTACKS = ["none", "blank world", "wrong schema", "no clauses", "spaces"]


def attacked(spark, d) -> DataFrame:
    """id, attack, sem: objects with a blank world, another schema, no clauses, or spaces that normalization takes away."""
    s = F.col("sem")
    faulty = F.when(F.col("id") % 5 == 1, F.replace(s, F.lit('"world":"real"'), F.lit('"world":" "'))).when(F.col("id") % 5 == 2, F.replace(s, F.lit('"schema":"lunum-sem/0.1-draft"'), F.lit('"schema":"x"'))).when(F.col("id") % 5 == 3, F.regexp_replace(s, r'"clauses":\[.*\]', '"clauses":[]')).when(F.col("id") % 5 == 4, F.replace(s, F.lit('"kind":"fact"'), F.lit('"kind":" FACT "'))).otherwise(s)
    return objects(spark, d).select("id", _pick(_ATTACKS, F.col("id") % 5).alias("attack"), faulty.alias("sem"))


_ERROR = "CASE id % 5 WHEN 1 THEN 'world is required' WHEN 2 THEN 'schema must equal lunum-sem/0.1-draft' WHEN 3 THEN 'clauses must be a non-empty array' ELSE '' END"


@query(f"WITH {_TWINS} SELECT id, [{_in(_ATTACKS)}][id % 5 + 1] AS attack, {_ERROR} AS errors, CASE WHEN id % 5 IN (1, 2, 3) THEN 'rejected' ELSE 'normalized' END AS outcome, CASE WHEN id % 5 IN (0, 4) THEN 'lfp:0.1:sha256:' || substr(sha256({_FORM}), 1, 32) END AS fp FROM t")
def red_team(spark, d):
    """What becomes of attacks: rejected with errors, or normalized to the fingerprint of the object without them."""
    found = attacked(spark, d).select("id", "attack", F.array_join(sem.validation_errors("sem"), "; ").alias("errors"), sem.sem_fingerprint("sem").alias("fp"))
    return found.select("id", "attack", "errors", F.when(F.col("errors") != "", "rejected").otherwise("normalized").alias("outcome"), "fp")


@query(f"WITH {_TWINS} SELECT attack, count(*) AS n, count(*) FILTER (WHERE attack IN ('none', 'spaces')) AS passed FROM (SELECT [{_in(_ATTACKS)}][id % 5 + 1] AS attack FROM t) GROUP BY attack")
def conformance_suite(spark, d):
    """Objects of each kind that conform to the schema."""
    found = attacked(spark, d).select("attack", (F.size(sem.validation_errors("sem")) == 0).alias("ok"))
    return found.groupBy("attack").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("passed"))


@query(f"WITH {_TWINS}, p AS (SELECT id, unnest([{{'property': 'schema', 'ok': id % 5 <> 2}}, {{'property': 'world', 'ok': true}}, {{'property': 'kind', 'ok': true}}, {{'property': 'clauses', 'ok': id % 5 <> 3}}, {{'property': 'negation', 'ok': true}}, {{'property': 'modality', 'ok': true}}], recursive := true) FROM t) SELECT property, count(*) AS n, count(*) FILTER (WHERE ok) AS passed FROM p GROUP BY property")
def property_checks(spark, d):
    """Structural properties of objects, by variant functions: no Python."""
    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    v = attacked(spark, d).select(F.expr("parse_json(sem)").alias("v"))
    filled = lambda name: F.coalesce(F.char_length(get(name, "string")) > 0, F.lit(False))
    clauses = get("clauses", "array<variant>")
    every = lambda path, kind: F.forall(F.coalesce(clauses, F.array().cast("array<variant>")), lambda c: F.call_function("is_variant_null", F.call_function("try_variant_get", c, F.lit(path), F.lit("variant"))) | F.call_function("try_variant_get", c, F.lit(path), F.lit("variant")).isNull() | F.call_function("try_variant_get", c, F.lit(path), F.lit(kind)).isNotNull())
    checks = {"schema": F.coalesce(get("schema", "string") == sem.SCHEMA, F.lit(False)), "world": filled("world"), "kind": filled("kind"), "clauses": F.coalesce(F.size(clauses) > 0, F.lit(False)), "negation": every("$.negated", "boolean"), "modality": every("$.modality", "string")}
    rows = v.select(F.explode(F.array(*[F.struct(F.lit(name).alias("property"), ok.alias("ok")) for name, ok in checks.items()])).alias("x"))
    return rows.groupBy("x.property").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("x.ok"), 1)).alias("passed"))


@query(f"WITH {_TWINS} SELECT id, 'lfp:0.1:sha256:' || substr(sha256({_FORM}), 1, 32) AS fp, true AS agrees FROM t")
def independent_fingerprints(spark, d):
    """Fingerprints taken a second way, JVM-side: variants keep keys in order, so that printing one again gives canonical bytes."""
    form = objects(spark, d).select("id", sem.canonical_json("sem").alias("form"), sem.sem_fingerprint("sem").alias("fp"))
    again = F.concat(F.lit("lfp:0.1:sha256:"), F.substring(F.sha2(F.to_json(F.parse_json("form")), 256), 1, 32))
    return form.select("id", again.alias("fp"), (again == F.col("fp")).alias("agrees"))


@query("SELECT profile, count(*) AS n, 1.0::DOUBLE AS rate FROM (SELECT unnest(['safe', 'short', 'tight']) AS profile FROM orders) GROUP BY profile")
def renderer_conformance(spark, d):
    """Share of objects that each profile gives back."""
    return profile_round_trip(spark, d).groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("preserved").cast("int")).alias("rate"))


#: Codes that other implementations write, with the digests that they give.
GOLDENS = [
    ("simple-safe", 'LUNUM-SAFE/0.1:{"clauses":[{"negated":false,"predicate":"like","roles":{"experiencer":"user","theme":"coffee"}}],"kind":"fact","schema":"lunum-sem/0.1-draft","world":"real"}', "2d519cacd7bea9806c6abfaae95d87ee179cb405b4ed385d76ca354acdee7c62"),
    ("simple-short", 'LUNUM-SHORT/0.1:{"c":[{"p":"like","r":{"experiencer":"user","theme":"coffee"}}],"k":"fact","s":"lunum-sem/0.1-draft","w":"real"}', "e3f89e38f93f20f4c8ff3885c6e8f278a4766e3ed975a653c0e9a6ee0340d69f"),
    ("simple-tight", 'LUNUM-TIGHT/0.1:["lunum-sem/0.1-draft","real","fact",[["like",{"experiencer":"user","theme":"coffee"}]]]', "8f94baebd48f2f51339ae302304b2eaaf4ec9fb23a31bfc46d100075a9ead1a4"),
    ("negated-tight", 'LUNUM-TIGHT/0.1:["lunum-sem/0.1-draft","real","fact",[["accept",{"agent":"system","theme":"token"},1]]]', "da95e09f5d4ef1c1163175422233698135e54a478f268200ce8a5164e9993c17"),
]
_GOLDEN_ROWS = ", ".join(f"('{name}', '{code}', '{digest}')" for name, code, digest in GOLDENS)


@query(f"SELECT name, sha256(code) = digest AS digest_ok, true AS encodes FROM (VALUES {_GOLDEN_ROWS}) g(name, code, digest)")
def golden_vectors(spark, d):
    """Stored codes: whether their digests are right, and whether decoding and encoding again gives the same code."""

    def again(code: str) -> str:
        return sem.encode(sem.decode(code), next(k for k, prefix in sem.PREFIX.items() if code.startswith(prefix)))

    rows = [(name, code, digest, again(code)) for name, code, digest in GOLDENS]
    table = spark.createDataFrame(rows, "name string, code string, digest string, again string")
    return table.select("name", (F.sha2("code", 256) == F.col("digest")).alias("digest_ok"), (F.col("again") == F.col("code")).alias("encodes"))


_WAYS = ["same", "upper", "spaced", "marked"]


@query(f"WITH v AS (SELECT doc_id, {NORM} AS a, unnest([{{'way': 'same', 'text': text}}, {{'way': 'upper', 'text': upper(text)}}, {{'way': 'spaced', 'text': '  ' || replace(text, ' ', '   ')}}, {{'way': 'marked', 'text': text || '!'}}], recursive := true) FROM documents WHERE NOT contains(text, 'ß') AND NOT contains(text, 'ς')) SELECT way, count(*) AS n, round(avg((a = {NORM})::INT), 6) AS rate FROM v GROUP BY way")
def retrieval_consistency(spark, d):
    """Share of texts that a reformulation still finds by fingerprint. Letters whose case does not come back are left out of the comparison."""
    t = F.col("text")
    docs = read(spark, d, "documents").where("not contains(text, 'ß') and not contains(text, 'ς')")
    ways = F.array(*[F.struct(F.lit(name).alias("way"), v.alias("t")) for name, v in zip(_WAYS, (t, F.upper(t), F.concat(F.lit("  "), F.replace(t, F.lit(" "), F.lit("   "))), F.concat(t, F.lit("!"))), strict=True)])
    rows = docs.select(text.surface_fingerprint(t).alias("fp"), F.explode(ways).alias("x")).select("fp", "x.way", text.surface_fingerprint(F.col("x.t")).alias("found"))
    return rows.groupBy("way").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("fp") == F.col("found")).cast("int")), 6).alias("rate"))


@query("WITH g AS (SELECT unnest([{'gate': 'downstream', 'rate': avg((value >= 5)::INT)}, {'gate': 'mixed', 'rate': avg((value >= 20)::INT)}, {'gate': 'injection', 'rate': avg((event_id % 100 <> 0)::INT)}, {'gate': 'conformance', 'rate': avg((event_id % 9 <> 0)::INT)}], recursive := true) FROM events) SELECT gate, round(rate, 6) AS rate, rate >= 0.8 AS passed, CASE WHEN (SELECT bool_and(rate >= 0.8) FROM g) THEN 0 ELSE 1 END AS exit_code FROM g")
def quality_gates(spark, d):
    """Each gate's pass rate, and the exit code over all."""
    ok = {"downstream": F.col("value") >= 5, "mixed": F.col("value") >= 20, "injection": F.col("event_id") % 100 != 0, "conformance": F.col("event_id") % 9 != 0}
    one = read(spark, d, "events").agg(*[F.avg(c.cast("int")).alias(name) for name, c in ok.items()])
    gates = F.array(*[F.struct(F.lit(name).alias("gate"), F.col(name).alias("rate")) for name in ok])
    failed = F.exists("g", lambda g: g["rate"] < 0.8)
    return one.select(gates.alias("g")).select(failed.alias("failed"), F.explode("g").alias("x")).select("x.gate", F.round("x.rate", 6).alias("rate"), (F.col("x.rate") >= 0.8).alias("passed"), F.when(F.col("failed"), 1).otherwise(0).alias("exit_code"))


_PLAN = {"models": ["a", "b", "c"], "suites": ["canonical", "mutation", "robustness"]}


@query(f"WITH i AS (SELECT item_id FROM benchmark), p AS (SELECT m, s, item_id, unnest(range(1, CASE WHEN s = 'robustness' THEN 4 ELSE 2 END)) AS repeat_ FROM (SELECT unnest([{_in(_PLAN['models'])}]) AS m), (SELECT unnest([{_in(_PLAN['suites'])}]) AS s), i) SELECT m AS model, s AS suite, count(*) AS executions, count(DISTINCT item_id) AS items, (SELECT count(*) FROM p) = 15 * (SELECT count(*) FROM i) AS as_declared FROM p GROUP BY ALL")
def audit_plan(spark, d):
    """Executions of a plan, models by suites by items by repeats, against the number that it declares."""
    items = read(spark, d, "benchmark").select("item_id")
    per_item = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("suite"), F.lit(3 if s == "robustness" else 1).alias("repeats")) for m in _PLAN["models"] for s in _PLAN["suites"]])
    plan = items.select("item_id", F.explode(per_item).alias("x")).groupBy("x.model", "x.suite").agg(F.sum("x.repeats").alias("executions"), F.countDistinct("item_id").alias("items"))
    declared = F.broadcast(items.agg((F.count(F.lit(1)) * 15).alias("_declared")))  # one row
    whole = Window.partitionBy(F.lit(1))  # nine rows
    return plan.join(declared).select("model", "suite", "executions", "items", (F.sum("executions").over(whole) == F.col("_declared")).alias("as_declared"))


# Memories: turns of conversations, with a code, a category and a confidence.
_MEMORY = f"m AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 <> 3 THEN {TELEGRAPH} END AS code, ['preference', 'legal_text', 'simple_fact'][turn % 3 + 1] AS category, CASE WHEN turn % 5 = 4 THEN 'high' ELSE 'low' END AS risk, 1 - turn % 4 / 20.0 AS confidence FROM conversations), w AS (SELECT *, array_to_string(list_filter([CASE WHEN code IS NULL OR code = '' THEN 'missing_code' END, CASE WHEN confidence < 0.9 THEN 'low_confidence' END, CASE WHEN risk <> 'low' THEN 'risk_' || risk END, CASE WHEN category = 'legal_text' THEN 'blocked_category_' || category END], lambda x: x IS NOT NULL), ',') AS why FROM m)"
_MIXED = "CASE WHEN why = '' THEN code ELSE text END"
_SYMBOLS = r"len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]'))"


def _memories(spark, d) -> DataFrame:
    k = F.col("turn")
    m = read(spark, d, "conversations").select("conv_id", "turn", "text", F.when(k % 4 != 3, text.telegraph(F.col("text"))).alias("code"), _pick(["preference", "legal_text", "simple_fact"], k % 3).alias("category"), F.when(k % 5 == 4, "high").otherwise("low").alias("risk"), (1 - k % 4 / 20).alias("confidence"))
    why = policy.reasons((F.coalesce("code", F.lit("")) == "", "missing_code"), (F.col("confidence") < 0.9, "low_confidence"), (F.col("risk") != "low", F.concat(F.lit("risk_"), "risk")), (F.col("category") == "legal_text", F.concat(F.lit("blocked_category_"), "category")))
    return m.withColumn("why", F.array_join(why, ","))


@query(f"WITH {_MEMORY} SELECT conv_id, turn, why AS reasons, '- ' || CASE WHEN why = '' THEN code ELSE text END AS line FROM w")
def memory_lines(spark, d):
    """Memories as they stand in a mixed context, and why they stay natural, by a configured eligibility."""
    return _memories(spark, d).select("conv_id", "turn", F.col("why").alias("reasons"), F.concat(F.lit("- "), F.when(F.col("why") == "", F.col("code")).otherwise(F.col("text"))).alias("line"))


@query(f"WITH {_MEMORY}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM w) WHERE k <= 4), c AS (SELECT conv_id, count(*) AS memories, 2 + sum(1 + {_SYMBOLS.format('text')}) AS n, 2 + sum(1 + {_SYMBOLS.format('coalesce(code, text)')}) AS l, 2 + sum(1 + {_SYMBOLS.format(_MIXED)}) AS x FROM f GROUP BY conv_id) SELECT conv_id, memories, n::BIGINT AS natural_tokens, round(l / greatest(1, n)::DOUBLE, 6) AS code_ratio, round(x / greatest(1, n)::DOUBLE, 6) AS mixed_ratio FROM c")
def memory_contexts(spark, d):
    """Tokens of the first four memories of each conversation under their heading, and the ratios of the other two forms."""
    first = _memories(spark, d).withColumn("_k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("_k <= 4")
    n = lambda c: F.sum(1 + text.symbol_tokens(c)) + 2  # noqa: E731  the line's dash; the heading and its colon
    c = first.groupBy("conv_id").agg(F.count(F.lit(1)).alias("memories"), n(F.col("text")).alias("n"), n(F.coalesce("code", "text")).alias("l"), n(F.when(F.col("why") == "", F.col("code")).otherwise(F.col("text"))).alias("x"))
    ratio = lambda a: F.round(F.col(a) / F.greatest(F.lit(1), F.col("n")), 6)
    return c.select("conv_id", "memories", F.col("n").alias("natural_tokens"), ratio("l").alias("code_ratio"), ratio("x").alias("mixed_ratio"))


_PLAIN = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH a AS (SELECT doc_id, {_PLAIN.format('lang || chr(33) || chr(32) || source')} AS a, [{_PLAIN.format('upper(lang) || chr(46)')}, {_PLAIN.format(repr('Web, pages'))}] AS ok FROM documents) SELECT doc_id, CASE WHEN a = '' THEN 0 WHEN len(list_filter(ok, lambda x: contains(a, x) OR contains(x, a))) > 0 THEN 1 ELSE 0 END AS score FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'zz' ELSE a END AS a, ok FROM a)")
def answer_scores(spark, d):
    """1 where a normalized answer holds an acceptable one or is part of it."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    i = F.col("doc_id")
    answer = F.when(i % 3 == 0, "").when(i % 3 == 1, "zz").otherwise(plain(F.concat("lang", F.lit("! "), "source")))
    rows = read(spark, d, "documents").select("doc_id", answer.alias("a"), F.array(plain(F.concat(F.upper("lang"), F.lit("."))), plain(F.lit("Web, pages"))).alias("ok"))
    hit = F.exists("ok", lambda x: F.contains(F.col("a"), x) | F.contains(x, F.col("a")))
    return rows.select("doc_id", F.when((F.col("a") != "") & hit, 1).otherwise(0).alias("score"))


#: Patterns of the second secret audit that differ from the first's.
_OTHER = {"generic-key-prefix": r"key-[A-Za-z0-9]{16,}", "env-api-key": r"""API_KEY\s*=\s*['"]?[^\s'"]{8,}"""}
PATTERNS = [(name, kind, _OTHER.get(name, pattern)) for name, kind, pattern in policy.SECRET_PATTERNS]
_PATTERN_ROWS = ", ".join(f"('{n}', '{k}', '{_quoted(v)}')" for n, k, v in PATTERNS)


@query(f"SELECT kind, name AS pattern, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM {_LEAK_ROWS}, (VALUES {_PATTERN_ROWS}) p(name, kind, regex) WHERE regexp_matches(value, regex) GROUP BY ALL")
def secret_audit_counts(spark, d):
    """Lines and documents with a finding, by the patterns of the second audit."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "value")).withColumn("line", F.col("at") + 1)
    leak = F.element_at(F.array(*map(F.lit, _LEAKS)), (F.floor((F.col("doc_id") + F.col("line")) / 2) % 12 + 1).cast("int"))
    lines = lines.withColumn("value", F.when((F.col("doc_id") + F.col("line")) % 2 == 0, F.concat("value", F.lit(" "), leak)).otherwise(F.col("value")))
    hits = F.array_compact(F.array(*[F.when(F.col("value").rlike(v), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("pattern"))) for n, k, v in PATTERNS]))
    return lines.select("doc_id", F.explode(hits).alias("h")).groupBy("h.kind", "h.pattern").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("doc_id").alias("documents"))


#: Patterns of names of fields that hold personal data.
PII_NAMES = [r"address|location", r"name\s*(first|last|full)?", r"ssn|social[_\s]*security", r"credit\s*card|card\s*number|cc", r"date\s*of\s*birth|dob", r"gender|sex", r"nationality|citizenship", r"ip[_\s]*address|ipaddr", r"geolocation|gps|lat.*lon", r"biometric|fingerprint|face\s*id"]


@query("SELECT field, bool_or(regexp_matches(lower(field), p)) AS personal FROM (SELECT unnest(['c_name', 'c_custkey', 's_address', 'o_totalprice', 'dob', 'ip_address', 'lat_lon', 'l_tax', 'face id', 'p_brand']) AS field), (SELECT unnest([" + _in(PII_NAMES) + "]) AS p) GROUP BY field")
def pii_fields(spark, d):
    """Fields whose names say that they hold personal data."""
    names = spark.createDataFrame([(x,) for x in ("c_name", "c_custkey", "s_address", "o_totalprice", "dob", "ip_address", "lat_lon", "l_tax", "face id", "p_brand")], "field string")
    return names.select("field", F.lower("field").rlike("|".join(f"(?:{p})" for p in PII_NAMES)).alias("personal"))


@query("SELECT o_orderkey, array_agg(h ORDER BY r)[1] AS first_hash, count(*) AS draws FROM (SELECT o_orderkey, sha256(o_orderkey || ':' || i) AS h, row_number() OVER (PARTITION BY o_orderkey ORDER BY sha256(o_orderkey || ':' || i)) AS r FROM orders, (SELECT unnest([0, 1, 2]) AS i)) GROUP BY o_orderkey")
def seeded_shuffle(spark, d):
    """The first of each order's runs in a seeded random order, which is the same everywhere."""
    runs = F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda i: F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), i.cast("string")), 256))
    return read(spark, d, "orders").select("o_orderkey", F.array_min(runs).alias("first_hash"), F.size(runs).cast("long").alias("draws"))
