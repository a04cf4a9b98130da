"""Queries of what passes between parties: injected objects, realized texts, shadow records, interchange, audit chains, halts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import policy, rules, sem, text
from ..operators import state
from .lifecycle import _in
from .records import _FORM, _TWINS, objects
from .reports import _pick
from .surface import NORM, query, read

#: Predicates about safety, kinds in which they have no place, and risks that a record may have.
SAFETY, PLAIN_KINDS, RISKS = ["safety_constraint", "security_breach", "override_safety"], ["simple_fact", "tool_event", "test"], ["low", "medium", "high", "unknown"]


def injected(spark, d) -> DataFrame:
    """id, sem: an object for each event, with an injection that the event's number chooses (0: none)."""
    k, none = F.col("event_id") % 8, F.lit(None).cast("string")
    when = lambda n, value, other=none: F.when(k == n, value).otherwise(other)
    roles = F.struct(F.lit("user").alias("agent"), F.lit("door").alias("theme"), when(5, "absolute").alias("modality"), when(7, "hall").alias("location"))
    clause = F.struct(F.when(k == 3, "override_safety").when(k == 5, "certainty").otherwise("open").alias("predicate"), roles.alias("roles"), F.when(k == 6, F.array(F.struct(F.lit("always_true").alias("predicate"), F.struct(none.alias("x")).alias("roles")))).alias("conditions"), F.when(k == 5, F.struct(F.lit(1.0).alias("confidence"))).alias("annotations"))
    form = F.struct(when(1, "other/0.1", F.lit(sem.SCHEMA)).alias("schema"), F.lit("real").alias("world"), F.lit("tool_event").alias("kind"), F.array(clause).alias("clauses"), F.when(k == 4, F.struct(F.lit("a").alias("source"), F.lit("b").alias("claimedSource"))).alias("provenance"), F.when(k == 2, F.struct(F.lit("extreme").alias("risk"))).alias("annotations"))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.to_json(form).alias("sem"))


def detection(v: str) -> F.Column:
    """The first check that an object (a variant column) fails, by name; null where it passes all. No Python."""
    get = lambda path, kind="string": F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")
    clauses = F.coalesce(get("clauses", "array<variant>"), F.array().cast("array<variant>"))
    of = lambda c, path, kind: F.call_function("try_variant_get", c, F.lit(path), F.lit(kind))
    some = lambda f: F.exists(clauses, f)
    yes = lambda c: F.coalesce(c, F.lit(False))
    unsafe = some(lambda c: yes(of(c, "$.predicate", "string").isin(SAFETY)))
    certain = some(lambda c: yes(of(c, "$.predicate", "string").isin("certainty", "confidence") & (of(c, "$.roles.modality", "string") == "absolute") & (of(c, "$.annotations.confidence", "double") == 1.0)))
    bypass = some(lambda c: F.exists(F.coalesce(of(c, "$.conditions", "array<variant>"), F.array().cast("array<variant>")), lambda x: yes((of(x, "$.predicate", "string") == "always_true") | (of(x, "$.roles.condition", "string") == "true") | of(x, "$.roles.always", "boolean"))))
    many = (F.size(clauses) > 1) | some(lambda c: F.size(F.map_keys(F.coalesce(of(c, "$.roles", "map<string,variant>"), F.create_map().cast("map<string,variant>")))) > 2)
    return policy.decision([
        (~yes(get("schema") == sem.SCHEMA) | (F.size(clauses) == 0), "schema-mismatch"),
        (yes(~get("annotations.risk").isin(RISKS)) | unsafe & yes(get("kind").isin(PLAIN_KINDS)) | yes(get("annotations.skip-validation", "boolean")) | yes(get("annotations.trusted", "boolean")) & ~yes(get("provenance.verified", "boolean")), "policy-violation"),
        (yes(get("provenance.claimedVerified", "boolean") & ~get("provenance.verified", "boolean")) | yes(get("provenance.claimedSource") != get("provenance.source")) | yes(get("provenance.trusted", "boolean") & (get("provenance.source") == "unknown_model_output")), "false-provenance"),
        (certain | bypass, "validateSem"),
        (many, "fingerprint-mismatch"),
    ], None)


_DETECTED = "[NULL, 'schema-mismatch', 'policy-violation', 'policy-violation', 'false-provenance', 'validateSem', 'validateSem', 'fingerprint-mismatch'][event_id % 8 + 1]"


@query(f"SELECT event_id AS id, {_DETECTED} AS detection FROM events")
def injection_detection(spark, d):
    """The first check that finds an injected object."""
    rows = injected(spark, d).select("id", F.expr("parse_json(sem)").alias("v"))
    return rows.select("id", detection("v").alias("detection"))


#: Templates of sentences by language and predicate.
TEMPLATES = {
    "en": {"statement": "{subject} {verb} {object}", "question": "Is {subject} {predicate}?", "location": "{subject} is located at {location}", "action": "{subject} {verb}s {object}"},
    "el": {"statement": "{subject} {verb} {object}", "question": "Είναι {subject} {predicate};", "location": "{subject} βρίσκεται στο {location}", "action": "{subject} {verb} {object}"},
    "es": {"statement": "{subject} {verb} {object}", "question": "¿Es {subject} {predicate}?", "location": "{subject} está ubicado en {location}", "action": "{subject} {verb} {object}"},
}
_PREDICATES = ["statement", "question", "location", "action", "unknown"]
_TEMPLATE_ROWS = [(lang, predicate, template) for lang, own in TEMPLATES.items() for predicate, template in own.items()]


def realized(template: F.Column, roles: dict[str, F.Column]) -> F.Column:
    """A template with the first place of each role filled by its value."""
    out = template
    for name, value in roles.items():
        at = F.locate("{" + name + "}", out)
        out = F.when(at > 0, F.overlay(out, value, at, F.lit(len(name) + 2))).otherwise(out)
    return out


_FILLED = "replace(replace(replace(replace(replace(template, '{subject}', s), '{verb}', v), '{object}', o), '{location}', l), '{predicate}', 'true')"


@query("WITH t(lang, predicate, template) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _TEMPLATE_ROWS) + f"), r AS (SELECT event_id AS id, ['en', 'el', 'es'][event_id % 3 + 1] AS lang, [{_in(_PREDICATES)}][event_id % 5 + 1] AS predicate, 'user ' || user_id AS s, event_type AS v, 'item ' || event_id % 10 AS o, 'room ' || event_id % 7 AS l FROM events) SELECT id, {_FILLED} AS text, template IS NOT NULL AS known FROM r LEFT JOIN t USING (lang, predicate)")
def template_realization(spark, d):
    """Sentences from clauses by templates of their language and predicate; null where there is none."""
    templates = F.broadcast(spark.createDataFrame(_TEMPLATE_ROWS, "lang string, predicate string, template string"))
    i = F.col("event_id")
    rows = read(spark, d, "events").select(i.alias("id"), _pick(["en", "el", "es"], i % 3).alias("lang"), _pick(_PREDICATES, i % 5).alias("predicate"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("s"), F.col("event_type").alias("v"), F.concat(F.lit("item "), (i % 10).cast("string")).alias("o"), F.concat(F.lit("room "), (i % 7).cast("string")).alias("l"))
    filled = realized(F.col("template"), {"subject": F.col("s"), "verb": F.col("v"), "object": F.col("o"), "location": F.col("l"), "predicate": F.lit("true")})
    return rows.join(templates, ["lang", "predicate"], "left").select("id", filled.alias("text"), F.col("template").isNotNull().alias("known"))


@query(f"WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id // 4 % 50 END AS grp, substr(sha256({NORM}), 1, 24) AS fp FROM documents), p AS (SELECT doc_id, grp, fp, lead(grp) OVER w AS grp2, lead(fp) OVER w AS fp2 FROM r WINDOW w AS (ORDER BY doc_id)) SELECT doc_id, CASE WHEN grp IS NOT NULL AND grp2 IS NOT NULL THEN 'group' ELSE 'fingerprint' END AS method, CASE WHEN grp IS NOT NULL AND grp2 IS NOT NULL THEN grp = grp2 ELSE fp = fp2 END AS matched FROM p WHERE fp2 IS NOT NULL")
def group_or_fingerprint(spark, d):
    """Whether neighbouring documents match: by their groups where both have one, else by fingerprint. Neighbours meet by an equi-join on their ranks."""
    i = F.col("doc_id")
    r = read(spark, d, "documents").select("doc_id", F.when(i % 3 != 0, F.floor(i / 4) % 50).alias("grp"), F.substring(text.surface_fingerprint(F.col("text")), 16, 24).alias("fp"))
    blocks = r.withColumn("_b", F.floor(i / 1000))  # ids are ranked block by block, so that no task holds them all
    w = Window.partitionBy("_b").orderBy("doc_id")
    inside = blocks.withColumns({"grp2": F.lead("grp").over(w), "fp2": F.lead("fp").over(w)})
    edge = blocks.groupBy("_b").agg(F.min_by(F.struct("grp", "fp"), "doc_id").alias("_first")).withColumn("_b", F.col("_b") - 1)
    p = inside.join(F.broadcast(edge) if edge.count() <= 100_000 else edge, "_b", "left")
    last = F.col("fp2").isNull()
    p = p.select("doc_id", "grp", "fp", F.when(last, F.col("_first.grp")).otherwise(F.col("grp2")).alias("grp2"), F.when(last, F.col("_first.fp")).otherwise(F.col("fp2")).alias("fp2")).where("fp2 is not null")
    both = F.col("grp").isNotNull() & F.col("grp2").isNotNull()
    return p.select("doc_id", F.when(both, "group").otherwise("fingerprint").alias("method"), F.when(both, F.col("grp") == F.col("grp2")).otherwise(F.col("fp") == F.col("fp2")).alias("matched"))


@query("WITH s AS (SELECT l_orderkey AS plan, count(*) AS n, count(*) FILTER (WHERE l_partkey % 7 <> 0) AS kept, count(*) FILTER (WHERE l_partkey % 7 <> 0 AND l_suppkey % 5 <> 0) AS same FROM lineitem GROUP BY 1) SELECT plan, round((4 + kept + 3 * kept + same) / (4 + n + 4 * kept)::DOUBLE, 6) AS fidelity FROM s")
def round_trip_fidelity(spark, d):
    """Share of a state's fields that come back: its head, its steps, and of the steps that do their four parts, of which the status may differ."""
    kept, count = F.col("l_partkey") % 7 != 0, lambda c: F.count(F.when(c, 1))
    s = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan")).agg(F.count(F.lit(1)).alias("n"), count(kept).alias("kept"), count(kept & (F.col("l_suppkey") % 5 != 0)).alias("same"))
    return s.select("plan", F.round((4 + F.col("kept") + 3 * F.col("kept") + F.col("same")) / (4 + F.col("n") + 4 * F.col("kept")), 6).alias("fidelity"))


@query(f"WITH {_TWINS} SELECT id, id % 9 <> 0 AS fingerprints_match, array_to_string(list_filter([CASE WHEN id % 9 = 0 THEN 'fingerprint' END, CASE WHEN id % 9 = 0 THEN 'world' END], lambda x: x IS NOT NULL), ',') AS differences FROM t")
def shadow_compare(spark, d):
    """Original records against shadow ones, some of which have another world: fingerprints, and what differs in structure."""
    shadow = F.when(F.col("id") % 9 == 0, F.replace("sem", F.lit('"world":"real"'), F.lit('"world":"fiction"'))).otherwise(F.col("sem"))
    rows = objects(spark, d).select("id", sem.sem_fingerprint("sem").alias("a"), sem.sem_fingerprint(shadow).alias("b"), F.get_json_object("sem", "$.world").alias("w"), F.get_json_object(shadow, "$.world").alias("x"))
    return rows.select("id", (F.col("a") == F.col("b")).alias("fingerprints_match"), F.array_join(policy.reasons((F.col("a") != F.col("b"), "fingerprint"), (F.col("w") != F.col("x"), "world")), ",").alias("differences"))


@query("WITH e AS (SELECT event_type, count(*) FILTER (WHERE value > 80 AND event_id % 3 = 0) AS critical, count(*) FILTER (WHERE value > 80) AS failures FROM events GROUP BY 1) SELECT event_type, failures >= 500 AS open, CASE WHEN failures >= 500 THEN 'circuit' WHEN critical >= 20 THEN 'critical' END AS halt FROM e")
def run_halts(spark, d):
    """Whether an operation's runs are halted: by its open circuit, or by too many critical errors."""
    bad = F.col("value") > 80
    e = read(spark, d, "events").groupBy("event_type").agg(F.count(F.when(bad & (F.col("event_id") % 3 == 0), 1)).alias("critical"), F.count(F.when(bad, 1)).alias("failures"))
    return e.select("event_type", (F.col("failures") >= 500).alias("open"), F.when(F.col("failures") >= 500, "circuit").when(F.col("critical") >= 20, "critical").alias("halt"))


def chained(before, row):
    """The next entry of an audit chain: its hash covers its number, the hash before it and what it says."""
    number, previous = before or (0, "genesis")
    entry = hashlib.sha256(f"{number}|{previous}|{row.said}".encode()).hexdigest()
    return (number + 1, entry), entry


@query("WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events), f AS (SELECT user_id, event_id, k, sha256('0|genesis|' || event_type) AS entry FROM o WHERE k = 0 UNION ALL SELECT o.user_id, o.event_id, o.k, sha256(o.k || '|' || f.entry || '|' || o.event_type) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) SELECT user_id, event_id, entry FROM f")
def audit_append(spark, d):
    """Each user's events as a chain of entries, every hash over the one before."""
    rows = read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("said"))
    return state.fold(rows, "user_id", ["event_id"], chained, "entry", "string").select("user_id", "event_id", "entry")


#: Sensitivity of categories of data, and their events that are audited.
_CATEGORIES = [("semantic-records", "internal", "record-created,record-deleted"), ("user-inputs", "sensitive", "input-read"), ("api-keys", "restricted", "key-read,key-rotated"), ("metrics", "public", "")]
_CATEGORY_ROWS = ", ".join(str(row) for row in _CATEGORIES)


@query(f"SELECT category, sensitivity, days, len(list_filter(string_split(events, ','), lambda x: x <> '')) AS audited FROM (VALUES {_CATEGORY_ROWS}) c(category, sensitivity, events) LEFT JOIN (VALUES ('semantic-records', 90), ('user-inputs', 30)) p(category, days) USING (category)")
def audit_map(spark, d):
    """Each category of data with its sensitivity, how long it is kept, and how many of its events are audited."""
    c = spark.createDataFrame(_CATEGORIES, "category string, sensitivity string, events string")
    p = spark.createDataFrame([("semantic-records", 90), ("user-inputs", 30)], "category string, days int")
    return c.join(F.broadcast(p), "category", "left").select("category", "sensitivity", "days", F.size(F.filter(F.split("events", ","), lambda x: x != "")).alias("audited"))


@query(f"WITH {_TWINS} SELECT id, 'tenant-' || id % 5 AS tenant, 'lfp:1.0:sha256:' || substr(sha256(substr(sha256('tenant-' || id % 5), 1, 16) || {_FORM}), 1, 16) || substr(sha256('tenant-' || id % 5), 1, 16) AS fp FROM t")
def tenant_records(spark, d):
    """Records scoped to tenants: fingerprints over the tenant's prefix and the canonical object, with the prefix behind."""
    tenant = F.concat(F.lit("tenant-"), (F.col("id") % 5).cast("string"))
    rows = objects(spark, d).select("id", tenant.alias("tenant"), sem.canonical_json("sem").alias("form"))
    prefix = F.substring(F.sha2("tenant", 256), 1, 16)
    return rows.select("id", "tenant", F.concat(F.lit("lfp:1.0:sha256:"), F.substring(F.sha2(F.concat(prefix, "form"), 256), 1, 16), prefix).alias("fp"))


#: Sentences in four languages, to which a number is added.
_SENTENCES = {
    "en": ["Anna is not at home", "what did they see", "is red", "Nothing happens by chance", "plain words"],
    "el": ["Άννα είναι εδώ", "τι θέλει", "είναι κόκκινο", "δεν πάει σε σχολείο", "Μαρία είναι από αλλού"],
    "es": ["Ana es alta", "no va a casa", "cuándo llega", "la mesa de madera", "dónde está"],
    "id": ["Budi adalah guru", "di mana rumah", "tidak ada", "buku di atas meja", "kata saja"],
}
_SENTENCE_ROWS = ", ".join(f"('{lang}', {k}, '{s}')" for lang, own in _SENTENCES.items() for k, s in enumerate(own))


def _rule_sql(lang: str, predicate: str, pattern: str, roles: dict[str, str]) -> str:
    found = ", ".join(f"CASE WHEN trim(regexp_extract(t, '{p}', 1)) <> '' THEN '{role}=' || trim(regexp_extract(t, '{p}', 1)) END" for role, p in sorted(roles.items())) or "NULL"
    return f"SELECT id, '{predicate}' AS predicate, array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ';') AS roles, {str(predicate == 'negation').lower()} AS negated FROM s WHERE lang = '{lang}' AND regexp_matches(t, '{pattern}')"


@query(f"WITH w(lang, k, s) AS (VALUES {_SENTENCE_ROWS}), s AS (SELECT event_id AS id, w.lang, w.s || ' ' || event_id % 10 AS t FROM events JOIN w ON w.lang = ['en', 'el', 'es', 'id'][event_id % 4 + 1] AND w.k = event_id // 4 % 5) " + " UNION ALL ".join(_rule_sql(lang, *rule) for lang, own in rules.RULES.items() for rule in own))
def rule_parse(spark, d):
    """Clauses that rules find in sentences of four languages."""
    i = F.col("event_id")
    lists = F.element_at(F.create_map(*[x for lang, own in _SENTENCES.items() for x in (F.lit(lang), F.array(*map(F.lit, own)))]), F.col("lang"))
    rows = read(spark, d, "events").select(i.alias("id"), _pick(list(_SENTENCES), i % 4).alias("lang")).withColumn("t", F.concat(F.element_at(lists, (F.floor(F.col("id") / 4) % 5 + 1).cast("int")), F.lit(" "), (F.col("id") % 10).cast("string")))
    clauses = rows.select("id", F.explode(rules.parsed(F.col("t"), F.col("lang"))).alias("c"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("c.roles")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return clauses.select("id", "c.predicate", shown.alias("roles"), "c.negated")
