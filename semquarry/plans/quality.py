"""Queries of quality: answers, contexts, scores, forms of text, evidence, traces, ledgers, migrations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import policy, text
from .decisions import _CASES, cases
from .reports import _pick
from .surface import ROUGH, TELEGRAPH, query, read


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_TERMS = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\w\s]', '', 'g'), '\s+'), lambda w: length(w) > 2)"


def terms(column) -> F.Column:
    """Words of more than two ASCII word characters, in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(column), r"[^\w\s]", ""), r"\s+"), lambda w: F.char_length(w) > 2)


def overlap(expected: F.Column, answer: F.Column) -> F.Column:
    """Share of expected terms that an answer has, whole or as the beginning of one or the other."""
    hit = lambda t: F.exists(answer, lambda a: F.startswith(a, t) | F.startswith(t, a))
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.filter(expected, hit)) / F.size(expected))


# Benchmark items as expected answers, against the documents of one group each.
@query(rf"WITH q AS (SELECT item_id, {_TERMS.format('text')} AS e FROM benchmark), a AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, {_TERMS.format('text')} AS t FROM documents), o AS (SELECT item_id, doc_id, round(CASE WHEN len(e) = 0 THEN 1 ELSE len(list_filter(e, lambda x: len(list_filter(t, lambda y: starts_with(y, x) OR starts_with(x, y))) > 0)) / len(e)::DOUBLE END, 6) AS overlap FROM a JOIN q USING (item_id)) SELECT *, overlap >= 0.5 AS preserved FROM o")
def output_preservation(spark, d):
    """Whether a text holds at least half of an expected answer's terms."""
    items = read(spark, d, "benchmark").select("item_id", terms("text").alias("e"))
    n = F.broadcast(items.agg(F.count(F.lit(1)).alias("n")))  # one row
    docs = read(spark, d, "documents").join(n).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"), terms("text").alias("t"))
    share = F.round(overlap(F.col("e"), F.col("t")), 6)
    return docs.join(items, "item_id").select("item_id", "doc_id", share.alias("overlap"), (share >= 0.5).alias("preserved"))


@query(rf"WITH s AS (SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 10)) AS sentence, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 10), 1) AS i FROM conversations), r AS (SELECT *, len(list_filter({_TERMS.format('sentence')}, lambda w: starts_with(w, 'th') OR starts_with(w, 'der'))) AS score FROM s) SELECT conv_id, turn, sentence, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, i) AS k FROM r) WHERE k = 1")
def extractive_answer(spark, d):
    """The sentence of each message with the most terms of an expected answer; of several the first."""
    sentences = F.filter(F.transform(F.split("text", r"[.!?]+"), lambda x: F.btrim(x, F.lit(" \n"))), lambda x: F.char_length(x) > 10)
    score = lambda s: F.size(F.filter(terms(s), lambda w: F.startswith(w, F.lit("th")) | F.startswith(w, F.lit("der"))))
    scored = F.transform(sentences, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("i"), s.alias("sentence")))
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.array_max(scored).alias("best")).where("best is not null")
    return rows.select("conv_id", "turn", "best.sentence", "best.score")


@query(f"WITH {_CASES} SELECT id, round(c1 * 0.3 + c2 * 0.25 + c3 * 0.2 + c4 * 0.15 + c5 * 0.1, 6) AS overall, array_to_string(list_filter([CASE WHEN c1 < 0.7 THEN 'completeness' END, CASE WHEN c2 < 0.7 THEN 'consistency' END], lambda x: x IS NOT NULL), ',') AS warnings, round(c1 * 0.4 + c2 * 0.3 + c3 * 0.3, 6) AS round_trip FROM c")
def semantic_scores(spark, d):
    """Weighted scores of a record's parts, and of a round trip's."""
    weighted = lambda ws: sum((F.col(f"c{k}") * w for k, w in enumerate(ws, 1)), F.lit(0.0))
    return cases(spark, d).select("id", F.round(weighted((0.3, 0.25, 0.2, 0.15, 0.1)), 6).alias("overall"), F.array_join(policy.reasons((F.col("c1") < 0.7, "completeness"), (F.col("c2") < 0.7, "consistency")), ",").alias("warnings"), F.round(weighted((0.4, 0.3, 0.3)), 6).alias("round_trip"))


@query("SELECT l_orderkey, round(avg((l_partkey % 3 = l_suppkey % 3)::INT), 6) AS accuracy FROM lineitem GROUP BY l_orderkey")
def positional_accuracy(spark, d):
    """Share of positions at which a prediction is the expected one."""
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg((F.col("l_partkey") % 3 == F.col("l_suppkey") % 3).cast("int")), 6).alias("accuracy"))


_MODES = ["natural", "lunum", "mixed"]
_TOLERANCE = {"accuracy": 0.1, "latency": 0.3, "cost": 0.6}


@query(f"WITH {_CASES}, m AS (SELECT user_id AS run, [{_in(_MODES)}][id % 3 + 1] AS mode, avg(c1) AS accuracy, avg(c1) - 0.5 AS a, avg(c2) - 0.4 AS l, avg(c3) - 0.5 AS c FROM c GROUP BY ALL), w AS (SELECT *, abs(a) <= 0.1 AND abs(l) <= 0.3 AND abs(c) <= 0.6 AS ok FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ok DESC, round(accuracy, 9) DESC, mode) AS k, count(*) FILTER (WHERE ok) OVER (PARTITION BY run) AS qualifying FROM w) SELECT run, mode AS best, qualifying, round(accuracy, 6) AS accuracy FROM r WHERE k = 1")
def mode_comparison(spark, d):
    """Of the modes whose every measure is within its tolerance, or of all if none is, the most accurate one.

    Sums of doubles depend on their order. They run by id, with one row of a run's mode in memory at a time, and are
    rounded as SQL does, so that means halfway between two sixth decimals come out the same however the rows are dealt.
    """
    c = cases(spark, d).select(F.col("user_id").alias("run"), _pick(_MODES, F.col("id") % 3).alias("mode"), "id", "c1", "c2", "c3")
    so_far = Window.partitionBy("run", "mode").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = c.withColumn("s", F.struct(F.count("id").over(so_far).alias("n"), *[F.sum(x).over(so_far).alias(x) for x in ("c1", "c2", "c3")])).groupBy("run", "mode").agg(F.max("s").alias("s"))
    mean = lambda x: F.try_divide(f"s.{x}", "s.n")
    m = sums.select("run", "mode", mean("c1").alias("accuracy"), (mean("c1") - 0.5).alias("a"), (mean("c2") - 0.4).alias("l"), (mean("c3") - 0.5).alias("c"))
    ok = (F.abs("a") <= _TOLERANCE["accuracy"]) & (F.abs("l") <= _TOLERANCE["latency"]) & (F.abs("c") <= _TOLERANCE["cost"])
    rounded = lambda digits: F.round(F.col("accuracy") * 10.0**digits) / 10.0**digits
    w = Window.partitionBy("run")
    r = m.withColumn("ok", ok).withColumns({"k": F.row_number().over(w.orderBy(F.desc("ok"), F.desc(rounded(9)), "mode")), "qualifying": F.count(F.when(F.col("ok"), 1)).over(w)})
    return r.where("k = 1").select("run", F.col("mode").alias("best"), "qualifying", rounded(6).alias("accuracy"))


@query(f"SELECT source AS task, count(*) AS items, round(avg(1 - c / n::DOUBLE), 6) AS saving, round(avg((c > 20)::INT), 6) AS preserved, round(sum(n) / greatest(count(*) FILTER (WHERE c > 20), 1)::DOUBLE, 6) AS tokens_per_success FROM (SELECT source, {ROUGH.format('text')} AS n, {ROUGH.format(TELEGRAPH)} AS c FROM documents) GROUP BY GROUPING SETS ((source), ())")
def downstream_summary(spark, d):
    """Mean saving, share of texts whose compact form keeps its answer, and tokens for each success, by task and overall."""
    t = F.col("text")
    rows = read(spark, d, "documents").select(F.col("source").alias("task"), text.rough_tokens(t).alias("n"), text.rough_tokens(text.telegraph(t)).alias("c"))
    kept = F.count(F.when(F.col("c") > 20, 1))
    return rows.groupingSets([[F.col("task")], []], F.col("task")).agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(1 - F.col("c") / F.col("n")), 6).alias("saving"), F.round(F.avg((F.col("c") > 20).cast("int")), 6).alias("preserved"), F.round(F.sum("n") / F.greatest(kept, F.lit(1)), 6).alias("tokens_per_success"))


@query(f"SELECT mode, lang, count(*) AS n, round(avg(tokens), 6) AS mean_tokens FROM (SELECT lang, 'natural' AS mode, {ROUGH.format('text')} AS tokens FROM documents UNION ALL SELECT lang, 'lunum', {ROUGH.format(TELEGRAPH)} FROM documents) GROUP BY CUBE (mode, lang)")
def mode_crosstab(spark, d):
    """Mean tokens by mode and language, with all totals."""
    t = F.col("text")
    forms = F.array(F.struct(F.lit("natural").alias("mode"), text.rough_tokens(t).alias("t")), F.struct(F.lit("lunum").alias("mode"), text.rough_tokens(text.telegraph(t)).alias("t")))
    return read(spark, d, "documents").select("lang", F.explode(forms).alias("x")).select("lang", "x.mode", "x.t").cube("mode", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("t"), 6).alias("mean_tokens"))


@query("SELECT lang, min(n) AS lowest, max(n) AS highest, round(avg(n), 6) AS mean FROM (SELECT lang, ceil(length(text) / 4.0)::BIGINT AS n FROM documents) GROUP BY lang")
def tokenizer_stats(spark, d):
    n = text.estimated_tokens(F.col("text"))
    return read(spark, d, "documents").groupBy("lang").agg(F.min(n).alias("lowest"), F.max(n).alias("highest"), F.round(F.avg(n), 6).alias("mean"))


_PROFILE_TOKENS = "p AS (SELECT doc_id, lang, unnest([{'p': 'safe', 't': length(text) // 4 + 30, 'ok': true}, {'p': 'short', 't': length(text) // 4 + doc_id % 40, 'ok': doc_id % 3 <> 0}, {'p': 'tight', 't': length(text) // 5 + doc_id % 30, 'ok': doc_id % 4 = 0}], recursive := true) FROM documents)"


@query(f"WITH {_PROFILE_TOKENS} SELECT doc_id, p AS profile, t AS tokens, round(1 - t / s::DOUBLE, 6) AS reduction FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ok DESC, t, p) AS k, max(CASE WHEN p = 'safe' THEN t END) OVER (PARTITION BY doc_id) AS s FROM p) WHERE k = 1")
def optimization_pass(spark, d):
    """Of the profiles that preserve a record, the one of fewest tokens, ties by name; computed row by row, with no shuffle."""
    n, i = F.char_length("text"), F.col("doc_id")
    made = lambda name, tokens, ok: F.struct((~ok).cast("int").alias("lost"), tokens.cast("long").alias("t"), F.lit(name).alias("p"))
    safe = F.floor(n / 4) + 30
    best = F.array_min(F.array(made("safe", safe, F.lit(True)), made("short", F.floor(n / 4) + i % 40, i % 3 != 0), made("tight", F.floor(n / 5) + i % 30, i % 4 == 0)))
    return read(spark, d, "documents").select("doc_id", best.alias("b"), safe.alias("s")).select("doc_id", F.col("b.p").alias("profile"), F.col("b.t").alias("tokens"), F.round(1 - F.col("b.t") / F.col("s"), 6).alias("reduction"))


@query(f"WITH {_PROFILE_TOKENS} SELECT lang, p AS profile, round(avg(t), 6) AS mean, round(stddev_pop(t), 6) AS deviation, median(t)::DOUBLE AS median FROM p GROUP BY ALL")
def atlas_measures(spark, d):
    """Tokens of each record by profile: mean, deviation of the whole, median."""
    n, i = F.char_length("text"), F.col("doc_id")
    made = lambda name, tokens: F.struct(F.lit(name).alias("p"), tokens.cast("long").alias("t"))
    rows = read(spark, d, "documents").select("lang", F.explode(F.array(made("safe", F.floor(n / 4) + 30), made("short", F.floor(n / 4) + i % 40), made("tight", F.floor(n / 5) + i % 30))).alias("x")).select("lang", F.col("x.p").alias("profile"), "x.t")
    return rows.groupBy("lang", "profile").agg(F.round(F.avg("t"), 6).alias("mean"), F.round(F.stddev_pop("t"), 6).alias("deviation"), F.median("t").alias("median"))


@query("SELECT [source, 'all'][s + 1] AS source, lang, count(*) AS n, round(avg((n_chars > 800)::INT), 6) AS rate, round(avg((n_chars > 2500)::INT), 6) AS exact FROM documents, (SELECT unnest([0, 1]) AS s) GROUP BY ALL")
def round_trip_report(spark, d):
    """Rates by language and model, and by language over all models."""
    rows = read(spark, d, "documents").select("lang", "n_chars", F.explode(F.array(F.col("source"), F.lit("all"))).alias("source"))
    return rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("n_chars") > 800).cast("int")), 6).alias("rate"), F.round(F.avg((F.col("n_chars") > 2500).cast("int")), 6).alias("exact"))


@query("WITH r AS (SELECT lang, source, round(avg((n_chars > 800)::INT), 6) AS rate FROM documents GROUP BY ALL) SELECT lang, array_to_string(list_sort(list(source)), ',') AS models, rate FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY rate DESC) AS k FROM r) WHERE k = 1 GROUP BY lang, rate")
def best_models(spark, d):
    """The best models of each language, all of them where they tie."""
    r = read(spark, d, "documents").groupBy("lang", "source").agg(F.round(F.avg((F.col("n_chars") > 800).cast("int")), 6).alias("rate"))
    top = r.groupBy("lang").agg(F.max("rate").alias("rate"))
    return r.join(top, ["lang", "rate"]).groupBy("lang", "rate").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("models")).select("lang", "models", "rate")


@query("WITH s AS (SELECT user_id AS scope, event_type AS gate, avg((value >= 5)::INT) AS rate FROM events GROUP BY ALL), v AS (SELECT scope, bool_and(rate >= 0.8) AS passed, bool_or(gate = 'purchase' AND rate < 0.5) AS unsafe FROM s GROUP BY scope) SELECT count(*) AS scopes, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE unsafe) AS unsafe, CASE WHEN bool_or(unsafe) THEN 'safety-fail' WHEN bool_and(NOT passed) THEN 'fail' WHEN bool_or(NOT passed) THEN 'partial' ELSE 'pass' END AS verdict FROM v")
def validation_report(spark, d):
    """Scopes that pass all gates, those that are unsafe, and the verdict over all."""
    s = read(spark, d, "events").groupBy(F.col("user_id").alias("scope"), F.col("event_type").alias("gate")).agg(F.avg((F.col("value") >= 5).cast("int")).alias("rate"))
    v = s.groupBy("scope").agg(F.bool_and(F.col("rate") >= 0.8).alias("passed"), F.bool_or((F.col("gate") == "purchase") & (F.col("rate") < 0.5)).alias("unsafe"))
    count = lambda c: F.count(F.when(c, 1))
    out = v.agg(F.count(F.lit(1)).alias("scopes"), count(F.col("passed")).alias("passed"), count(F.col("unsafe")).alias("unsafe"))
    failed = F.col("scopes") - F.col("passed")
    return out.withColumn("verdict", policy.decision([(F.col("unsafe") > 0, "safety-fail"), (F.col("passed") == 0, "fail"), (failed > 0, "partial")], "pass"))


_TRACE = "'00-' || substr(sha256(event_id::VARCHAR), 1, CASE WHEN event_id % 5 = 0 THEN 30 ELSE 32 END) || '-' || substr(sha256(event_type), 1, 16) || '-0' || event_id % 2"


@query(f"WITH t AS (SELECT event_id AS id, {_TRACE} AS v FROM events) SELECT id, CASE WHEN ok THEN split_part(v, '-', 2) END AS trace, CASE WHEN ok THEN split_part(v, '-', 3) END AS span, coalesce(CASE WHEN ok THEN split_part(v, '-', 4) END = '01', false) AS sampled FROM (SELECT *, regexp_full_match(v, '00-[a-f0-9]{{32}}-[a-f0-9]{{16}}-[a-f0-9]{{2}}') AS ok FROM t)")
def trace_contexts(spark, d):
    """Trace, span and sampling of trace headers; null where a header has another form."""
    i = F.col("event_id")
    digest = F.sha2(i.cast("string"), 256)
    v = F.concat(F.lit("00-"), F.when(i % 5 == 0, F.substring(digest, 1, 30)).otherwise(F.substring(digest, 1, 32)), F.lit("-"), F.substring(F.sha2("event_type", 256), 1, 16), F.lit("-0"), (i % 2).cast("string"))
    part = lambda k: F.nullif(F.regexp_extract("v", r"^00-([a-f0-9]{32})-([a-f0-9]{16})-([a-f0-9]{2})$", k), F.lit(""))
    return read(spark, d, "events").select(i.alias("id"), v.alias("v")).select("id", part(1).alias("trace"), part(2).alias("span"), F.coalesce(part(3) == "01", F.lit(False)).alias("sampled"))


@query("WITH l AS (SELECT o_custkey AS key, o_orderkey AS id, o_orderstatus = 'F' AS undo FROM orders), v AS (SELECT *, sum(CASE WHEN undo THEN -1 ELSE 1 END) OVER (PARTITION BY key ORDER BY id) AS depth, count(*) OVER (PARTITION BY key ORDER BY id) AS entry FROM l) SELECT key, id, undo, entry, depth FROM v")
def rollback_ledger(spark, d):
    """Commits and rollbacks of each key, numbered, with the height of its stack after each."""
    w = Window.partitionBy("key").orderBy("id")
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("undo"))
    return rows.select("key", "id", "undo", F.count(F.lit(1)).over(w).alias("entry"), F.sum(F.when(F.col("undo"), -1).otherwise(1)).over(w).alias("depth"))


_EVIDENCE = ["jurisdiction_scope", "qualified_review", "liability_assessment"]


@query(f"WITH e AS (SELECT o_custkey AS request, [{_in(_EVIDENCE)}, 'other'][o_orderkey % 4 + 1] AS type, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE o_orderpriority END AS description FROM orders), g AS (SELECT request, count(*) AS n, list(DISTINCT type) AS types, bool_or(trim(description) = '') AS blank FROM e GROUP BY request) SELECT request, array_to_string(list_filter([{_in(_EVIDENCE)}], lambda t: NOT list_contains(types, t)), ',') AS missing, n < 3 AS too_few, blank, n >= 3 AND NOT blank AND list_has_all(types, [{_in(_EVIDENCE)}]) AS valid FROM g")
def evidence_check(spark, d):
    """Whether requests for a domain have evidence of all required types, enough of it, and none without a description."""
    e = read(spark, d, "orders").select(F.col("o_custkey").alias("request"), _pick([*_EVIDENCE, "other"], F.col("o_orderkey") % 4).alias("type"), F.when(F.col("o_orderkey") % 17 == 0, " ").otherwise(F.col("o_orderpriority")).alias("description"))
    g = e.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.collect_set("type").alias("types"), F.bool_or(F.trim("description") == "").alias("blank"))
    missing = F.array_except(F.array(*map(F.lit, _EVIDENCE)), "types")
    return g.select("request", F.array_join(missing, ",").alias("missing"), (F.col("n") < 3).alias("too_few"), "blank", ((F.col("n") >= 3) & ~F.col("blank") & (F.size(missing) == 0)).alias("valid"))


@query("WITH m AS (SELECT doc_id, unnest([{'d': 'legal_advice', 'c': (doc_id * 7 % 100) / 100.0}, {'d': 'financial_advice', 'c': (doc_id * 13 % 100) / 100.0}], recursive := true) FROM documents) SELECT doc_id, bool_or(c >= 0.5 AND d <> 'legal_advice') AS blocked, count(*) FILTER (WHERE c < 0.5) AS notes FROM m WHERE c > 0 GROUP BY doc_id")
def domain_gate(spark, d):
    """Whether a text is blocked for a domain that is not opted into; domains of little confidence only leave a note."""
    i = F.col("doc_id")
    m = F.array(F.struct(F.lit("legal_advice").alias("d"), (i * 7 % 100 / 100).alias("c")), F.struct(F.lit("financial_advice").alias("d"), (i * 13 % 100 / 100).alias("c")))
    rows = read(spark, d, "documents").select("doc_id", F.filter(m, lambda x: x["c"] > 0).alias("m")).where(F.size("m") > 0)
    return rows.select("doc_id", F.exists("m", lambda x: (x["c"] >= 0.5) & (x["d"] != "legal_advice")).alias("blocked"), F.size(F.filter("m", lambda x: x["c"] < 0.5)).cast("long").alias("notes"))


_NEXT = [("0.1.0", "0.2.0", True), ("0.2.0", "0.3.0", False), ("0.3.0", "1.0.0", True), ("1.0.0", None, False)]


@query("WITH RECURSIVE v(version, next, migrate) AS (VALUES ('0.1.0', '0.2.0', true), ('0.2.0', '0.3.0', false), ('0.3.0', '1.0.0', true), ('1.0.0', NULL, false)), w AS (SELECT version AS origin, version AS now, 0 AS steps, 0 AS migrations FROM v UNION ALL SELECT w.origin, v.next, w.steps + 1, w.migrations + v.migrate::INT FROM w JOIN v ON w.now = v.version WHERE v.next IS NOT NULL) SELECT origin, now AS target, steps, migrations FROM w WHERE steps > 0")
def migration_paths(spark, d):
    """Steps and schema migrations between any two versions, along their pointers; the versions are a short fixed list."""
    after = {version: (following, migrate) for version, following, migrate in _NEXT}
    rows = []
    for version in after:
        now, steps, migrations = version, 0, 0
        while after[now][0] is not None:
            migrations += after[now][1]
            now, steps = after[now][0], steps + 1
            rows.append((version, now, steps, migrations))
    return spark.createDataFrame(rows, "origin string, target string, steps int, migrations int")


@query("SELECT doc_id, CASE WHEN text = nfc_normalize(text) AND NOT ascii_ THEN 'NFC' ELSE 'NFKC' END AS form FROM (SELECT *, regexp_full_match(text, '[\\x00-\\x7F]*') OR NOT regexp_matches(text, '[àâäéèêëîïôöùûüçáíóúñÀÂÄÉÈÊËÎÏÔÖÙÛÜÇÁÍÓÚÑΆ-ώ]') AS ascii_ FROM documents)")
def normalization_forms(spark, d):
    """The normalization form that a text tells it is in: NFC where it would change when decomposed, else a compatible one."""
    return read(spark, d, "documents").select("doc_id", text.normalization_form("text").alias("form"))


@query("SELECT user_id, count(*) AS retrievals, count(*) FILTER (WHERE old IN ('contradict', 'expire')) AS stale, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (WHERE old IN ('contradict', 'expire')) / count(*)::DOUBLE END, 6) AS rate FROM (SELECT user_id, type, last_value(CASE WHEN type IN ('add', 'update') THEN 'live' WHEN type <> 'retrieve' THEN type END IGNORE NULLS) OVER (PARTITION BY user_id, item ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM (SELECT *, ['add', 'update', 'contradict', 'retrieve', 'expire'][event_id % 5 + 1] AS type, event_id % 3 AS item FROM events)) WHERE type = 'retrieve' GROUP BY user_id")
def stale_rates(spark, d):
    """Share of a session's retrievals that read what was contradicted or had expired."""
    i = F.col("event_id")
    e = read(spark, d, "events").select("user_id", "ts", "event_id", _pick(["add", "update", "contradict", "retrieve", "expire"], i % 5).alias("type"), (i % 3).alias("item"))
    kept = F.when(F.col("type").isin("add", "update"), "live").when(F.col("type") != "retrieve", F.col("type"))
    w = Window.partitionBy("user_id", "item").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    r = e.withColumn("old", F.last(kept, ignorenulls=True).over(w)).where("type = 'retrieve'")
    stale = F.count(F.when(F.col("old").isin("contradict", "expire"), 1))
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("retrievals"), stale.alias("stale"), F.round(stale / F.count(F.lit(1)), 6).alias("rate"))


@query("SELECT page_id, 'anon-' || substr(sha256('salt' || url), 1, 8) AS anon, (h / 4294967295.0)::DOUBLE AS seed FROM (SELECT page_id, url, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(url) + 1), lambda i: unicode(url[i])::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM pages)")
def seeds(spark, d):
    """Salted anonymous names, and numbers in [0, 1] from a 32-bit hash by xor and multiplication: JVM-side folds."""
    codes = F.transform(F.split("url", ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * 16777619, F.lit(2**32)))
    return read(spark, d, "pages").select("page_id", F.concat(F.lit("anon-"), F.substring(F.sha2(F.concat(F.lit("salt"), "url"), 256), 1, 8)).alias("anon"), (h / 4294967295.0).alias("seed"))


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS long FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def context_stats(spark, d):
    rows = read(spark, d, "documents")
    return rows.groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_chars") > 2000, 1)).alias("long"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE source = (SELECT min(source) FROM documents) AND contains(lower(text), 'an')) WHERE k <= 20")
def context_items(spark, d):
    """Items of a category that hold a searched text, the first twenty."""
    docs = read(spark, d, "documents")
    first = F.broadcast(docs.agg(F.min("source").alias("source")))  # one row
    return docs.join(first, "source").where(F.contains(F.lower("text"), F.lit("an"))).select("doc_id").orderBy("doc_id").limit(20)
