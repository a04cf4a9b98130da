"""Queries that report on and compare runs: attempts, regressions, coverage, contracts, languages, telemetry, lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import policy, text
from ..operators import comparing, context, metrics, retrieval
from .surface import NORM, ROUGH, TELEGRAPH, query, read

_LANGS = ["en", "de", "fr", "es"]


def _pick(values: list, by) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Judgments: labelled documents, relevant by their quality, retrieved by their length.
_JUDGED = "j AS (SELECT d.source AS category, d.lang, l.quality = 1 AS rel, d.n_chars >= 1500 AS got FROM labels l JOIN documents d USING (doc_id))"
_PRF = "count(*) AS n, count(*) FILTER (WHERE got AND rel) AS tp, count(*) FILTER (WHERE got) AS g, count(*) FILTER (WHERE rel) AS r"
_RATES = "n, round(p, 6) AS precision, round(c, 6) AS recall, round(CASE WHEN p + c = 0 THEN 0 ELSE 2 * p * c / (p + c) END, 6) AS f1, round(CASE WHEN g = 0 THEN 0 ELSE (g - tp) / g::DOUBLE END, 6) AS false_rate"
_PC = "*, CASE WHEN g = 0 THEN 0 ELSE tp / g::DOUBLE END AS p, CASE WHEN r = 0 THEN 0 ELSE tp / r::DOUBLE END AS c"


def _judged(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("category"), "lang", (F.col("n_chars") >= 1500).alias("got"))
    return read(spark, d, "labels").join(docs, "doc_id").select("category", "lang", (F.col("quality") == 1).alias("rel"), "got")


def _prf(rows: DataFrame, *by: str) -> DataFrame:
    """n, precision, recall, f1 and the rate of false matches, 0 where there is nothing to divide by."""
    count = lambda c: F.count(F.when(c, 1))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count(F.col("got") & F.col("rel")).alias("tp"), count(F.col("got")).alias("g"), count(F.col("rel")).alias("r"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, c = ratio(F.col("tp"), F.col("g")), ratio(F.col("tp"), F.col("r"))
    return out.select(*by, "n", F.round(p, 6).alias("precision"), F.round(c, 6).alias("recall"), F.round(ratio(2 * p * c, p + c), 6).alias("f1"), F.round(ratio(F.col("g") - F.col("tp"), F.col("g")), 6).alias("false_rate"))


@query(f"WITH {_JUDGED} SELECT category, {_RATES} FROM (SELECT {_PC} FROM (SELECT category, {_PRF} FROM j GROUP BY category))")
def category_metrics(spark, d):
    return _prf(_judged(spark, d), "category")


@query(f"WITH {_JUDGED}, a AS (SELECT category, {_RATES} FROM (SELECT {_PC} FROM (SELECT category, {_PRF} FROM j GROUP BY category))), b AS (SELECT lang, {_RATES} FROM (SELECT {_PC} FROM (SELECT lang, {_PRF} FROM j GROUP BY lang))), o AS (SELECT {_RATES} FROM (SELECT {_PC} FROM (SELECT {_PRF} FROM j))) SELECT o.*, (SELECT category FROM a ORDER BY f1, category LIMIT 1) AS weakest_category, (SELECT lang FROM b ORDER BY f1, lang LIMIT 1) AS weakest_lang FROM o")
def category_report(spark, d):
    """Overall rates, and the category and language with the least f1."""
    j = _judged(spark, d)
    weakest = lambda by: _prf(j, by).agg(F.min_by(by, F.struct("f1", by)).alias(f"weakest_{by}"))  # noqa: E731  one row
    return _prf(j).crossJoin(F.broadcast(weakest("category"))).crossJoin(F.broadcast(weakest("lang")))


@query(f"WITH {_JUDGED}, s AS (SELECT 'long' AS strategy, category, rel, got FROM j UNION ALL SELECT 'short', category, rel, NOT got FROM j UNION ALL SELECT 'all', category, rel, true FROM j), q AS (SELECT strategy, category, {_RATES} FROM (SELECT {_PC} FROM (SELECT strategy, category, {_PRF} FROM s GROUP BY ALL))), m AS (SELECT strategy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM q GROUP BY strategy) SELECT *, rank() OVER (ORDER BY f1 DESC) = 1 AS best FROM m")
def strategy_means(spark, d):
    """Means of the categories' rates by strategy, and which strategy has the best f1."""
    j = _judged(spark, d)
    ways = F.array(F.struct(F.lit("long").alias("strategy"), F.col("got").alias("got")), F.struct(F.lit("short").alias("strategy"), (~F.col("got")).alias("got")), F.struct(F.lit("all").alias("strategy"), F.lit(True).alias("got")))
    per = _prf(j.select("category", "rel", F.explode(ways).alias("s")).select("category", "rel", "s.*"), "strategy", "category")
    means = per.groupBy("strategy").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])
    return means.join(F.broadcast(means.agg(F.max("f1").alias("_best")))).withColumn("best", F.col("f1") == F.col("_best")).drop("_best")  # one row a strategy


# Attempts: events as tries of an item, which the user and the event type name.
_TRIES = "t AS (SELECT user_id || ':' || event_type AS item, event_type AS kind, ['en', 'de', 'fr', 'es'][user_id % 4 + 1] AS lang, event_id AS attempt, value < 40 AS passed, event_id % 5 <> 0 AS parsed, event_id % 7 = 0 AS wrong, CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'schema' END AS error, value AS ms FROM events)"
_LAST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY passed DESC, CASE WHEN passed THEN attempt ELSE -attempt END) AS r FROM t) WHERE r = 1)"


def _tries(spark, d) -> DataFrame:
    i = F.col("event_id")
    return read(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("item"), F.col("event_type").alias("kind"), _pick(_LANGS, F.col("user_id") % 4).alias("lang"), i.alias("attempt"), (F.col("value") < 40).alias("passed"), (i % 5 != 0).alias("parsed"), (i % 7 == 0).alias("wrong"), F.when(i % 3 == 0, "timeout").otherwise("schema").alias("error"), F.col("value").alias("ms"))


def _terminal(tries: DataFrame) -> DataFrame:
    """Of each item the first attempt that passed, else the last; one aggregate, so an item's attempts are never gathered."""
    rest = [c for c in tries.columns if c != "item"]
    order = F.struct(F.col("passed").cast("int"), F.when(F.col("passed"), -F.col("attempt")).otherwise(F.col("attempt")))
    return tries.groupBy("item").agg(F.max_by(F.struct(*rest), order).alias("_x")).select("item", "_x.*")


_BREAKDOWN = "count(*) AS items, count(*) FILTER (WHERE parsed) AS parsed, count(*) FILTER (WHERE parsed AND wrong) AS wrong, round(CASE WHEN count(*) FILTER (WHERE parsed) = 0 THEN 0 ELSE count(*) FILTER (WHERE parsed AND wrong) / count(*) FILTER (WHERE parsed)::DOUBLE END, 6) AS rate"


@query(f"WITH {_TRIES}, {_LAST} SELECT kind, lang, {_BREAKDOWN} FROM f GROUP BY GROUPING SETS ((kind), (lang), ())")
def attempt_breakdown(spark, d):
    """Items by their deciding attempt: overall, by kind and by language, in one pass."""
    last = _terminal(_tries(spark, d))
    count = lambda c: F.count(F.when(c, 1))
    parsed, wrong = count(F.col("parsed")), count(F.col("parsed") & F.col("wrong"))
    return last.groupingSets([[F.col("kind")], [F.col("lang")], []], F.col("kind"), F.col("lang")).agg(F.count(F.lit(1)).alias("items"), parsed.alias("parsed"), wrong.alias("wrong"), F.round(F.when(parsed == 0, 0.0).otherwise(wrong / parsed), 6).alias("rate"))


@query(f"WITH {_TRIES}, {_LAST} SELECT error, count(*) AS n FROM f WHERE NOT passed GROUP BY error")
def attempt_errors(spark, d):
    """Errors of items that never passed."""
    return _terminal(_tries(spark, d)).where("not passed").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TRIES}, w AS (SELECT *, coalesce(max(passed::INT) OVER (PARTITION BY item ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM t) SELECT kind, count(*) AS attempts, count(DISTINCT item) AS items, round(sum(ms), 3) AS total_ms, round(quantile_disc(ms, 0.95), 6) AS p95 FROM w WHERE done = 0 GROUP BY kind")
def stage_retention(spark, d):
    """Attempts that count: up to the first that passed; their latencies by kind."""
    w = Window.partitionBy("item").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    open_ = _tries(spark, d).withColumn("_done", F.coalesce(F.max(F.col("passed").cast("int")).over(w), F.lit(0))).where("_done = 0")
    return open_.groupBy("kind").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("item").alias("items"), F.round(F.sum("ms"), 3).alias("total_ms"), F.round(metrics.nearest_rank("ms", 0.95), 6).alias("p95"))


# Two runs of measures: by language and metric, before and after.
_RUNS = "v AS (SELECT lang, metric, round(avg(a), 6) AS previous, round(avg(b), 6) AS current FROM (SELECT lang, unnest([{'metric': 'recall', 'a': (doc_id % 10 / 10.0)::DOUBLE, 'b': (doc_id * 7 % 13 / 13.0)::DOUBLE}, {'metric': 'exact', 'a': (doc_id % 4 / 4.0)::DOUBLE, 'b': (doc_id % 11 / 11.0)::DOUBLE}, {'metric': 'fallback', 'a': (doc_id % 7 / 7.0)::DOUBLE, 'b': (doc_id % 3 / 3.0)::DOUBLE}], recursive := true) FROM documents) GROUP BY ALL)"


def _runs(spark, d) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    made = lambda cases: read(spark, d, "documents").select("lang", F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), v.alias("v")) for name, v in cases.items()])).alias("x")).groupBy("lang", "x.metric").agg(F.round(F.avg("x.v"), 6).alias("value"))
    return made({"recall": i % 10 / 10, "exact": i % 4 / 4, "fallback": i % 7 / 7}), made({"recall": i * 7 % 13 / 13, "exact": i % 11 / 11, "fallback": i % 3 / 3})


@query(f"WITH {_RUNS} SELECT *, round(current - previous, 6) AS delta, CASE WHEN CASE WHEN metric = 'fallback' THEN previous - current ELSE current - previous END < -0.02 THEN 'regression' WHEN CASE WHEN metric = 'fallback' THEN previous - current ELSE current - previous END > 0.02 THEN 'improvement' ELSE 'none' END AS change FROM v")
def regressions(spark, d):
    """Each language's measures before and after; of fallbacks, less is better."""
    before, after = _runs(spark, d)
    return comparing.drops(before, after, ["lang", "metric"], 0.02, ["fallback"], "metric")


@query(f"WITH {_RUNS} SELECT * FROM (SELECT lang, metric, previous AS baseline, current, round(previous - current, 6) AS drop, CASE WHEN round(previous - current, 6) >= 0.05 THEN 'critical' WHEN round(previous - current, 6) >= 0.01 THEN 'warning' END AS severity FROM v) WHERE severity IS NOT NULL")
def baseline_severities(spark, d):
    before, after = _runs(spark, d)
    return comparing.severities(before, after, ["lang", "metric"], {"critical": 0.05, "warning": 0.01})


@query("WITH c AS (SELECT lang, round(avg((n_chars > 1000)::INT), 6) AS current FROM documents GROUP BY lang), b(lang, rate) AS (VALUES ('en', 0.5), ('de', 0.9), ('fr', 0.55)) SELECT lang, coalesce(rate, 1.0)::DOUBLE AS baseline, current, round(current - coalesce(rate, 1.0), 6)::DOUBLE AS delta, current < 0.5 AS below, NOT (round(current - coalesce(rate, 1.0), 6) < -0.05 OR current < 0.5) AS passed FROM c LEFT JOIN b USING (lang)")
def baseline_comparison(spark, d):
    """Rates by language against a baseline that lacks some languages."""
    current = read(spark, d, "documents").groupBy("lang").agg(F.round(F.avg((F.col("n_chars") > 1000).cast("int")), 6).alias("rate"))
    return comparing.against_baseline(current, spark.createDataFrame([("en", 0.5), ("de", 0.9), ("fr", 0.55)], "lang string, rate double"), "lang")


@query(f"WITH {_RUNS}, e AS (SELECT lang || ':' || metric AS metric, previous AS value, 0.03 AS tolerance FROM v), m AS (SELECT lang || ':' || metric AS metric, current AS value FROM v WHERE NOT (lang = 'fr' AND metric = 'exact')) SELECT * FROM (SELECT e.metric, CASE WHEN m.value IS NULL THEN 'missing' WHEN abs(m.value - e.value) > tolerance THEN 'out of tolerance' END AS divergence FROM e LEFT JOIN m USING (metric)) WHERE divergence IS NOT NULL")
def replication_divergences(spark, d):
    """Expected measures that a replication lacks or misses."""
    before, after = _runs(spark, d)
    named = lambda rows: rows.select(F.concat_ws(":", "lang", "metric").alias("metric"), "value")
    return comparing.out_of_tolerance(named(before).withColumn("tolerance", F.lit(0.03)), named(after.where("not (lang = 'fr' and metric = 'exact')")), "metric")


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS issue FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang <> 'fr') d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL")
def coverage_check(spark, d):
    """Labelled documents that a dataset lacks, and documents of it without labels."""
    return comparing.coverage(read(spark, d, "labels"), read(spark, d, "documents").where("lang <> 'fr'"), "doc_id")


_ENDPOINTS = "SELECT event_type || '/' || (event_id % 40) AS path, ['GET', 'POST'][event_id % 2 + 1] AS method, bool_or(event_id % {} = 0) AS auth, max(event_id % {})::BIGINT AS bytes FROM events WHERE event_id % 40 {} GROUP BY ALL"


@query(f"WITH o AS ({_ENDPOINTS.format(997, 1000, '< 30')}), n AS ({_ENDPOINTS.format(887, 900, '> 8')}), f AS (SELECT coalesce(o.method, n.method) AS method, coalesce(o.path, n.path) AS path, [CASE WHEN n.path IS NULL THEN 'removed' END, CASE WHEN o.path IS NULL THEN 'added' END, CASE WHEN NOT o.auth AND n.auth THEN 'auth_added' END, CASE WHEN n.bytes < o.bytes THEN 'size_reduced' END] AS x FROM o FULL JOIN n ON o.path = n.path AND o.method = n.method) SELECT method, path, change, change <> 'added' AS breaking FROM (SELECT method, path, unnest(x) AS change FROM f) WHERE change IS NOT NULL")
def contract_changes(spark, d):
    """Endpoints that a version of a service removes, adds or changes, and which of it breaks callers."""

    def endpoints(a: int, b: int, where: str) -> DataFrame:
        rows = read(spark, d, "events").where(f"event_id % 40 {where}")
        return rows.groupBy(_pick(["GET", "POST"], F.col("event_id") % 2).alias("method"), F.concat_ws("/", "event_type", (F.col("event_id") % 40).cast("string")).alias("path")).agg(F.bool_or(F.col("event_id") % a == 0).alias("auth"), F.max(F.col("event_id") % b).alias("bytes"))

    return comparing.contract_changes(endpoints(997, 1000, "< 30"), endpoints(887, 900, "> 8"))


_POLICIES = [("fr", 30), ("/de", 10), ("example.com", 90), ("en", 5)]
_FIRST = "CASE " + " ".join(f"WHEN contains(url, '{k}') THEN {{}}" for k, _ in _POLICIES) + " END"


@query(f"SELECT page_id, policy, age - days AS over FROM (SELECT page_id, page_id % 60 AS age, {_FIRST.format(*[repr(k) for k, _ in _POLICIES])} AS policy, {_FIRST.format(*[n for _, n in _POLICIES])} AS days FROM pages) WHERE age > days")
def expired_files(spark, d):
    """Files older than the first policy whose category their path holds allows."""
    rows = comparing.first_match(read(spark, d, "pages"), F.col("url"), _POLICIES)
    return rows.select("page_id", "policy", (F.col("page_id") % 60 - F.col("policy_days")).alias("over")).where("over > 0")


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN days IS NULL THEN 'no policy' ELSE 'kept too long' END AS violation FROM (SELECT o_orderkey, o_orderpriority, o_custkey % 200 AS age FROM orders) LEFT JOIN (VALUES ('1-URGENT', 100), ('2-HIGH', 150), ('3-MEDIUM', 30)) p(o_orderpriority, days) USING (o_orderpriority) WHERE days IS NULL OR age > days")
def retention_violations(spark, d):
    """Records without a policy for their category, or older than it allows."""
    policies = F.broadcast(spark.createDataFrame([("1-URGENT", 100), ("2-HIGH", 150), ("3-MEDIUM", 30)], "o_orderpriority string, days int"))
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 200).alias("age")).join(policies, "o_orderpriority", "left")
    return rows.where("days is null or age > days").select("o_orderkey", "o_orderpriority", F.when(F.col("days").isNull(), "no policy").otherwise("kept too long").alias("violation"))


_RANKED = " ".join(f"WHEN '{lang}' THEN {i}" for i, lang in enumerate(_LANGS))
_QUERIES = f"g AS (SELECT doc_id // 5 AS grp, lang, min(doc_id) AS id, CASE lang {_RANKED} END AS rank FROM documents GROUP BY 1, 2), q AS (SELECT * FROM (SELECT a.grp, a.lang AS source, b.lang AS target, a.id AS query, b.id AS expected, row_number() OVER (PARTITION BY a.grp ORDER BY a.id, b.rank) AS n FROM g a JOIN g b ON a.grp = b.grp AND a.lang <> b.lang WHERE b.rank IS NOT NULL) WHERE n <= 5)"


def _queries(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 5).alias("grp"))
    return comparing.language_queries(docs, "grp", "lang", "doc_id", _LANGS)


@query(f"WITH {_QUERIES} SELECT grp, source, target, query, expected FROM q")
def language_queries(spark, d):
    """Queries from one language to another within groups of documents."""
    return _queries(spark, d)


@query(f"WITH {_QUERIES}, t AS (SELECT lang AS target, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents), h AS (SELECT q.source, q.target, count(*) AS queries, count(f.doc_id) AS hits FROM q LEFT JOIN (SELECT target, doc_id FROM t WHERE r <= 100) f ON q.target = f.target AND q.expected = f.doc_id GROUP BY ALL), k AS (SELECT target, least(count(*), 100) AS k FROM t GROUP BY target) SELECT source, target, queries, hits AS perfect, queries - hits AS zero, round(hits / queries::DOUBLE, 6) AS mean_recall, round(hits / queries::DOUBLE / k, 6) AS mean_precision FROM h JOIN k USING (target)")
def language_retrieval(spark, d):
    """Recall and precision by pair of languages, where the first 100 documents of the target are returned."""
    docs = read(spark, d, "documents").select(F.col("lang").alias("target"), "doc_id")
    first = docs.withColumn("_r", F.row_number().over(Window.partitionBy("target").orderBy("doc_id"))).where("_r <= 100").select("target", F.col("doc_id").alias("expected"), F.lit(1).alias("_hit"))
    sizes = docs.groupBy("target").agg(F.least(F.count(F.lit(1)), F.lit(100)).alias("_k"))
    found = _queries(spark, d).join(first, ["target", "expected"], "left").groupBy("source", "target").agg(F.count(F.lit(1)).alias("queries"), F.count("_hit").alias("perfect")).join(sizes, "target")
    recall = F.col("perfect") / F.col("queries")
    return found.select("source", "target", "queries", "perfect", (F.col("queries") - F.col("perfect")).alias("zero"), F.round(recall, 6).alias("mean_recall"), F.round(recall / F.col("_k"), 6).alias("mean_precision"))


_FP = f"substr(sha256({NORM}), 1, 24)"


@query(f"WITH g AS (SELECT doc_id, lang, doc_id // 5 AS grp, {_FP} AS fp FROM documents) SELECT grp, count(*) AS pairs, count(*) FILTER (WHERE a.fp = b.fp) AS same_text, count(*) FILTER (WHERE a.lang = b.lang AND a.fp <> b.fp) AS same_language FROM g a JOIN g b USING (grp) WHERE a.doc_id < b.doc_id GROUP BY grp")
def group_pairs(spark, d):
    """Pairs of each group's members: of one text, and of one language with different texts, counted from classes and not by pairing."""
    docs = read(spark, d, "documents").select(F.floor(F.col("doc_id") / 5).alias("grp"), "lang", text.surface_fingerprint(F.col("text")).alias("fp"))
    counts = docs.groupBy("grp", "lang", "fp").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    by_lang = counts.groupBy("grp", "lang").agg(F.sum("n").alias("_l"), F.sum(pairs(F.col("n"))).alias("_same"))
    languages = by_lang.groupBy("grp").agg(F.sum("_l").alias("n"), F.sum(pairs(F.col("_l")) - F.col("_same")).alias("same_language"))
    texts = counts.groupBy("grp", "fp").agg(F.sum("n").alias("_t")).groupBy("grp").agg(F.sum(pairs(F.col("_t"))).alias("same_text"))
    out = languages.join(texts, "grp")
    return out.where("n > 1").select("grp", pairs(F.col("n")).cast("long").alias("pairs"), F.col("same_text").cast("long").alias("same_text"), F.col("same_language").cast("long").alias("same_language"))


@query(rf"WITH q AS (SELECT item_id, string_split_regex(lower(text), '\s+') AS words FROM benchmark), s AS (SELECT item_id, doc_id, round(len(list_filter(words, lambda w: contains(t, w))) / len(words)::DOUBLE, 6) AS score FROM q, (SELECT doc_id, lower(text) AS t FROM documents)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def word_containment(spark, d):
    """The ten documents that hold most of a query's words as parts of their text, for each query of a stated set."""
    return retrieval.containment(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "doc_id")


@query("SELECT l.doc_id, 'labelled' AS origin, toxic = 1 AS positive FROM labels l JOIN documents d USING (doc_id) UNION ALL SELECT item_id, 'benchmark', true FROM benchmark UNION ALL SELECT l.doc_id, 'orphan', NULL FROM labels l ANTI JOIN documents d USING (doc_id)")
def label_union(spark, d):
    """Labelled pairs of three origins: labels with their documents, benchmark items, and labels without a document."""
    labels, docs = read(spark, d, "labels"), read(spark, d, "documents").select("doc_id")
    a = labels.join(docs, "doc_id").select("doc_id", F.lit("labelled").alias("origin"), (F.col("toxic") == 1).alias("positive"))
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("origin"), F.lit(True).alias("positive"))
    c = labels.join(docs, "doc_id", "left_anti").select("doc_id", F.lit("orphan").alias("origin"), F.lit(None).cast("boolean").alias("positive"))
    return a.unionByName(b).unionByName(c)


_TENANTS = f"t AS (SELECT doc_id, source AS tenant, CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE source END AS noted, CASE WHEN doc_id % 23 = 0 THEN 'lsf:0.1:sha256:' ELSE 'lsf:1.0:sha256:' END || substr(sha256(substr(sha256(source), 1, 16) || {NORM}), 1, 16) || substr(sha256(CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE source END), 1, 16) AS fp FROM documents)"


@query(f"WITH {_TENANTS} SELECT doc_id, noted <> tenant AS wrong_note, NOT ends_with(fp, substr(sha256(tenant), 1, 16)) AS wrong_prefix, (starts_with(fp, 'lfp:1.0:sha256:') OR starts_with(fp, 'lsf:1.0:sha256:')) AND ends_with(fp, substr(sha256(tenant), 1, 16)) AS belongs FROM t")
def tenant_leaks(spark, d):
    """Records whose annotation or fingerprint is another tenant's, and whether a fingerprint belongs to its tenant."""
    i, prefix = F.col("doc_id"), lambda c: F.substring(F.sha2(c, 256), 1, 16)
    digest = F.substring(F.sha2(F.concat(prefix(F.col("source")), F.lower(text.normalize_text(F.col("text")))), 256), 1, 16)
    tag = F.when(i % 23 == 0, "lsf:0.1:sha256:").otherwise("lsf:1.0:sha256:")
    rows = read(spark, d, "documents").select("doc_id", F.col("source").alias("tenant"), F.when(i % 17 == 0, "other").otherwise(F.col("source")).alias("noted"), F.concat(tag, digest, prefix(F.when(i % 19 == 0, "x").otherwise(F.col("source")))).alias("fp"))
    own = F.endswith("fp", prefix(F.col("tenant")))
    return rows.select("doc_id", (F.col("noted") != F.col("tenant")).alias("wrong_note"), (~own).alias("wrong_prefix"), (F.col("fp").rlike("^l[fs]p:1\\.0:sha256:|^lsf:1\\.0:sha256:") & own).alias("belongs"))


@query("SELECT event_type AS component, count(*) AS fallbacks, round(avg((event_id % 10 <> 0)::INT), 6) AS recovery_rate, round(avg(value), 6) AS mean_ms, round(quantile_disc(value, 0.95), 6) AS p95_ms FROM events WHERE event_id % 3 = 0 GROUP BY event_type")
def fallback_metrics(spark, d):
    rows = read(spark, d, "events").where("event_id % 3 = 0")
    return rows.groupBy(F.col("event_type").alias("component")).agg(F.count(F.lit(1)).alias("fallbacks"), F.round(F.avg((F.col("event_id") % 10 != 0).cast("int")), 6).alias("recovery_rate"), F.round(F.avg("value"), 6).alias("mean_ms"), F.round(metrics.nearest_rank("value", 0.95), 6).alias("p95_ms"))


@query("SELECT event_type AS component, event_id % 4 AS gate, count(*) AS corrections, round(avg(least(value / 100, 1)), 6) AS mean_confidence FROM events WHERE event_id % 3 = 1 GROUP BY GROUPING SETS ((event_type), (event_id % 4), ())")
def correction_metrics(spark, d):
    """Corrections overall, by component and by gate, with their mean confidence."""
    rows = read(spark, d, "events").where("event_id % 3 = 1").select(F.col("event_type").alias("component"), (F.col("event_id") % 4).alias("gate"), F.least(F.col("value") / 100, F.lit(1.0)).alias("c"))
    return rows.groupingSets([[F.col("component")], [F.col("gate")], []], F.col("component"), F.col("gate")).agg(F.count(F.lit(1)).alias("corrections"), F.round(F.avg("c"), 6).alias("mean_confidence"))


@query("WITH c AS (SELECT count(*) FILTER (WHERE event_id % 3 = 1) / count(*)::DOUBLE AS rate, avg(least(value / 100, 1)) FILTER (WHERE event_id % 3 = 1) AS conf, avg((event_id % 10 <> 0)::INT) FILTER (WHERE event_id % 3 = 0) AS rec, quantile_disc(value, 0.95) FILTER (WHERE event_id % 3 = 0) AS p95 FROM events) SELECT unnest(list_filter([CASE WHEN rate > 0.1 THEN 'correction rate' END, CASE WHEN conf > 0.8 THEN 'confident corrections' END, CASE WHEN rec < 0.9 THEN 'recovery rate' END, CASE WHEN p95 > 5000 THEN 'slow fallbacks' END], lambda x: x IS NOT NULL)) AS recommendation FROM c")
def telemetry_report(spark, d):
    """What the corrections' and fallbacks' measures give cause to look at: one pass of conditional aggregates."""
    fixed, fell = F.col("event_id") % 3 == 1, F.col("event_id") % 3 == 0
    one = read(spark, d, "events").agg((F.count(F.when(fixed, 1)) / F.count(F.lit(1))).alias("rate"), F.avg(F.when(fixed, F.least(F.col("value") / 100, F.lit(1.0)))).alias("conf"), F.avg(F.when(fell, (F.col("event_id") % 10 != 0).cast("int"))).alias("rec"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value) FILTER (WHERE event_id % 3 = 0)").alias("p95"))
    return one.select(F.explode(policy.reasons((F.col("rate") > 0.1, "correction rate"), (F.col("conf") > 0.8, "confident corrections"), (F.col("rec") < 0.9, "recovery rate"), (F.col("p95") > 5000, "slow fallbacks"))).alias("recommendation"))


@query("SELECT [200, 404, 500][event_id % 3 + 1] AS status, count(*) AS n, sum(coalesce(CASE WHEN event_id % 5 <> 0 THEN length(props) END, 0))::BIGINT AS bytes, round(sum(value), 3) AS total_ms FROM events GROUP BY 1")
def status_counts(spark, d):
    """Requests, bytes and time by status."""
    size = F.when(F.col("event_id") % 5 != 0, F.char_length("props"))
    return read(spark, d, "events").groupBy(_pick([200, 404, 500], F.col("event_id") % 3).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(size, F.lit(0))).cast("long").alias("bytes"), F.round(F.sum("value"), 3).alias("total_ms"))


@query("WITH i AS (SELECT event_type, event_id * 10 // (SELECT max(event_id) + 1 FROM events) AS part, value FROM events), s AS (SELECT event_type, part, round(avg(value), 3) AS mean, round(quantile_disc(value, 0.95), 3) AS p95, count(*) AS n FROM i GROUP BY ALL), h AS (SELECT event_type, avg(mean) FILTER (WHERE part < 5) AS a, avg(mean) FILTER (WHERE part >= 5) AS b FROM s GROUP BY event_type) SELECT event_type, part, n, mean, p95, round((b - a) / a * 100, 4) AS drift_pct FROM s JOIN h USING (event_type)")
def soak_drift(spark, d):
    """Latencies of ten stretches of a run, and how much the second half's differ from the first's."""
    events = read(spark, d, "events")
    last = F.broadcast(events.agg((F.max("event_id") + 1).alias("_n")))  # one row
    parts = events.join(last).withColumn("part", F.floor(F.col("event_id") * 10 / F.col("_n")))
    s = parts.groupBy("event_type", "part").agg(F.round(F.avg("value"), 3).alias("mean"), F.round(metrics.nearest_rank("value", 0.95), 3).alias("p95"), F.count(F.lit(1)).alias("n"))
    h = s.groupBy("event_type").agg(F.avg(F.when(F.col("part") < 5, F.col("mean"))).alias("_a"), F.avg(F.when(F.col("part") >= 5, F.col("mean"))).alias("_b"))
    return s.join(h, "event_type").select("event_type", "part", "n", "mean", "p95", F.round((F.col("_b") - F.col("_a")) / F.col("_a") * 100, 4).alias("drift_pct"))


@query("WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events), a AS (SELECT user_id, n, max(value) FILTER (WHERE r = 1) AS first_, avg(value) FILTER (WHERE r > 1) AS rest, avg(value) FILTER (WHERE r <= n // 2) AS h1, avg(value) FILTER (WHERE r > n // 2) AS h2 FROM o GROUP BY ALL) SELECT user_id, round(CASE WHEN rest > 0 THEN first_ / rest ELSE 1 END, 3) AS ratio, coalesce(first_ / rest >= 1.5, false) AS cached, abs(CASE WHEN h1 > 0 THEN h2 / h1 ELSE 1 END - 1) > 0.2 AS order_sensitive FROM a WHERE n >= 2")
def bias_report(spark, d):
    """Whether a user's first latency stands out against the rest, and whether the halves differ by a fifth."""
    w = Window.partitionBy("user_id")
    o = read(spark, d, "events").select("user_id", "value", F.row_number().over(w.orderBy("event_id")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    r, n, mean = F.col("r"), F.col("n"), lambda c: F.avg(F.when(c, F.col("value")))
    a = o.groupBy("user_id", "n").agg(F.max(F.when(r == 1, F.col("value"))).alias("first"), mean(r > 1).alias("rest"), mean(r <= F.floor(n / 2)).alias("h1"), mean(r > F.floor(n / 2)).alias("h2")).where("n >= 2")
    drift = F.when(F.col("h1") > 0, F.col("h2") / F.col("h1")).otherwise(1.0)
    return a.select("user_id", F.round(F.when(F.col("rest") > 0, F.col("first") / F.col("rest")).otherwise(1.0), 3).alias("ratio"), F.coalesce(F.col("first") / F.col("rest") >= 1.5, F.lit(False)).alias("cached"), (F.abs(drift - 1) > 0.2).alias("order_sensitive"))


@query("WITH s AS (SELECT user_id, count(*) AS n, round(avg(value), 3) AS mean, round(coalesce(stddev_samp(value), 0), 3) AS sd FROM events GROUP BY user_id), q AS (SELECT user_id, n + (user_id % 5 = 0)::INT AS n, CASE WHEN user_id % 3 = 0 THEN mean + 1 ELSE mean END AS mean, sd FROM s) SELECT user_id, array_to_string(list_filter([CASE WHEN s.n <> q.n THEN 'n' END, CASE WHEN s.mean <> q.mean THEN 'mean' END, CASE WHEN s.sd <> q.sd THEN 'sd' END], lambda x: x IS NOT NULL), ',') AS differ FROM s JOIN q USING (user_id) WHERE s.n <> q.n OR s.mean <> q.mean OR s.sd <> q.sd")
def recompute_check(spark, d):
    """Reported statistics that do not follow from the values."""
    s = read(spark, d, "events").groupBy("user_id").agg(F.count("value").alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 3).alias("sd"))
    reported = s.select("user_id", (F.col("n") + (F.col("user_id") % 5 == 0).cast("int")).alias("_n"), F.when(F.col("user_id") % 3 == 0, F.col("mean") + 1).otherwise(F.col("mean")).alias("_mean"), F.col("sd").alias("_sd"))
    differ = policy.reasons(*[(F.col(c) != F.col(f"_{c}"), c) for c in ("n", "mean", "sd")])
    return s.join(reported, "user_id").select("user_id", F.array_join(differ, ",").alias("differ")).where("differ <> ''")


_FAMILIES = {"qwen": (3.5, 3.4), "llama": (4.0, 3.5), "gemma": (3.8, 3.6), "generic": (3.5, 3.5)}
_MODELS = ["Qwen3-30B", "meta-LLaMA-3", "gemma-2b", "other-7b"]
_FAMILY = "CASE WHEN contains(lower(m), 'qwen') THEN 'qwen' WHEN contains(lower(m), 'llama') THEN 'llama' WHEN contains(lower(m), 'gemma') THEN 'gemma' ELSE 'generic' END"


@query(f"WITH m AS (SELECT doc_id, text, [{_in(_MODELS)}][doc_id % 4 + 1] AS m FROM documents), f AS (SELECT doc_id, text, {_FAMILY} AS family, length(text) AS n FROM m), c AS (SELECT doc_id, family, CASE WHEN n = 0 THEN 0 ELSE greatest(1, ceil(n / 4.0)) END::BIGINT AS by_chars, CASE WHEN n = 0 THEN 0 ELSE greatest(1, ceil(n / CASE family WHEN 'llama' THEN 4.0 WHEN 'gemma' THEN 3.8 ELSE 3.5 END::DOUBLE)) END::BIGINT AS calibrated FROM f) SELECT *, calibrated - by_chars AS delta, round(CASE WHEN by_chars > 0 THEN (calibrated - by_chars) / by_chars::DOUBLE * 100 ELSE 0 END, 6) AS delta_pct FROM c")
def family_tokens(spark, d):
    """Tokens by a model's family, against a quarter of the characters."""
    model = F.lower(_pick(_MODELS, F.col("doc_id") % 4))
    family = policy.decision([(F.contains(model, F.lit(k)), k) for k in ("qwen", "llama", "gemma")], "generic")
    n = text.utf16_length(F.col("text"))
    rows = read(spark, d, "documents").select("doc_id", family.alias("family"), n.alias("n"))
    per = F.when(F.lit(False), 1.0)
    for name, (ratio, _) in _FAMILIES.items():
        per = per.when(F.col("family") == name, ratio)
    tokens = lambda ratio: F.when(F.col("n") == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / ratio))).cast("long")
    rows = rows.select("doc_id", "family", tokens(F.lit(4.0)).alias("by_chars"), tokens(per).alias("calibrated"))
    return rows.withColumns({"delta": F.col("calibrated") - F.col("by_chars"), "delta_pct": F.round(F.when(F.col("by_chars") > 0, (F.col("calibrated") - F.col("by_chars")) / F.col("by_chars") * 100).otherwise(0.0), 6)})


_PROFILES = ", ".join(f"('{k}', {b}::DOUBLE)" for k, (_, b) in _FAMILIES.items())


@query(f"WITH t AS (SELECT doc_id, family, CASE WHEN strlen(text) = 0 THEN 0 ELSE ceil(strlen(text) / b) END AS n, CASE WHEN strlen(lang) = 0 THEN 0 ELSE ceil(strlen(lang || source) / b) END AS c FROM documents, (VALUES {_PROFILES}) p(family, b)) SELECT family, count(*) AS texts, sum(n)::BIGINT AS plain, sum(c)::BIGINT AS compact, round(avg(CASE WHEN n > 0 THEN (n - c) / n * 100 ELSE 0 END), 6) AS mean_saving, round(sum(n) / 1e6 * 0.15, 6) AS cost FROM t GROUP BY family")
def cross_tokenizers(spark, d):
    """Tokens of two forms of each text by tokenizer, mean saving in percent and cost at a price a million."""
    sizes = read(spark, d, "documents").select(F.octet_length("text").alias("a"), F.octet_length(F.concat("lang", "source")).alias("b"))
    profiles = F.array(*[F.struct(F.lit(k).alias("family"), F.lit(b).alias("per")) for k, (_, b) in _FAMILIES.items()])
    t = sizes.select("a", "b", F.explode(profiles).alias("p")).select("p.family", F.ceil(F.col("a") / F.col("p.per")).alias("n"), F.ceil(F.col("b") / F.col("p.per")).alias("c"))
    saving = F.when(F.col("n") > 0, (F.col("n") - F.col("c")) / F.col("n") * 100).otherwise(0.0)
    return t.groupBy("family").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("plain"), F.sum("c").alias("compact"), F.round(F.avg(saving), 6).alias("mean_saving"), F.round(F.sum("n") / 1e6 * 0.15, 6).alias("cost"))


_RECORDS = "r AS (SELECT o_orderkey, o_orderpriority AS policy, ['active', 'frozen', 'warm', 'cold', 'deleted'][o_orderkey % 5 + 1] AS phase, o_orderkey % 11 = 0 AS held, o_custkey % 300 AS days FROM orders)"


def _records(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("policy"), _pick(policy.PHASES, k % 5).alias("phase"), (k % 11 == 0).alias("held"), (F.col("o_custkey") % 300).alias("days"))


@query(f"WITH {_RECORDS} SELECT phase, policy, count(*) AS n, count(*) FILTER (WHERE held) AS held, count(*) FILTER (WHERE phase = 'deleted') AS deleted FROM r GROUP BY GROUPING SETS ((phase), (policy), ())")
def retention_summary(spark, d):
    """Records by phase and by policy, those on hold and those deleted."""
    count = lambda c: F.count(F.when(c, 1))
    return _records(spark, d).groupingSets([[F.col("phase")], [F.col("policy")], []], F.col("phase"), F.col("policy")).agg(F.count(F.lit(1)).alias("n"), count(F.col("held")).alias("held"), count(F.col("phase") == "deleted").alias("deleted"))


@query(f"WITH {_RECORDS} SELECT o_orderkey FROM r WHERE phase = 'deleted' OR (phase = 'cold' AND days >= 200 AND NOT held)")
def deletion_candidates(spark, d):
    """Records that are deleted or would be at the next step."""
    ttl = {k: F.lit(v) for k, v in {"active": 10, "frozen": 30, "warm": 90, "cold": 200}.items()}
    return _records(spark, d).where(policy.next_phase(F.col("phase"), F.col("days"), F.col("held"), ttl) == "deleted").select("o_orderkey")


@query("WITH r(lang) AS (VALUES ('en'), ('es'), ('fr'), ('de'), ('ja'), ('ru')), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT r.lang, coalesce(n, 0) AS n, coalesce(n, 0) < 8 AS missing, (SELECT count(*) FROM c) >= 12 AND (SELECT sum(n) FROM c) >= 96 AS enough FROM r LEFT JOIN c USING (lang)")
def language_coverage(spark, d):
    """Items of each required language, and whether there are enough languages and items in all."""
    counts = read(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    total = F.broadcast(counts.agg(((F.count(F.lit(1)) >= 12) & (F.sum("_n") >= 96)).alias("enough")))  # one row
    required = spark.createDataFrame([(x,) for x in ("en", "es", "fr", "de", "ja", "ru")], "lang string")
    n = F.coalesce("_n", F.lit(0))
    return required.join(counts, "lang", "left").join(total).select("lang", n.alias("n"), (n < 8).alias("missing"), "enough")


@query("WITH c AS (SELECT event_type AS domain, event_id % 20 AS control, 1 + event_id % 3 AS weight, max(event_id % 5) AS maturity FROM events GROUP BY ALL), s AS (SELECT domain, sum(weight * maturity)::BIGINT AS score, sum(weight * 4)::BIGINT AS best FROM c GROUP BY domain) SELECT domain, score, best, round(score / best::DOUBLE, 6) AS share, CASE WHEN score / best::DOUBLE >= 0.9 THEN 'optimized' WHEN score / best::DOUBLE >= 0.7 THEN 'managed' WHEN score / best::DOUBLE >= 0.5 THEN 'defined' WHEN score > 0 THEN 'ad-hoc' ELSE 'none' END AS level FROM s")
def assessment_scores(spark, d):
    """Weighted maturity of each domain's controls, and its level."""
    e = read(spark, d, "events")
    c = e.groupBy(F.col("event_type").alias("domain"), (F.col("event_id") % 20).alias("control"), (1 + F.col("event_id") % 3).alias("weight")).agg(F.max(F.col("event_id") % 5).alias("maturity"))
    s = c.groupBy("domain").agg(F.sum(F.col("weight") * F.col("maturity")).alias("score"), F.sum(F.col("weight") * 4).alias("best"))
    share = F.col("score") / F.col("best")
    return s.select("domain", "score", "best", F.round(share, 6).alias("share"), policy.decision([(share >= 0.9, "optimized"), (share >= 0.7, "managed"), (share >= 0.5, "defined"), (share > 0, "ad-hoc")], "none").alias("level"))


@query("SELECT user_id AS run, bool_and(event_id % 50 <> 0) AS healthy, coalesce(bool_and(event_id % 50 <> 0) FILTER (WHERE event_type = 'purchase'), true) AS ready, count(*) FILTER (WHERE event_id % 50 = 0) AS failed, count(*) FILTER (WHERE event_id % 50 <> 0 AND event_id % 9 = 0) AS warned, count(*) FILTER (WHERE event_id % 50 <> 0 AND event_id % 9 <> 0) AS passed FROM events GROUP BY user_id")
def health(spark, d):
    """Whether all probes of a run passed, whether the critical ones did, and how many failed, warned and passed."""
    ok, count = F.col("event_id") % 50 != 0, lambda c: F.count(F.when(c, 1))
    return read(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.bool_and(ok).alias("healthy"), F.coalesce(F.bool_and(F.when(F.col("event_type") == "purchase", ok)), F.lit(True)).alias("ready"), count(~ok).alias("failed"), count(ok & (F.col("event_id") % 9 == 0)).alias("warned"), count(ok & (F.col("event_id") % 9 != 0)).alias("passed"))


@query("WITH l AS (SELECT event_type, event_id % 16 + 1 AS level, avg((event_id * 7 % 100 < (event_id % 16 + 1) / 2)::INT) AS errors FROM events GROUP BY ALL) SELECT event_type, min(level) FILTER (WHERE errors > 0.05) AS breaking_point, max(level) AS most FROM l GROUP BY event_type")
def breaking_points(spark, d):
    """The least load at which more than a twentieth of requests fail."""
    level = F.col("event_id") % 16 + 1
    errors = read(spark, d, "events").groupBy("event_type", level.alias("level")).agg(F.avg((F.col("event_id") * 7 % 100 < level / 2).cast("int")).alias("errors"))
    return errors.groupBy("event_type").agg(F.min(F.when(F.col("errors") > 0.05, F.col("level"))).alias("breaking_point"), F.max("level").alias("most"))


@query("SELECT part AS item, field FROM (SELECT p_partkey AS part, unnest([CASE WHEN p_partkey % 3 = 0 THEN 'source' END, CASE WHEN p_partkey % 5 = 0 THEN 'license' END, CASE WHEN p_partkey % 7 = 0 THEN 'sha256' END]) AS field FROM part) WHERE field IS NOT NULL")
def provenance_gaps(spark, d):
    """One row for each field of provenance that an item lacks."""
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("item"), F.explode(policy.reasons((k % 3 == 0, "source"), (k % 5 == 0, "license"), (k % 7 == 0, "sha256"))).alias("field"))


@query("SELECT p_partkey AS package, r.registry AS registry FROM (SELECT p_partkey, ['npm', 'pypi', 'mirror', 'git'][p_partkey % 4 + 1] AS registry FROM part) r ANTI JOIN (VALUES ('npm'), ('pypi')) k(registry) ON r.registry = k.registry")
def unknown_registries(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("package"), _pick(["npm", "pypi", "mirror", "git"], F.col("p_partkey") % 4).alias("registry"))
    return rows.join(F.broadcast(spark.createDataFrame([("npm",), ("pypi",)], "registry string")), "registry", "left_anti")


# Workflows: an order's lines as checkpoints.
@query("WITH c AS (SELECT l_orderkey AS workflow, l_linenumber AS step, l_linestatus, CASE WHEN l_quantity > 10 THEN 'completed' ELSE 'running' END AS status, l_shipdate AS stamp FROM lineitem) SELECT workflow, min(struct_pack(step := step, stamp := stamp)).stamp AS started, max(step)::BIGINT AS steps, count(*) FILTER (WHERE status = 'completed') AS completed, CASE WHEN max(struct_pack(step := step, stamp := stamp, status := status)).status = 'completed' THEN max(struct_pack(step := step, stamp := stamp, status := status)).stamp END AS ended FROM c GROUP BY workflow")
def audit_trails(spark, d):
    """Each workflow's first and last checkpoint, its steps, and when it ended if it did."""
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("workflow"), F.col("l_linenumber").alias("step"), F.when(F.col("l_quantity") > 10, "completed").otherwise("running").alias("status"), F.col("l_shipdate").alias("at"))
    last = F.max(F.struct("step", "at", "status"))
    return c.groupBy("workflow").agg(F.min(F.struct("step", "at"))["at"].alias("started"), F.max("step").cast("long").alias("steps"), F.count(F.when(F.col("status") == "completed", 1)).alias("completed"), F.when(last["status"] == "completed", last["at"]).alias("ended"))


@query("WITH c AS (SELECT l_orderkey AS workflow, l_linenumber AS step, sha256(l_partkey::VARCHAR) AS h, sha256(CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN 'x' ELSE l_partkey::VARCHAR END) AS want FROM lineitem) SELECT workflow, min(step) FILTER (WHERE h <> want)::BIGINT AS diverged, coalesce(min(step) FILTER (WHERE h <> want), max(step))::BIGINT AS replayed FROM c GROUP BY workflow")
def replay_divergence(spark, d):
    """The first step of a workflow whose hash is not the expected one."""
    k = F.col("l_partkey").cast("string")
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("workflow"), F.col("l_linenumber").alias("step"), (F.sha2(k, 256) != F.sha2(F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0, "x").otherwise(k), 256)).alias("off"))
    first = F.min(F.when(F.col("off"), F.col("step"))).cast("long")
    return c.groupBy("workflow").agg(first.alias("diverged"), F.coalesce(first, F.max("step").cast("long")).alias("replayed"))


_DECISIONS = "d AS (SELECT o_custkey AS threshold, o_orderkey AS id, o_orderdate AS at, CASE o_orderkey % 4 WHEN 0 THEN 'frozen' WHEN 1 THEN 'accepted' ELSE 'proposed' END AS status, o_totalprice / 300000 AS value FROM orders)"


def _thresholds(spark, d) -> DataFrame:
    k = F.col("o_orderkey") % 4
    return read(spark, d, "orders").select(F.col("o_custkey").alias("threshold"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.when(k == 0, "frozen").when(k == 1, "accepted").otherwise("proposed").alias("status"), (F.col("o_totalprice") / 300000).alias("value"))


@query(f"WITH {_DECISIONS} SELECT threshold, id, status FROM (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY status = 'frozen' DESC, id) AS r FROM d WHERE status IN ('frozen', 'accepted')) WHERE r = 1")
def active_thresholds(spark, d):
    """Of each threshold the first frozen decision, else the first accepted one."""
    live = _thresholds(spark, d).where("status in ('frozen', 'accepted')")
    return live.groupBy("threshold").agg(F.min_by(F.struct("id", "status"), F.struct((F.col("status") != "frozen").cast("int"), "id")).alias("_x")).select("threshold", "_x.*")


@query(f"WITH {_DECISIONS} SELECT id, 'out of range' AS error FROM d WHERE value > 1 UNION ALL SELECT d.id, 'dangling' FROM d ANTI JOIN d p ON d.threshold = p.threshold AND d.id - 32 = p.id WHERE d.id % 9 = 0 UNION ALL SELECT id, 'duplicate' FROM (SELECT id, row_number() OVER (PARTITION BY threshold, status ORDER BY id) AS r FROM d) WHERE r > 1")
def decision_chain_errors(spark, d):
    """Decisions out of range, superseding unknown ones, or repeating a key."""
    rows = _thresholds(spark, d)
    known = rows.select("threshold", F.col("id").alias("_before"))
    dangling = rows.where("id % 9 = 0").withColumn("_before", F.col("id") - 32).join(known, ["threshold", "_before"], "left_anti")
    again = rows.withColumn("_r", F.row_number().over(Window.partitionBy("threshold", "status").orderBy("id"))).where("_r > 1")
    made = lambda part, error: part.select("id", F.lit(error).alias("error"))
    return made(rows.where("value > 1"), "out of range").unionByName(made(dangling, "dangling")).unionByName(made(again, "duplicate"))


@query("SELECT event_id AS id, sha256('{\"agentId\":\"' || user_id || '\",\"causeId\":' || CASE WHEN event_id % 3 = 0 THEN '\"' || event_type || '\"' ELSE 'null' END || ',\"planId\":\"p' || event_id % 7 || '\",\"stepId\":\"s' || event_id % 5 || '\",\"targetStatus\":\"completed\"}') AS key FROM events")
def transition_keys(spark, d):
    """Keys of state transitions: a digest of their parts as JSON in order of names, with nulls kept."""
    i = F.col("event_id")
    parts = F.struct(F.col("user_id").cast("string").alias("agentId"), F.when(i % 3 == 0, F.col("event_type")).alias("causeId"), F.concat(F.lit("p"), i % 7).alias("planId"), F.concat(F.lit("s"), i % 5).alias("stepId"), F.lit("completed").alias("targetStatus"))
    return read(spark, d, "events").select(i.alias("id"), F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256).alias("key"))


_ROLLED = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(w) + 1), lambda i: unicode(w[i])::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


@query(f"SELECT page_id, abs({_ROLLED})::BIGINT AS hash, (abs({_ROLLED}) % 32000)::BIGINT AS token FROM (SELECT page_id, url AS w FROM pages)")
def rolling_hashes(spark, d):
    """A hash of 32 bits with the factor 31, wrapped as signed, and the token number that it gives: JVM-side folds."""
    codes = F.transform(F.split("w", ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    rolled = F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)))
    return read(spark, d, "pages").select("page_id", F.col("url").alias("w")).select("page_id", rolled.alias("hash")).withColumn("token", F.col("hash") % 32000)


@query(f"SELECT conv_id, turn, 'lsf:0.1:sha256:' || substr(sha256({NORM}), 1, 24) AS fp, CASE WHEN role = 'system' THEN 'tool' ELSE 'real' END AS world, length(trim(text, ' ' || chr(10))) AS source_chars FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''")
def surface_sidecars(spark, d):
    """Heuristic records of messages that were not parsed."""
    trimmed = F.btrim("text", F.lit(" \n"))
    rows = read(spark, d, "conversations").where(trimmed != "")
    return rows.select("conv_id", "turn", text.surface_fingerprint(F.col("text")).alias("fp"), F.when(F.col("role") == "system", "tool").otherwise("real").alias("world"), F.char_length(trimmed).cast("long").alias("source_chars"))


_VERSION_ROWS = "('0.1', 'stable'), ('0.2', 'experimental'), ('1.0', 'frozen')"


@query(f"WITH f AS (SELECT event_id AS id, ['lfp', 'lsf', 'bad'][event_id % 3 + 1] || ':' || ['0.1', '0.2', '1.0', '3.0'][event_id % 4 + 1] || ':sha256:' || substr(sha256(event_id::VARCHAR), 1, 8 + event_id % 60) AS fp FROM events), p AS (SELECT id, fp, regexp_full_match(fp, '(lfp|lsf):\\d+\\.\\d+:sha256:[a-f0-9]+') AS valid, split_part(fp, ':', 2) AS version, length(split_part(fp, ':', 4)) AS n FROM f) SELECT id, valid, valid AND v.version IS NOT NULL AS supported, valid AND n BETWEEN 16 AND 64 AS length_ok, CASE WHEN valid THEN state END AS state, coalesce(valid AND state IN ('frozen', 'stable'), false) AS stable FROM p LEFT JOIN (VALUES {_VERSION_ROWS}) v(version, state) USING (version)")
def fingerprint_contracts(spark, d):
    """Form, version, length and stability of fingerprints."""
    i = F.col("event_id")
    digest = F.expr("substr(sha2(cast(event_id as string), 256), 1, cast(8 + event_id % 60 as int))")
    rows = read(spark, d, "events").select(i.alias("id"), F.concat_ws(":", _pick(["lfp", "lsf", "bad"], i % 3), _pick(["0.1", "0.2", "1.0", "3.0"], i % 4), F.lit("sha256"), digest).alias("fp")).withColumn("p", text.parse_fingerprint(F.col("fp")))
    known = F.broadcast(spark.createDataFrame([("0.1", "stable"), ("0.2", "experimental"), ("1.0", "frozen")], "version string, state string"))
    valid, n = F.col("p.prefix").isNotNull(), F.char_length("p.digest")
    return rows.join(known, F.col("p.version") == F.col("version"), "left").select("id", valid.alias("valid"), (valid & F.col("version").isNotNull()).alias("supported"), (valid & F.coalesce(n.between(16, 64), F.lit(False))).alias("length_ok"), "state", F.coalesce(valid & F.col("state").isin("frozen", "stable"), F.lit(False)).alias("stable"))


@query(f"WITH m AS (SELECT conv_id, {ROUGH.format('text')} AS n, CASE WHEN role = 'user' THEN {ROUGH.format(TELEGRAPH)} ELSE {ROUGH.format('text')} END AS c FROM conversations) SELECT conv_id, sum(n)::BIGINT AS served_tokens, sum(c)::BIGINT AS mixed_tokens, round(sum(c) / sum(n)::DOUBLE, 6) AS ratio, round(1 - sum(c) / sum(n)::DOUBLE, 6) AS savings FROM m GROUP BY conv_id")
def shadow_context(spark, d):
    """What a mixed context would save while the natural one is served."""
    out = context.compile_context(read(spark, d, "conversations"), "conv_id", F.col("role") == "user")
    return out.select("conv_id", F.col("natural_tokens").alias("served_tokens"), "mixed_tokens", "ratio", "savings")
