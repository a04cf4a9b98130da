"""Queries over semantic objects, made from the relational tables, with what they must give as SQL over the same columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pairs, sem
from ..operators import retrieval
from ..operators.partitioning import spread, stored
from .surface import query, read


def objects(spark, d) -> DataFrame:
    """id, sem: two objects per order, of which the odd one differs from its twin in surface form only."""
    role = lambda v, kind: F.struct(F.lit(kind).alias("type"), v.cast("string").alias("id"))
    o = spread(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))

    def made(key, predicate):
        clause = F.struct(predicate.alias("predicate"), F.struct(role(F.col("o_custkey") % 50, "Customer").alias("agent"), F.struct(F.floor(F.col("o_totalprice") / 1000).alias("value")).alias("value")).alias("roles"), (F.col("o_orderkey") % 5 == 0).alias("negated"), F.when(F.col("o_orderkey") % 3 == 0, "must").alias("modality"))
        return o.select(key.alias("id"), F.to_json(F.struct(F.lit(sem.SCHEMA).alias("schema"), F.lit("real").alias("world"), F.lit("fact").alias("kind"), F.array(clause).alias("clauses"))).alias("sem"))

    return made(F.col("o_orderkey") * 2, F.lit("placed order")).unionByName(made(F.col("o_orderkey") * 2 + 1, F.lit("  Placed   ORDER ")))


_TWINS = "t AS (SELECT o_orderkey * 2 + unnest([0, 1]) AS id, o_orderkey % 5 = 0 AS n, o_orderkey % 3 = 0 AS m, (o_custkey % 50)::VARCHAR AS a, floor(o_totalprice / 1000)::BIGINT::VARCHAR AS v FROM orders)"
_FORM = """'{"clauses":[{' || CASE WHEN m THEN '"modality":"must",' ELSE '' END || '"negated":' || n || ',"predicate":"placed_order","roles":{"agent":{"id":"' || a || '","type":"customer"},"value":{"value":' || v || '}}}],"kind":"fact","schema":"lunum-sem/0.1-draft","world":"real"}'"""


@query(f"WITH {_TWINS} SELECT id, 'lfp:0.1:sha256:' || substr(sha256({_FORM}), 1, 32) AS fp, 0 AS errors FROM t")
def sem_fingerprints(spark, d):
    return objects(spark, d).select("id", sem.sem_fingerprint("sem").alias("fp"), F.size(sem.validation_errors("sem")).alias("errors"))


@query(f"WITH {_TWINS} SELECT id, 'R ' || CASE WHEN n THEN 'not ' ELSE '' END || CASE WHEN m THEN 'must ' ELSE '' END || 'placed_order ' || a || ' ' || v AS code, {_FORM} AS canonical FROM t")
def sem_render(spark, d):
    return objects(spark, d).select("id", sem.rendered("sem").alias("code"), sem.canonical_json("sem").alias("canonical"))


_SHORT = """'{"c":[{' || CASE WHEN m THEN '"m":"must",' ELSE '' END || CASE WHEN n THEN '"n":true,' ELSE '' END || '"p":"placed_order","r":{"agent":{"id":"' || a || '","type":"customer"},"value":{"value":' || v || '}}}],"k":"fact","s":"lunum-sem/0.1-draft","w":"real"}'"""
_TIGHT = """'["lunum-sem/0.1-draft","real","fact",[["placed_order",{"agent":{"id":"' || a || '","type":"customer"},"value":{"value":' || v || '}}' || CASE WHEN n AND m THEN ',1,"must"' WHEN n THEN ',1' WHEN m THEN ',null,"must"' ELSE '' END || ']]]'"""


@query(f"WITH {_TWINS}, e AS (SELECT id, unnest([{{'profile': 'safe', 'code': 'LUNUM-SAFE/0.1:' || {_FORM}}}, {{'profile': 'short', 'code': 'LUNUM-SHORT/0.1:' || {_SHORT}}}, {{'profile': 'tight', 'code': 'LUNUM-TIGHT/0.1:' || {_TIGHT}}}]) AS x FROM t WHERE id % 2 = 0) SELECT id, x.profile AS profile, x.code AS code, true AS preserved, greatest(1, ceil(length(x.code) / 4.0))::BIGINT AS tokens FROM e")
def profile_round_trip(spark, d):
    """Objects in each profile, with tokens, and whether decoding gives back the canonical form."""
    own = objects(spark, d).where("id % 2 = 0")
    codes = own.select("id", sem.canonical_json("sem").alias("form"), F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), sem.encoded(p)("sem").alias("code")) for p in sem.PREFIX])).alias("x"))
    return codes.select("id", "x.profile", "x.code", (sem.decoded_json("x.code") == F.col("form")).alias("preserved"), F.greatest(F.lit(1), F.ceil(F.char_length("x.code") / 4)).cast("long").alias("tokens"))


@query("SELECT o_orderkey AS pair, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS precision, '' AS missing FROM orders")
def feature_compare(spark, d):
    """Recall and precision of each object's features against its twin's: an equi-join on the pair, then array set operations."""
    f = objects(spark, d).select("id", F.floor(F.col("id") / 2).alias("pair"), sem.feature_list("sem").alias("f"))
    a, b = f.where("id % 2 = 0"), f.where("id % 2 = 1").select("pair", F.col("f").alias("g"))
    same = F.size(F.array_intersect("f", "g"))
    return a.join(b, "pair").select("pair", F.round(same / F.size("f"), 6).alias("recall"), F.round(same / F.size("g"), 6).alias("precision"), F.array_join(F.array_except("f", "g"), ",").alias("missing"))


@query("WITH c AS (SELECT o_orderkey % 5 = 0 AS n, o_orderkey % 3 = 0 AS m, o_custkey % 50 AS a, floor(o_totalprice / 1000) AS v, min(o_orderkey) AS k, count(*) AS rows FROM orders GROUP BY ALL) SELECT x.k * 2 AS left_id, y.k * 2 + 1 AS right_id, x.rows AS left_rows, y.rows AS right_rows, CASE WHEN x.a = y.a THEN 1.0 ELSE round(17 / 21.0, 6) END::DOUBLE AS similarity FROM c x JOIN c y USING (n, m, v)")
def near_semantic_join(spark, d):
    """Pairs of classes of near objects; a class is all objects of one fingerprint, named by its smallest id."""
    near = objects(spark, d).select("id", sem.near_parts(sem.near_fingerprint("sem")).alias("p"))
    near = stored(near.select("id", "p.hard", F.transform("p.tokens", lambda t: F.conv(t, 16, -10).cast("long")).alias("tokens")))  # 16 hex digits are 64 bits
    return retrieval.near_classes(near.where("id % 2 = 0").withColumnRenamed("id", "left_id"), near.where("id % 2 = 1").withColumnRenamed("id", "right_id"), "left_id", "right_id")


@query("SELECT o_orderkey * 2 + i AS id, 'root[0]' AS path, CASE i WHEN 0 THEN 'placed order' ELSE '  Placed   ORDER ' END AS predicate, o_orderkey % 5 = 0 AS negated, CASE WHEN o_orderkey % 3 = 0 THEN 'must' END AS modality, (o_custkey % 50)::VARCHAR AS agent FROM orders, (SELECT unnest([0, 1]) AS i)")
def clause_explode(spark, d):
    """Clauses as a flat relation, by variant functions: no Python."""
    parsed = objects(spark, d).select("id", F.expr("variant_get(parse_json(sem), '$.clauses', 'array<variant>')").alias("c")).select("id", F.posexplode("c").alias("i", "v"))
    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    return parsed.select("id", F.concat(F.lit("root["), "i", F.lit("]")).alias("path"), get("predicate", "string").alias("predicate"), get("negated", "boolean").alias("negated"), get("modality", "string").alias("modality"), get("roles.agent.id", "string").alias("agent"))


# Pairs: an order's object and one that differs from it in the way that the order's key says (kind, 0 to 6):
# not at all, negation, modality, two fillers swapped, condition, quantity, one more role.
_KINDS = 7


def changed(spark, d) -> DataFrame:
    """id, kind, a, b: pairs of objects as JSON."""
    o = spread(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % _KINDS).alias("kind"), F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("c"), F.concat(F.lit("k"), F.col("o_orderkey") % 10).alias("k"), F.floor("o_totalprice").alias("v"))
    n, m, i = F.col("id") % 5 == 0, F.when(F.col("id") % 3 == 0, "must"), F.col("id") % 2 == 0
    filler = lambda x: F.struct(F.lit("person").alias("type"), x.alias("id"))

    def made(agent, recipient, amount, negated, modality, conditional, manner):
        pay = F.struct(F.lit("pay").alias("predicate"), F.struct(filler(agent).alias("agent")).alias("roles"))
        roles = F.struct(filler(agent).alias("agent"), filler(recipient).alias("recipient"), F.struct(F.lit("quantity").alias("type"), amount.alias("value"), F.lit("usd").alias("unit")).alias("amount"), manner.alias("manner"))
        clause = F.struct(F.lit("ship").alias("predicate"), roles.alias("roles"), negated.alias("negated"), modality.alias("modality"), F.when(conditional, F.array(pay)).alias("conditions"))
        return F.to_json(F.struct(F.lit(sem.SCHEMA).alias("schema"), F.lit("real").alias("world"), F.lit("fact").alias("kind"), F.array(clause).alias("clauses")))

    kind, c, k, v, none = F.col("kind"), F.col("c"), F.col("k"), F.col("v"), F.lit(None).cast("string")
    swapped = kind == 3
    b = made(F.when(swapped, k).otherwise(c), F.when(swapped, c).otherwise(k), v + (kind == 5).cast("int"), n != (kind == 1), F.when(kind == 2, "may").otherwise(m), i != (kind == 4), F.when(kind == 6, "fast"))
    return o.select("id", "kind", made(c, k, v, n, m, i, none).alias("a"), b.alias("b"))


_PAIRS = f"p AS (SELECT o_orderkey AS id, o_orderkey % {_KINDS} AS kind, (o_orderkey % 3 = 0)::INT AS m, (o_orderkey % 2 = 0)::INT AS i, 'c' || o_custkey % 50 AS c, 'k' || o_orderkey % 10 AS k, floor(o_totalprice)::BIGINT AS v, o_orderkey % 5 = 0 AS n FROM orders)"
_MISSING = "CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN m WHEN 3 THEN 2 + i WHEN 4 THEN 3 * i WHEN 5 THEN 1 ELSE 0 END"
_EXTRA = "CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 + i WHEN 4 THEN 3 * (1 - i) WHEN 5 THEN 1 ELSE 1 END"
_SCORES = f"s AS (SELECT *, {_MISSING} AS missing, {_EXTRA} AS extra, 7 + m + 3 * i AS size FROM p), r AS (SELECT *, (size - missing) / size::DOUBLE AS recall, (size - missing) / (size - missing + extra)::DOUBLE AS precision FROM s)"
_CODE = "CASE kind WHEN 1 THEN 'negation-flip' WHEN 2 THEN 'obligation-permission' WHEN 3 THEN 'role-identity' WHEN 4 THEN 'condition-change' WHEN 5 THEN 'protected-literal' ELSE '' END"


@query(f"WITH {_PAIRS}, {_SCORES} SELECT id, kind = 0 AS exact, round(recall, 6) AS recall, round(precision, 6) AS precision, missing, extra, CASE WHEN kind = 0 OR kind = 6 AND recall >= 0.95 AND precision >= 0.95 THEN 'match' WHEN kind = 6 THEN 'partial' ELSE 'mismatch' END AS verdict, {_CODE} AS codes, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 + i WHEN 6 THEN 0 ELSE 1 END AS fired FROM r")
def gated_compare(spark, d):
    """Comparison, hard invariants and verdict of each pair."""
    c = pairs.gated_compare("a", "b")
    found = changed(spark, d).select("id", c.alias("c"))
    return found.select("id", F.col("c.exact_canonical").alias("exact"), F.round("c.recall", 6).alias("recall"), F.round("c.precision", 6).alias("precision"), F.size("c.missing").alias("missing"), F.size("c.extra").alias("extra"), "c.verdict", F.array_join("c.failed_codes", ",").alias("codes"), F.size("c.firings").alias("fired"))


_DETAIL = """CASE kind
WHEN 1 THEN 'negation-flip: ship#0: predicate ''ship'' negated ' || n || ' vs ' || (NOT n)
WHEN 2 THEN 'obligation-permission: ship#0: predicate ''ship'' modality differs: ''' || CASE WHEN m = 1 THEN 'must' ELSE 'null' END || ''' vs ''may'' (obligation/permission swap)'
WHEN 3 THEN 'role-identity: ship#0:agent: filler id reassigned: ''' || c || ''' -> ''' || k || ''' (consistent relabeling across clause-path/role slots -- a role/authority swap, not a content change)'
WHEN 4 THEN 'condition-change: ship#0: condition presence differs: ' || (i = 1) || ' vs ' || (i = 0)
WHEN 5 THEN 'protected-literal: ship#0:amount: quantity value differs: {"value":' || v || ',"unit":"usd"} vs {"value":' || (v + 1) || ',"unit":"usd"}' END"""


@query(f"WITH {_PAIRS} SELECT id, {_DETAIL} AS first, 'Hard invariants are violated: ' || CASE WHEN kind = 3 THEN 2 + i ELSE 1 END || ' invariant(s) failed' AS summary FROM p WHERE kind BETWEEN 1 AND 5")
def invariant_details(spark, d):
    """The first invariant that each pair breaks, in words, and the comparison's summary."""
    c = pairs.gated_compare("a", "b")
    found = changed(spark, d).where("kind between 1 and 5").select("id", c.alias("c"))
    return found.select("id", F.col("c.firings")[0].alias("first"), "c.summary")


@query(f"WITH {_PAIRS} SELECT id, kind IN (0, 6) AS compatible, CASE kind WHEN 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 2 + i WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 1 END AS reasons FROM p WHERE kind <> 6")
def near_compare(spark, d):
    """Near-semantic similarity of each pair, and how many reasons speak against it."""
    found = changed(spark, d).where("kind <> 6").select("id", pairs.near_compare("a", "b").alias("c"))
    return found.select("id", "c.compatible", "c.similarity", F.size("c.reasons").alias("reasons"))


_RETAINED = f"""g AS (SELECT *, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN m WHEN 3 THEN 2 + i WHEN 4 THEN 3 * i WHEN 5 THEN 1 ELSE 0 END AS lost, 5 + m + 3 * i AS all_ FROM p),
h AS (SELECT id, (kind = 0)::INT::DOUBLE AS exact, round((all_ - lost) / all_::DOUBLE, 6) AS feature, 1.0::DOUBLE AS literal, 1.0::DOUBLE AS role, CASE WHEN n AND kind = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS negation, CASE WHEN m = 1 AND kind = 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS modality FROM g)"""


@query(f"WITH {_PAIRS}, {_RETAINED} SELECT *, round((exact + feature + literal + role + negation + modality) / 6, 6) AS total, exact >= 1 AND feature >= 0.8 AND negation >= 0.9 AND modality >= 0.9 AS passed FROM h")
def retention_gates(spark, d):
    """The six retention gates of each pair, their mean, and whether all are passed."""
    found = changed(spark, d).select("id", pairs.retained("a", "b").alias("g"))
    scores = [F.round(f"g.{name}", 6).alias(name) for name in pairs.GATES]
    total = sum((F.round(f"g.{name}", 6) for name in pairs.GATES), F.lit(0.0)) / len(pairs.GATES)
    passed = F.lit(True)
    for name, least in pairs.GATES.items():
        passed &= F.col(f"g.{name}") >= least
    return found.select("id", *scores, F.round(total, 6).alias("total"), passed.alias("passed"))


@F.pandas_udf(sem.STRINGS)
def _placed(a: pd.Series, b: pd.Series, literals: pd.Series) -> pd.Series:
    return pd.Series([pairs.placed(json.loads(x), json.loads(y), list(z)) for x, y, z in zip(a, b, literals, strict=True)])


@query(f"WITH {_PAIRS} SELECT id, CASE WHEN kind = 5 THEN 'missing' ELSE 'placed' END AS amount, CASE WHEN kind = 3 THEN 'wrong-role' ELSE 'placed' END AS recipient, 'literal-not-in-gold' AS other, round((CASE WHEN kind = 5 THEN 0 ELSE 1 END + CASE WHEN kind = 3 THEN 0 ELSE 1 END) / 3.0, 6) AS coverage FROM p")
def literal_placement(spark, d):
    """Whether an amount, a recipient and a literal that the first object lacks stand in the second where they should."""
    literals = F.array(F.get_json_object("a", "$.clauses[0].roles.amount.value"), F.get_json_object("a", "$.clauses[0].roles.recipient.id"), F.lit("nowhere"))
    found = changed(spark, d).select("id", _placed("a", "b", literals).alias("s"))
    kept = F.size(F.filter("s", lambda s: s == "placed"))
    return found.select("id", F.col("s")[0].alias("amount"), F.col("s")[1].alias("recipient"), F.col("s")[2].alias("other"), F.round(kept / 3, 6).alias("coverage"))


@query(r"""SELECT c.name, c.ok FROM (VALUES ('good', true), ('checksum', false), ('tokens', false), ('prefix', false), ('empty', true)) c(name, ok)""")
def near_parse(spark, d):
    """Near-semantic fingerprints that are whole, and ones with a wrong checksum, token or prefix."""
    good = sem.near_text({"schema": sem.SCHEMA, "world": "real", "kind": "fact", "clauses": [{"predicate": "like", "roles": {"theme": "coffee"}}]})
    checksum = re.sub("^nfp:2:sha256:.", lambda m: m[0][:-1] + ("0" if m[0][-1] != "0" else "1"), good)
    bare = f"{'a' * 64}:-"
    rows = [("good", good), ("checksum", checksum), ("tokens", good + ".xyz"), ("prefix", good.replace("nfp:2", "nfp:1")), ("empty", f"nfp:2:sha256:{sem._sha(bare)}:{bare}")]
    table = spark.createDataFrame(rows, "name string, code string")
    return table.select("name", sem.near_parts(F.col("code")).isNotNull().alias("ok"))
