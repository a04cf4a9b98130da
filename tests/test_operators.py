import json
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from semquarry import catalog
from semquarry.functions import sem
from semquarry.operators import ordering, retrieval, state
from semquarry.sources import jsonl
from semquarry.streaming.state import fold_stream

SF = "/root/testdata/sf0.001"
OBJECT = {"schema": sem.SCHEMA, "world": "real", "kind": "fact", "clauses": [{"predicate": " Likes  it ", "roles": {"theme": {"type": "Thing", "id": "Hot Coffee"}, "experiencer": "user"}}]}


def duck(sql):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return connection.execute(sql).fetchdf()


def same(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind in "fiu" or str(df[c].dtype).startswith("Int"):
            df[c] = df[c].astype("float64").round(6) + 0.0
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert same(catalog.QUERIES[name](spark, SF).toPandas()) == same(duck(catalog.ORACLE_SQL[name]))


def test_mean_accuracies_equal_sql_however_rows_are_dealt(spark, tmp_path):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{SF.replace('0.001', '0.1')}/events.parquet' WHERE user_id < 500")
    spark.createDataFrame(connection.execute("SELECT * FROM events").fetchdf()).repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    expected = connection.execute(catalog.ORACLE_SQL["mode_comparison"]).fetchdf()
    assert same(catalog.QUERIES["mode_comparison"](spark, str(tmp_path)).toPandas()) == same(expected)


def test_word_containment_of_odd_texts_without_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice(["a", "b", "é", "A", " ", "\n", "\x0b", "\u00a0", "  "]) for _ in range(n))
    items = [(0, None), (1, ""), (2, " a  a b"), (3, "a\x0bb a"), (None, "é a"), (5, "b " * 40 + "éb")] + [(i, some(30)) for i in range(6, 40)]
    docs = [(0, None), (1, ""), (2, " "), (None, "ab"), (None, "a\x0bb a"), (5, "éb" * 3000)] + [(i, some(rng.randrange(60))) for i in range(6, 300)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    for name in ("benchmark", "documents"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    expected = same(connection.execute(catalog.ORACLE_SQL["word_containment"]).fetchdf())
    found = catalog.QUERIES["word_containment"](spark, str(tmp_path))
    assert same(found.toPandas()) == expected
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 7)
    assert same(catalog.QUERIES["word_containment"](spark, str(tmp_path)).toPandas()) == expected


def test_canonical_form_and_identity():
    twin = json.loads(json.dumps(OBJECT).replace(" Likes  it ", "likes_it").replace("Hot Coffee", "hot_coffee"))
    assert sem.stringify(sem.canonical(OBJECT)) == sem.stringify(sem.canonical(twin))
    assert sem.fingerprint(OBJECT).startswith("lfp:0.1:sha256:") and len(sem.fingerprint(OBJECT, 4)) == 15 + 16
    assert sem.render(OBJECT) == "R likes_it user hot_coffee"
    assert sem.near_tokens(OBJECT) == sem.near_tokens(twin)


@pytest.mark.parametrize(("value", "out"), [(1.0, "1"), (1e21, "1e+21"), (-0.0, "0"), (0.1, "0.1"), (1e-7, "1e-7"), (123456789.5, "123456789.5"), (1.5e300, "1.5e+300"), (100.0, "100"), (1e-6, "0.000001")])
def test_numbers(value, out):
    assert sem.number(value) == out


def test_tight_profile_golden():
    golden = {"schema": sem.SCHEMA, "world": "real", "kind": "fact", "clauses": [{"predicate": "like", "roles": {"experiencer": "user", "theme": "coffee"}}]}
    assert sem.encode(golden, "tight") == 'LUNUM-TIGHT/0.1:["lunum-sem/0.1-draft","real","fact",[["like",{"experiencer":"user","theme":"coffee"}]]]'


def test_validation(spark):
    rows = spark.createDataFrame([(json.dumps(OBJECT),), ("{}",), ("no json",), (None,)], "s string")
    errors = [r[0] for r in rows.select(sem.validation_errors("s")).collect()]
    assert errors[0] == [] and len(errors[1]) == 4 and errors[2] == ["not JSON"]
    assert [r[0] is None for r in rows.select(sem.canonical_json("s")).collect()] == [False, True, True, True]


def test_breaker_and_limiter(spark):
    rows = spark.createDataFrame([(1, i, float(i), i > 3) for i in range(6)], "k int, i int, at double, ok boolean")
    states = [r["s"] for r in state.fold(rows, "k", ["i"], state.breaker(3), "s", "string").orderBy("i").collect()]
    assert states == ["closed", "closed", "open", "open", "half-open", "closed"]
    allowed = [r["s"] for r in state.fold(rows, "k", ["i"], state.limiter(4.0, 2), "s", "boolean").orderBy("i").collect()]
    assert allowed == [True, True, False, False, True, True]


def test_as_of_and_previous_stretch_by_stretch(spark):
    rng = random.Random(3)
    right = [(k, t, rng.random()) for k in (1, 2) for t in sorted(rng.sample(range(300), 20))]
    left = [(i, k, rng.randrange(-5, 320)) for i, k in enumerate([1, 2] * 40)]
    a, b = spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, s int, v double")
    want = {i: max(((s, v) for x, s, v in right if x == k and s <= t), default=(0, None))[1] for i, k, t in left}
    for bucket in (None, lambda t: F.floor(t / 10)):
        assert {r["i"]: r["v_as_of"] for r in ordering.as_of(a, b, "k", "t", "s", "v", bucket).collect()} == want
    before = {(r["k"], r["s"]): r["p"] for r in ordering.previous(b, "k", ["s"], "s", F.floor(F.col("s") / 10), "p").collect()}
    times = {k: [s for x, s, _ in right if x == k] for k in (1, 2)}
    assert before == {(k, s): p for k, own in times.items() for p, s in zip([None, *own], own, strict=False)}


def test_rows_without_a_key_are_one_key(spark):
    rows = spark.createDataFrame([(None if i < 4 else 1, i, float(i)) for i in range(8)], "k int, i int, at double")
    found = state.fold(rows, "k", ["i"], state.limiter(100.0, 2), "s", "boolean").orderBy("i").collect()
    assert [r["s"] for r in found] == [True, True, False, False] * 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, float(i), i % 3 == 0) for k in (1, 2) for i in range(8)], "k int, i int, at double, ok boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = fold_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", ["i"], state.breaker(3), "s", "string")
    q = stream.writeStream.format("memory").queryName("folded").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = state.fold(rows, "k", ["i"], state.breaker(3), "s", "string")
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, batch.collect()))


def test_lineage_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "p int, c int")
    assert {(r["ancestor"], r["node"], r["depth"]) for r in ordering.lineage(edges, "p", "c").collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 1, 2), (3, 1, 1), (3, 2, 2)}


def test_lineage_of_a_long_chain(spark):
    n = 150
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(0, 0), (0, 40), (n, 100)], "p int, c int")
    found = {(r["ancestor"], r["node"]): r["depth"] for r in ordering.lineage(edges, "p", "c").collect()}
    assert found[1, n] == n - 1 and found[0, n] == n - 39 and found[n, 100] == 1 and (120, 110) in found
    assert len(found) == n * (n + 1) // 2 + 51 * 50 // 2 and (0, 0) not in found


def test_near_semantic(spark):
    a = spark.createDataFrame([(1, "h", ["a", "b"]), (2, "g", [])], "l int, hard string, tokens array<string>")
    b = spark.createDataFrame([(5, "h", ["a", "b"]), (6, "h", ["x"]), (7, "g", [])], "r int, hard string, tokens array<string>")
    assert {(r["l"], r["r"]) for r in retrieval.near_semantic(a, b, "l", "r").collect()} == {(1, 5), (2, 7)}


def test_near_semantic_equals_all_pairs(spark):
    rng = random.Random(1)
    sides = [[(i, "hg"[i % 2], rng.choices("abcdefgh", k=rng.randrange(9))) for i in range(80)] for _ in range(2)]
    a, b = (spark.createDataFrame(rows, f"{name} int, hard string, tokens array<string>") for name, rows in zip("lr", sides, strict=True))
    jaccard = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) if x or y else 1.0
    for least in (0.3, 0.6, 2 / 3, 0.8, 1.0):
        want = sorted((i, j) for i, h, x in sides[0] for j, g, y in sides[1] if h == g and round(jaccard(x, y), 6) >= least)
        assert sorted((r["l"], r["r"]) for r in retrieval.near_semantic(a, b, "l", "r", least).collect()) == want


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps({"goldSem": OBJECT}) + "\n\nbroken{\n")
    lines = jsonl.read_lines(spark, str(tmp_path))
    good, bad = jsonl.good_and_bad(lines)
    assert (good.count(), bad.count()) == (1, 1)
    assert {r["result"] for r in jsonl.process(good, "fingerprint").collect()} == {sem.fingerprint(OBJECT)}
    wrapped = spark.createDataFrame([('{"records": [1, 2]}',), ("[3]",), ("{}",)], "t string")
    assert jsonl.extract_records(wrapped, "t").count() == 4
    manifest = jsonl.file_hashes(spark, str(tmp_path)).withColumn("sha256", F.lit("0"))
    assert [r["state"] for r in jsonl.verify(manifest, jsonl.file_hashes(spark, str(tmp_path))).collect()] == ["corrupt"]
