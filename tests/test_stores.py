import json

import pytest
from pyspark.sql import functions as F

from semquarry.functions import sem
from semquarry.sources import jsonl, stores

SEM = {"schema": sem.SCHEMA, "world": "real", "kind": "fact", "clauses": [{"predicate": "like", "roles": {"theme": "coffee"}}]}
MANIFEST = {"schema": stores.EXPERIMENT, "id": "x", "area": "a", "task": "t", "hypothesis": "h", "baselineCommit": "c", "outputDirectory": "o", "modelProfile": "m", "dataset": {"path": "p", "sha256": "a" * 64}, "limits": {"maxItems": 1, "maxAttemptsPerItem": 1, "maxModelCalls": 1}}


def test_manifests_and_profiles():
    assert stores.manifest_errors(MANIFEST) == []
    assert stores.manifest_errors({**MANIFEST, "schema": "y", "id": " "}) == ["Unsupported experiment schema", "id is required"]
    assert stores.manifest_errors({**MANIFEST, "dataset": {}, "limits": {"maxItems": 1, "maxAttemptsPerItem": 1}}) == ["dataset path and SHA-256 are required", "experiment limits must be positive"]
    assert stores.manifest_errors({**MANIFEST, "deterministic": True, "dataset": None, "modelProfile": None, "limits": {"maxItems": 1, "maxAttemptsPerItem": 1}}) == []
    assert stores.profile_errors({"schema": stores.MODEL_PROFILE, "provider": "openai-compatible", "baseUrl": "u", "model": "m"}) == [] and len(stores.profile_errors({})) == 3


def test_json_documents_and_baselines(spark, tmp_path):
    stores.write_json(spark, {"ä": [1, None]}, str(tmp_path / "doc"))
    assert stores.read_json(spark, str(tmp_path / "doc")) == {"ä": [1, None]}
    metrics = spark.createDataFrame([("en", 0.9, 0.8), ("el", 0.7, 0.6)], "language string, retentionRate double, avgRoleMatch double")
    about = {"datasetSha256": "d", "modelId": "m", "schemaVersion": "1"}
    stores.save_baseline(spark, metrics, str(tmp_path / "base"), **about)
    assert sorted(map(tuple, stores.load_baseline(spark, str(tmp_path / "base")).collect())) == [("el", 0.7, 0.6), ("en", 0.9, 0.8)]
    assert stores.load_baseline(spark, str(tmp_path / "none")) is None and stores.load_baseline(spark, str(tmp_path / "doc")) is None
    with pytest.raises(ValueError):
        stores.save_baseline(spark, metrics, str(tmp_path / "base"), modelId="m")


def test_datasets(spark, tmp_path):
    path = tmp_path / "set.jsonl"
    path.write_text("\n".join([json.dumps({"id": "1", "sourceLanguage": "en", "sourceText": "x", "semanticGroup": "g", "goldSem": SEM}), "", "broken"]))
    digest = jsonl.file_hashes(spark, str(path)).first()["sha256"]
    assert stores.dataset(spark, str(path), digest).count() == 2
    with pytest.raises(ValueError):
        stores.dataset(spark, str(path), "0" * 64)
    assert [tuple(r) for r in stores.language_records(spark, str(path)).collect()] == [("1", "en", "x", "g", sem.fingerprint(SEM))]
    (tmp_path / "q").mkdir()
    good = {"queryId": "q", "query": "?", "candidates": ["a", "b"], "expectedRelevant": ["a"], "rankedResults": ["b", "a"], "mode": "exact"}
    for i, doc in enumerate([good, {**good, "queryId": "", "candidates": ["a", "a"], "expectedRelevant": []}]):
        (tmp_path / "q" / f"{i}.json").write_text(json.dumps(doc, indent=1))
    assert sorted(map(len, [r["errors"] for r in stores.retrieval_sets(spark, str(tmp_path / "q")).collect()])) == [0, 4]


def test_pairs_gates_edges_and_backups(spark, tmp_path):
    kind = "id string, sourceItemId string, sem string"
    found = stores.labelled_pairs(spark.createDataFrame([("m", "s", "M"), ("o", "none", "O")], kind), spark.createDataFrame([("s", None, "S")], kind), spark.createDataFrame([("h", "positive", "A", "B")], "id string, label string, sem_a string, sem_b string"))
    assert {tuple(r) for r in found.collect()} == {("m", "negative", "S", "M"), ("o", "negative", None, "O"), ("h", "positive", "A", "B")}
    gates = stores.gate_inputs(spark.createDataFrame([('{"a": 0.5, "b": "x"}',), ("no",), (None,)], "t string"), "t")
    assert {tuple(r) for r in gates.collect()} == {("a", 0.5), ("b", None)}
    edges = spark.createDataFrame([(1, 2, "supersedes", "r", "t", ["p"])], "predecessor long, successor long, relation string, reason string, timestamp string, retainedPaths array<string>")
    stores.save_edges(edges, str(tmp_path / "edges"))
    assert stores.load_edges(spark, str(tmp_path / "edges")).collect() == edges.collect()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_bytes(b"abc")
    manifest = stores.backup(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [r["state"] for r in jsonl.verify(manifest, jsonl.file_hashes(spark, str(tmp_path / "in"))).collect()] == ["ok"]


def test_reports_hold_no_items(spark):
    rows = spark.createDataFrame([("passed", True, 1.0), ("failed", None, 0.5), (None, False, None)], "status string, exact boolean, recall double")
    row = stores.redacted_report(rows, "e").first()
    assert (row["items"], row["passed"], row["failed"], row["exact_rate"], row["recall"]) == (3, 1, 2, pytest.approx(1 / 3), 0.5) and len(row["integrity"]) == 64
    assert stores.redacted_report(rows.limit(0), "e").first()["exact_rate"] == 0


def test_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text("\n".join([json.dumps({"id": "a", "sem": SEM}), json.dumps({"id": "b", "sem": {}}), json.dumps({"id": "c"}), "{"]))
    lines = jsonl.read_lines(spark, str(tmp_path / "in"))
    found = {r["id"]: r for r in stores.line_results(lines, "fingerprint").collect()}
    assert found["a"]["output"] == sem.fingerprint(SEM) and found["b"]["error"].startswith("VALIDATION_FAILED") and found["c"]["error"] == "MISSING_SEM" and found[None]["error"] == "PARSE_ERROR"
    assert {r["ok"] for r in stores.line_results(lines, "validate").collect()} == {True, False}
    stream = stores.line_results(stores.read_stream(spark, str(tmp_path / "in")), "fingerprint")
    q = stream.writeStream.format("memory").queryName("lines").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lines").where(F.col("ok")).count() == 1 and spark.table("lines").count() == 4
    with pytest.raises(ValueError):
        stores.line_results(lines, "other")
