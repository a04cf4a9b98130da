import copy
import hashlib
import json

import pytest

from semquarry.functions import pairs, sem


def made(*clauses, **more):
    return {"schema": sem.SCHEMA, "world": "real", "kind": "fact", "clauses": list(clauses), **more}


SIMPLE = made({"predicate": "like", "roles": {"experiencer": "user", "theme": "coffee"}})
NEGATED = made({"predicate": "accept", "roles": {"agent": "system", "theme": "token"}, "negated": True})
CONDITIONS = made({"predicate": "grant", "roles": {"agent": "system", "target": "access"}, "conditions": [{"predicate": "authenticate", "roles": {"agent": "user"}}, {"predicate": "validate", "roles": {"subject": "token"}}]}) | {"world": "tool", "kind": "instruction"}
RICH = made(
    {"predicate": "delete", "roles": {"agent": {"type": "actor", "id": "a"}, "theme": {"type": "actor", "id": "b"}, "amount": {"type": "quantity", "value": 5, "unit": "kg"}}, "modality": "must", "time": {"type": "date", "value": "2026-01-02"}, "conditions": [{"predicate": "confirm", "roles": {"agent": {"type": "actor", "id": "a"}}}], "consequences": [{"predicate": "log", "roles": {}, "negated": True}], "annotations": {"note": " x  y "}},
    references=[{"type": "doc", "ref": "R 1"}], provenance={"by": "me"}, annotations={"k": [1, 2.5, None, True]},
)


@pytest.mark.parametrize(("form", "digests"), [(SIMPLE, ("2d519cac", "e3f89e38", "8f94baeb")), (NEGATED, ("e7c030f6", "829b297f", "da95e09f")), (CONDITIONS, ("48717043", "8ed96778", None))])
def test_profiles_are_golden(form, digests):
    """First digits of the digests of codes that other implementations write."""
    for profile, digest in zip(sem.PREFIX, digests, strict=True):
        assert digest is None or hashlib.sha256(sem.encode(form, profile).encode()).hexdigest().startswith(digest)


@pytest.mark.parametrize("form", [SIMPLE, NEGATED, CONDITIONS, RICH])
@pytest.mark.parametrize("profile", list(sem.PREFIX))
def test_profiles_round_trip(form, profile):
    assert sem.decode(sem.encode(form, profile), profile) == sem.canonical(form)


@pytest.mark.parametrize("code", ["", "LUNUM-X/0.1:{}", "LUNUM-TIGHT/0.1:[]", 'LUNUM-TIGHT/0.1:["a","b","c",[["p"]]]', "LUNUM-SHORT/0.1:{}", 'LUNUM-SAFE/0.1:{"schema":1}', "LUNUM-SAFE/0.1:[1]"])
def test_bad_codes_are_refused(code):
    with pytest.raises(ValueError):
        sem.decode(code)


def test_annotations_count_for_identity():
    other = copy.deepcopy(RICH)
    other["clauses"][0]["annotations"] = {"note": "z"}
    assert sem.fingerprint(RICH) != sem.fingerprint(other)
    assert sem.canonical(RICH)["clauses"][0]["annotations"] == {"note": "x y"}


def test_rendering():
    assert sem.render(SIMPLE) == "R like user coffee"
    assert sem.render(NEGATED) == "R not accept system token"
    assert sem.render(CONDITIONS) == "T if authenticate user ; validate token then grant system access"
    assert sem.render(RICH) == "R if confirm a then not log"


def test_validation_texts():
    assert sem.validate([]) == ["sem must be an object"]
    assert sem.validate({"schema": sem.SCHEMA, "world": " ", "kind": "k", "clauses": [1, {"predicate": ""}]}) == ["world is required", "clauses[0] must be an object", "clauses[1].predicate is required", "clauses[1].roles must be an object"]


def changed(f):
    other = copy.deepcopy(RICH)
    f(other["clauses"][0])
    return [x[0] for x in pairs.invariants(sem.canonical(RICH), sem.canonical(other))]


def swap(c):
    c["roles"]["agent"]["id"], c["roles"]["theme"]["id"] = "b", "a"
    c["conditions"][0]["roles"]["agent"]["id"] = "b"


def test_invariants():
    assert changed(lambda c: None) == []
    assert changed(swap) == ["role-identity"] * 3
    assert changed(lambda c: c["roles"]["agent"].update(id="z")) == []  # new content, no swap
    assert changed(lambda c: c.update(negated=True)) == ["negation-flip"]
    assert changed(lambda c: c.update(modality="may")) == ["obligation-permission"]
    assert changed(lambda c: c.pop("conditions")) == ["condition-change"]
    assert changed(lambda c: c["roles"]["amount"].update(value=6)) == ["protected-literal"]
    assert changed(lambda c: c["roles"]["amount"].update(unit="g")) == ["protected-literal"]


@pytest.mark.parametrize(("value", "out"), [({"type": "quantity", "value": None}, None), ({"type": "range", "value": 1, "max": 3}, ("range", '{"min":1,"max":3,"unit":null}')), ({"type": "url", "ref": "http://x"}, ("url", '{"value":"http://x"}')), ({"type": "date", "value": True}, None), ({"type": "identifier"}, None), ("text", None), ([1], None)])
def test_literals(value, out):
    assert pairs.literal(value) == out


def test_verdicts():
    form, other = sem.canonical(RICH), copy.deepcopy(RICH)
    assert pairs.gated(form, form)["verdict"] == "match" and pairs.gated(form, form)["summary"].startswith("Perfect match")
    other["clauses"][0]["roles"]["manner"] = "fast"
    assert pairs.gated(form, sem.canonical(other))["verdict"] == "partial"
    other["clauses"][0]["negated"] = True
    found = pairs.gated(form, sem.canonical(other))
    assert (found["verdict"], found["blocked"], found["gates_passed"], found["failed_codes"]) == ("mismatch", True, 4, ["negation-flip"])
    assert pairs.gated(form, sem.canonical(other), enforced=())["verdict"] == "mismatch"


def test_near():
    form, other = sem.canonical(RICH), copy.deepcopy(RICH)
    assert pairs.near(form, form)["similarity"] == 1
    other["clauses"][0]["roles"]["manner"] = {"type": "how", "id": "fast"}
    found = pairs.near(form, sem.canonical(other), 0.8)
    assert found["compatible"] and 0.8 < found["similarity"] < 1
    assert not pairs.near(form, sem.canonical(other | {"world": "fiction"}))["compatible"]
    assert pairs.near(form, sem.canonical(other), protected=("fast",))["reasons"] == ['protected literal differs: "fast"']
    assert sem.near_parse(sem.near_text(RICH)) == (sem.near_tokens(RICH)[0], frozenset(sem.near_tokens(RICH)[1]))
    assert sem.near_parse(sem.near_text(RICH)[:-1]) is None and sem.near_parse(None) is None


def test_retention_and_placement():
    assert pairs.retention(RICH, RICH, literals=()) == dict.fromkeys(pairs.GATES, 1.0)
    found = pairs.retention(RICH, made(), "", "5 kg only", ("5 KG", "6 kg"))
    assert found == {"exact": 0.0, "feature": 0.0, "literal": 0.5, "role": 0.0, "negation": 1.0, "modality": 0.0}
    assert pairs.placed(RICH, RICH, ["a", "5", "R 1", "q"]) == ["placed", "placed", "placed", "literal-not-in-gold"]
    moved = json.loads(json.dumps(RICH).replace('"theme"', '"other"'))
    assert pairs.placed(RICH, moved, ["b"]) == ["wrong-role"] and pairs.placed(RICH, SIMPLE, ["b"]) == ["missing"]
