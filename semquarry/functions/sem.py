"""Semantic objects: validation, canonical form, identity, rendering, features and comparison.

Clauses nest without bound, which no struct type expresses, so objects travel as JSON strings and these
kernels run in Arrow-batched functions. Keys are ordered by UTF-16 units and numbers are printed as
ECMAScript prints them, so that canonical bytes, and the digests over them, are the same elsewhere.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names and prefixes of the formats, as they stand in stored records.
SCHEMA, RECORD = "lunum-sem/0.1-draft", "lunum-record/0.1-draft"
RENDERER, SURFACE_RENDERER = "generic-en-pivot/0.1", "surface-telegraph/0.1"
PREFIX = {"safe": "LUNUM-SAFE/0.1:", "short": "LUNUM-SHORT/0.1:", "tight": "LUNUM-TIGHT/0.1:"}
#: Markers of worlds, and the order in which roles are rendered.
WORLDS = {"real": "R", "fiction": "F", "tool": "T", "dream": "D", "belief": "B", "metaphor": "M"}
ROLE_ORDER = "agent experiencer subject actor recipient object theme patient target source destination location time manner value reason evidence".split()
#: Fields in the order of their places in the tight form, with their names in the short form.
CLAUSE_FIELDS = {"predicate": "p", "roles": "r", "negated": "n", "modality": "m", "time": "t", "conditions": "i", "consequences": "o", "annotations": "a"}
SEM_FIELDS = {"schema": "s", "world": "w", "kind": "k", "clauses": "c", "references": "r", "provenance": "p", "annotations": "a"}
NESTED = ("clauses", "conditions", "consequences")
IDENTIFIERS = frozenset(("id", "type", "ref", "language"))
STRINGS = T.ArrayType(T.StringType())
_SPACE = re.compile(r"[\s\ufeff]+")


def string(value) -> str:
    """A scalar as ECMAScript turns it into a string; null as an empty one."""
    return "" if value is None else value if isinstance(value, str) else number(value) if isinstance(value, (bool, int, float)) else stringify(value)


#: Strings of at most this length are kept with what they become: names repeat from object to object.
SHORT = 100


def _kept(f: Callable[[str], str]) -> Callable[[str], str]:
    """``f`` with a bounded table of its results for short strings."""
    known = lru_cache(1 << 16)(f)
    return lambda value: known(value) if len(value) <= SHORT else f(value)


_text = _kept(lambda value: _SPACE.sub(" ", unicodedata.normalize("NFKC", value)).strip(" "))
_identifier = _kept(lambda value: _text(value).replace(" ", "_").lower())
_quote = _kept(lambda value: json.dumps(value, ensure_ascii=False))


def text(value) -> str:
    return _text(string(value))


def identifier(value) -> str:
    return _identifier(string(value))


def number(x: float) -> str:
    """A finite double as ECMAScript prints it."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int) and abs(x) < 10**21:
        return str(x)
    x = float(x)
    if x == 0 or not math.isfinite(x):
        return "0" if x == 0 else "null"
    sign, (mantissa, _, exponent) = "-" * (x < 0), repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits, point = (whole + part).lstrip("0"), len(whole) + int(exponent or 0)
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def stringify(value) -> str:
    """JSON without white space and with keys in the order of their UTF-16 units."""
    if value is None:
        return "null"
    if isinstance(value, str):
        return _quote(value)
    if isinstance(value, (bool, int, float)):
        return number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(stringify, value)) + "]"
    keys = sorted(value) if all(map(str.isascii, value)) else sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join([f"{_quote(k)}:{stringify(value[k])}" for k in keys]) + "}"


def validate(sem) -> list[str]:
    if not isinstance(sem, dict):
        return ["sem must be an object"]
    errors = [] if sem.get("schema") == SCHEMA else [f"schema must equal {SCHEMA}"]
    errors += [f"{name} is required" for name in ("world", "kind") if not string(sem.get(name)).strip()]
    clauses = sem.get("clauses")
    if not isinstance(clauses, list) or not clauses:
        return [*errors, "clauses must be a non-empty array"]
    for i, clause in enumerate(clauses):
        if not isinstance(clause, dict):
            errors.append(f"clauses[{i}] must be an object")
            continue
        errors += [] if string(clause.get("predicate")).strip() else [f"clauses[{i}].predicate is required"]
        errors += [] if isinstance(clause.get("roles"), dict) else [f"clauses[{i}].roles must be an object"]
    return errors


def _value(value):
    if isinstance(value, dict):
        return {k: identifier(v) if k in IDENTIFIERS else _value(v) for k, v in value.items()}
    return [_value(v) for v in value] if isinstance(value, list) else text(value) if isinstance(value, str) else value


def _clause(clause: dict) -> dict:
    roles = clause.get("roles") or {}
    out = {"predicate": identifier(clause.get("predicate")), "negated": clause.get("negated") is True, "roles": {identifier(k): _value(roles[k]) for k in sorted(roles)}}
    if clause.get("modality") is not None:
        out["modality"] = identifier(clause["modality"])
    if clause.get("time") is not None:
        out["time"] = _value(clause["time"])
    out |= {part: [_clause(c) for c in clause[part]] for part in ("conditions", "consequences") if clause.get(part)}
    return out | ({"annotations": _value(clause["annotations"])} if clause.get("annotations") else {})


def canonical(sem: dict) -> dict:
    """Normalized and without defaults left open; clauses keep their order. The object must be valid."""
    out = {"schema": SCHEMA, "world": identifier(sem["world"]), "kind": identifier(sem["kind"]), "clauses": [_clause(c) for c in sem["clauses"]]}
    return out | {part: _value(sem[part]) for part in ("references", "provenance", "annotations") if sem.get(part)}


def fingerprint(sem: dict, length: int = 32, tag: str = "0.1") -> str:
    return f"lfp:{tag}:sha256:{hashlib.sha256(stringify(canonical(sem)).encode()).hexdigest()[: min(64, max(16, length))]}"


def term(value) -> str:
    """What a role's value is rendered as."""
    if isinstance(value, dict):
        return string(next((value[k] for k in ("id", "value", "ref") if value.get(k) is not None), "")).strip()
    return "_".join(filter(None, map(term, value))) if isinstance(value, list) else string(value)


def scalar(value) -> str:
    """What a role's value is compared as."""
    if isinstance(value, dict):
        return string(next((value[k] for k in ("id", "value", "ref") if value.get(k) is not None), stringify(value)))
    return "|".join(map(scalar, value)) if isinstance(value, list) else string(value)


_RANK = {role: i for i, role in enumerate(ROLE_ORDER)}


def _render_clause(c: dict) -> str:
    roles = sorted(c["roles"].items(), key=lambda r: (_RANK.get(r[0], 999), r[0].replace("_", " ")))
    own = " ".join(filter(None, ("not" if c["negated"] else "", c.get("modality", ""), c["predicate"], *(term(v) for _, v in roles))))
    if not c.get("conditions"):
        return own
    parts = [" ; ".join(map(_render_clause, c.get(part, []))) for part in ("conditions", "consequences")]
    return f"if {parts[0]} then {parts[1] or own}"


def render(sem: dict) -> str:
    form = canonical(sem)
    return f"{WORLDS.get(form['world'], form['world'][:1].upper())} {' ; '.join(map(_render_clause, form['clauses']))}".strip()


def _packed(form: dict, fields: dict[str, str], positional: bool):
    """An object or clause in the short form or, ``positional``, in the tight one."""
    inner = {k: [_packed(c, CLAUSE_FIELDS, positional) for c in v] if k in NESTED else v for k, v in form.items() if k != "negated" or v}
    if not positional:
        return {fields[k]: v for k, v in inner.items()}
    row = [1 if k == "negated" and inner.get(k) else inner.get(k) for k in fields]
    while row and row[-1] is None:
        row.pop()
    return row


def _unpacked(value, fields: dict[str, str], positional: bool) -> dict:
    """The inverse of ``_packed``; ValueError where the value has another form."""
    names, clause = list(fields), "predicate" in fields
    least = 2 if clause else 4
    if positional:
        if not isinstance(value, list) or not least <= len(value) <= len(names):
            raise ValueError("not a tight form")
        found = {k: v for k, v in zip(names, value, strict=False) if v is not None}
        found |= {"negated": found.get("negated") == 1} if clause else {}
    else:
        if not isinstance(value, dict):
            raise ValueError("not a short form")
        found = {k: value[short] for k, short in fields.items() if value.get(short) is not None}
        found |= {"negated": found.get("negated") is True} if clause else {}
    kinds = {"predicate": str, "roles": dict, "schema": str, "world": str, "kind": str, "annotations": dict, "provenance": dict, "references": list} | dict.fromkeys(NESTED, list)
    if any(k not in found for k in names[:least]) or any(not isinstance(found[k], kind) for k, kind in kinds.items() if k in found):
        raise ValueError("a field is missing or of another kind")
    return found | {k: [_unpacked(c, CLAUSE_FIELDS, positional) for c in found[k]] for k in NESTED if k in found}


def encode(sem: dict, profile: str) -> str:
    """safe: canonical JSON; short: the same with one-letter keys; tight: positional arrays without trailing nulls."""
    form = canonical(sem)
    return PREFIX[profile] + stringify(form if profile == "safe" else _packed(form, SEM_FIELDS, profile == "tight"))


def decode(code: str, profile: str | None = None) -> dict:
    """The canonical object of an encoded one; ValueError for another form, or another profile than the one expected."""
    found = next((k for k, prefix in PREFIX.items() if code.startswith(prefix)), None)
    if found is None or profile not in (None, found):
        raise ValueError(f"expected {profile or 'a profile'}, received {found}")
    form = json.loads(code[len(PREFIX[found]) :])
    form = form if found == "safe" else _unpacked(form, SEM_FIELDS, found == "tight")
    if validate(form):
        raise ValueError("; ".join(validate(form)))
    return canonical(form)


def flatten(sem: dict) -> Iterator[tuple[str, str, str, int, int, dict]]:
    """(path, parent path, relation, depth, ordinal, clause) of every clause, outermost first."""
    def walk(clauses: list, parent: str, relation: str, depth: int):
        for i, c in enumerate(clauses):
            path = f"{parent}{'.' * bool(parent)}{relation}[{i}]"
            yield path, parent, relation, depth, i, c
            yield from walk(c.get("conditions") or [], path, "condition", depth + 1)
            yield from walk(c.get("consequences") or [], path, "consequence", depth + 1)

    yield from walk(sem["clauses"], "", "root", 0)


def features(sem: dict) -> list[str]:
    """Distinct features for recall and precision: world, kind, predicates, polarity, modality and roles, with their paths."""
    return form_features(canonical(sem))


def form_features(form: dict) -> list[str]:
    """The features of a canonical object."""
    out = {f"world:{form['world']}", f"kind:{form['kind']}"}
    for path, c in _numbered(form["clauses"], ""):
        out |= {f"predicate:{path}:{c['predicate']}", f"negated:{path}:{string(c['negated'])}"}
        out |= {f"modality:{path}:{c['modality']}"} if c.get("modality") else set()
        out |= {f"role:{path}:{k}:{scalar(v)}" for k, v in c["roles"].items()}
    return sorted(out)


def _numbered(clauses: list, before: str) -> Iterator[tuple[str, dict]]:
    for i, c in enumerate(clauses):
        yield f"{before}{i}", c
        for part, name in (("conditions", "condition"), ("consequences", "consequence")):
            yield from _numbered(c.get(part, []), f"{before}{i}.{name}.")


#: Weights of the near-semantic features.
WEIGHTS = {"predicate": 4, "role": 3, "role-type": 2, "role-id": 2, "role-ref": 2, "role-value": 2, "role-language": 1, "role-cardinality": 1, "relation": 1, "reference-type": 2, "reference-id": 2, "reference-ref": 2, "reference-value": 2}


def _shape(c: dict) -> str:
    return stringify({"negated": c["negated"], "modality": c.get("modality"), **{part: sorted(map(_shape, c.get(part, []))) for part in ("conditions", "consequences")}})


def _near_features(form: dict) -> Counter:
    """Weight of each feature, by its name."""
    found: Counter = Counter()

    def add(kind: str, *rest) -> None:
        found[":".join((kind, *map(string, rest)))] += WEIGHTS[kind]

    def term_of(predicate: str, role: str, value) -> None:
        if isinstance(value, list):
            add("role-cardinality", predicate, role, len(value))
            for v in value:
                term_of(predicate, role, v)
        elif isinstance(value, dict):
            add("role-type", predicate, role, value.get("type", "undefined"))
            for key in ("id", "ref", "language"):
                if isinstance(value.get(key), str):
                    add(f"role-{key}", predicate, role, value[key])
            if "value" in value:
                add("role-value", predicate, role, stringify(value["value"]))
        else:
            add("role-value", predicate, role, stringify(value))

    for _, _, relation, _, _, c in flatten(form):
        predicate = c["predicate"] or "-"
        add("relation", relation), add("predicate", c["predicate"])
        for role, value in c["roles"].items():
            add("role", role), term_of(predicate, role, value)
        if "time" in c:
            term_of(predicate, "time", c["time"])
    for reference in form.get("references", []):
        add("reference-type", reference.get("type", "undefined"))
        for key in ("id", "ref"):
            if isinstance(reference.get(key), str):
                add(f"reference-{key}", reference[key])
        if "value" in reference:
            add("reference-value", stringify(reference["value"]))
    return found


def primitive(value) -> str:
    kind = "null" if value is None else "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "number"
    return f"{kind}:{stringify(value)}"


def primitives(value) -> Iterator[str]:
    """All scalars below a value, with their types."""
    if isinstance(value, (list, dict)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from primitives(v)
    else:
        yield primitive(value)


def _literals(value) -> Iterator[str]:
    if isinstance(value, list):
        for v in value:
            yield from _literals(v)
    elif isinstance(value, dict):
        if isinstance(value.get("ref"), str):
            yield f"ref:{stringify(value['ref'])}"
        if "value" in value:
            yield from primitives(value["value"])
    else:
        yield primitive(value)


def hard_signature(form: dict) -> dict:
    """What two objects must agree on to be near: worlds, clause shapes and literals."""
    literals = [x for *_, c in flatten(form) for v in (*c["roles"].values(), *([c["time"]] if "time" in c else [])) for x in _literals(v)]
    literals += [x for reference in form.get("references", []) for x in _literals({k: v for k, v in reference.items() if k in ("ref", "value")})]
    return {"schema": form["schema"], "world": form["world"], "kind": form["kind"], "clauseShapes": sorted(map(_shape, form["clauses"])), "literals": sorted(literals)}


def _sha(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


_token = _kept(lambda value: _sha(value)[:16])


def near_tokens(sem: dict) -> tuple[str, list[str]]:
    """(digest of what must agree, weighted tokens of what may differ)."""
    return form_tokens(canonical(sem))


def form_tokens(form: dict) -> tuple[str, list[str]]:
    """The near-semantic digest and tokens of a canonical object."""
    return _sha(stringify(hard_signature(form))), sorted([_token(f"{f}#{i}") for f, n in _near_features(form).items() for i in range(n)])


def near_text(sem: dict) -> str:
    """The near-semantic fingerprint, with a checksum over its digest and tokens."""
    hard, tokens = near_tokens(sem)
    rest = f"{hard}:{'.'.join(tokens) or '-'}"
    return f"nfp:2:sha256:{_sha(rest)}:{rest}"


_NEAR = re.compile(r"nfp:2:sha256:([a-f0-9]{64}):([a-f0-9]{64}):(-|[a-f0-9]{16}(?:\.[a-f0-9]{16})*)")


def near_parse(code: str | None) -> tuple[str, frozenset[str]] | None:
    """(hard digest, tokens) of a near-semantic fingerprint; None where its form or checksum is wrong."""
    m = _NEAR.fullmatch(code or "")
    if not m or _sha(f"{m[2]}:{m[3]}") != m[1]:
        return None
    return m[2], frozenset() if m[3] == "-" else frozenset(m[3].split("."))


def json_udf(kernel: Callable, kind: T.DataType) -> Callable[[Column], Column]:
    """A column function from JSON text: null where the text is no valid semantic object."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        def one(value):
            try:
                sem = json.loads(value)
            except (TypeError, ValueError):
                return None
            return None if validate(sem) else kernel(sem)

        return values.map(one)

    return run


@F.pandas_udf(STRINGS)
def validation_errors(values: pd.Series) -> pd.Series:
    def one(value):
        try:
            return validate(json.loads(value))
        except (TypeError, ValueError):
            return ["not JSON"]

    return values.map(one)


canonical_json = json_udf(lambda s: stringify(canonical(s)), T.StringType())
sem_fingerprint = json_udf(fingerprint, T.StringType())
rendered = json_udf(render, T.StringType())
feature_list = json_udf(features, STRINGS)
near_fingerprint = json_udf(near_text, T.StringType())


def encoded(profile: str) -> Callable[[Column], Column]:
    return json_udf(lambda s: encode(s, profile), T.StringType())


@F.pandas_udf(T.StringType())
def decoded_json(codes: pd.Series) -> pd.Series:
    """Canonical JSON of encoded objects; null where the code is no encoding."""

    def one(code):
        try:
            return stringify(decode(code))
        except (AttributeError, TypeError, ValueError):
            return None

    return codes.map(one)


def near_parts(code: Column) -> Column:
    """(hard, tokens) of a near-semantic fingerprint, with no Python; null where its form or checksum is wrong."""
    part = lambda k: F.regexp_extract(code, r"^nfp:2:sha256:([a-f0-9]{64}):([a-f0-9]{64}):(-|[a-f0-9]{16}(?:\.[a-f0-9]{16})*)$", k)
    tokens = F.when(part(3) == "-", F.array().cast("array<string>")).otherwise(F.split(part(3), r"\."))
    return F.when(F.sha2(F.concat(part(2), F.lit(":"), part(3)), 256) == part(1), F.struct(part(2).alias("hard"), tokens.alias("tokens")))


def surface_object(text_: Column) -> Column:
    """The heuristic object of a text that was not parsed, as JSON."""
    clause = F.struct(F.lit("surface").alias("predicate"), F.struct(F.struct(F.lit("text").alias("type"), text_.alias("value")).alias("text")).alias("roles"), F.lit(False).alias("negated"))
    return F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit("surface_telegraph").alias("kind"), F.lit("real").alias("world"), F.array(clause).alias("clauses")))


#: The later schema, and what it allows as modalities and as fields of provenance and annotations.
SCHEMA_02 = "lunum-sem/0.2"
MODALITIES_02 = "fact opinion belief possibility necessity obligation permission ability intention certainty".split()
FIELDS_02 = {"provenance": ("source", "author", "timestamp", "license"), "annotations": ("confidence", "tags", "notes")}


def forward(sem: dict) -> tuple[dict, str, list[str]]:
    """(object in the later schema, its fingerprint, warnings): modalities and fields are locked, times become strings."""
    warnings: list[str] = []

    def upgraded(clause: dict) -> dict:
        out = dict(clause)
        modality, time = out.get("modality"), out.get("time")
        if isinstance(modality, str) and modality not in MODALITIES_02:
            out["modality"] = "certainty"
            warnings.append("MODALITY_LOCKED")
        if time is not None and not isinstance(time, str):
            out["time"] = json.dumps(time, ensure_ascii=False, separators=(",", ":")) if isinstance(time, (dict, list)) else string(time)
            warnings.append("TIME_STRINGIFIED")
        return out

    out = dict(sem) | {"clauses": [upgraded(c) for c in sem["clauses"]]}
    for part, allowed in FIELDS_02.items():
        if out.get(part):
            warnings += [f"{part.upper().rstrip('S')}_FIELD_REMOVED" for k in out[part] if k not in allowed]
            out[part] = {k: out[part][k] for k in allowed if k in out[part]}
    return out | {"schema": SCHEMA_02}, fingerprint(out | {"schema": SCHEMA}, tag="0.2"), warnings


def record(sem: dict, category: str | None = None) -> dict:
    """Canonical object, fingerprint, rendering and category of a record."""
    form = canonical(sem)
    return {"recordVersion": RECORD, "sem": form, "fingerprint": fingerprint(form), "renderings": {RENDERER: {"code": render(form), "profile": RENDERER, "tokens": None}}, "category": category or form["kind"]}


forward_fingerprint = json_udf(lambda s: forward(s)[1], T.StringType())
forward_warnings = json_udf(lambda s: forward(s)[2], STRINGS)


def computed_fingerprint(value: Column, tag: str = "1.0") -> Column:
    """A semantic fingerprint for JSON objects, a surface one for any other text."""
    from .text import surface_fingerprint

    @F.pandas_udf(T.StringType())
    def semantic(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                found = json.loads(v)
            except (TypeError, ValueError):
                return None
            return None if validate(found) else fingerprint(found, tag=tag)

        return values.map(one)

    return F.coalesce(semantic(value), surface_fingerprint(value, tag=tag))
