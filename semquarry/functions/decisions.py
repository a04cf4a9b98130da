"""Decisions by thresholds and ordered rules, as columns: contexts, reviews, gates, risks, support and limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .policy import NATURAL_ONLY, decision, reasons

#: Domains in which nothing is used unasked.
PROHIBITED = "legal_advice medical_diagnosis financial_advice destructive_action_authorization".split()
#: Thresholds of the context's mode: confidence, high confidence, savings, literals, clauses.
LEAST_CONFIDENCE, HIGH_CONFIDENCE, LEAST_SAVINGS, MOST_LITERALS, LEAST_CLAUSES, MOST_CLAUSES = 0.7, 0.9, 0.15, 0.5, 0.5, 0.95
#: Predicates and modalities of high risk.
RISKY_PREDICATES = "grant revoke authorize approve deny reject consent agree opt_in opt_out prohibit forbid restrict block allow permit delete destroy erase purge remove disclose share export transfer encrypt decrypt sign verify escalate alert notify launch execute deploy".split()
RISKY_MODALITIES = "must must_not shall shall_not".split()
#: Weights of the evidence for a parse: syntax, roles, predicate, modality, structure, context.
EVIDENCE_WEIGHTS, LEAST_EVIDENCE = (0.2, 0.15, 0.15, 0.15, 0.2, 0.15), 0.6
#: The confidence under which a parse falls back, less the band in which it is reviewed.
REVIEW_BELOW, BAND = 0.7, 0.15
#: Gates of a parse, of which the last is an upper bound.
PARSE_GATES = {"valid": 0.95, "exact": 0.85, "recall": 0.9, "precision": 0.9, "safety": 1.0, "fallback": 0.1}
#: Gates of a compaction.
COMPACTION_GATES = {"semantic": 0.85, "literal": 0.9, "role": 0.95, "safety": 1.0}
#: What each role of a consumer may do.
PERMISSIONS = {
    "read-only": {"semantics": ("GET",), "fingerprints": ("GET",), "evidence": ("GET",), "health": ("GET",)},
    "parse": {"semantics": ("GET", "POST"), "fingerprints": ("GET",), "evidence": ("GET",), "health": ("GET",)},
    "admin": {"semantics": ("GET", "POST", "DELETE"), "fingerprints": ("GET", "DELETE"), "evidence": ("GET", "POST", "DELETE"), "tenants": ("GET", "POST", "DELETE"), "health": ("GET",)},
}
#: Thresholds of a review: confidence, nearness to a domain (from, to), density of literals.
REVIEW_CONFIDENCE, NEAR_DOMAIN, REVIEW_DENSITY = 0.85, (0.35, 0.5), 0.5


def finite(x: Column) -> Column:
    """``x``, or 0 where it is null, not a number or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def forces_natural(domain: Column) -> Column:
    return F.coalesce(F.lower(domain).isin(PROHIBITED + NATURAL_ONLY), F.lit(False))


def well_parsed(confidences: Column, least: float = LEAST_CONFIDENCE) -> Column:
    return F.size(F.filter(F.coalesce(confidences, F.array().cast("array<double>")), lambda c: c >= least))


def mixed_clauses(confidences: Column) -> Column:
    """Whether some clauses parse well, enough of them and not nearly all."""
    n, good = F.size(F.coalesce(confidences, F.array().cast("array<double>"))), well_parsed(confidences)
    return (good > 0) & (good < n) & (good / n >= LEAST_CLAUSES) & (good / n < MOST_CLAUSES)


def context_mode(domain: Column, review: Column, confidence: Column, density: Column, natural: Column, code: Column, budget: Column, clauses: Column) -> Column:
    """struct(mode, reason): the first of the ordered rules that decides on natural, compact or mixed text.

    Null tokens or budgets are unknown; a budget of 0 or less is none.
    """
    c = finite(confidence)
    saving = F.when(natural > 0, (natural - code) / natural)
    fits = code <= budget
    limited = F.coalesce(budget > 0, F.lit(False))
    saves = (c >= HIGH_CONFIDENCE) & F.coalesce(saving >= LEAST_SAVINGS, F.lit(False))
    rules = [
        (forces_natural(domain), "natural", "domain_forces_natural"),
        (F.coalesce(review, F.lit(False)), "natural", "human_review_required"),
        (c < LEAST_CONFIDENCE, "natural", "low_confidence"),
        (finite(density) >= MOST_LITERALS, "natural", "high_literal_density"),
        (saves & limited & fits, "lunum", "fits_within_budget"),
        (saves & ~limited, "lunum", "token_savings_sufficient"),
        (mixed_clauses(clauses), "mixed", "clause_level_mixed"),
        (F.coalesce((code > 0) & limited & fits, F.lit(False)), "lunum", "decent_confidence"),
    ]
    return F.struct(decision([(rule, mode) for rule, mode, _ in rules], "natural").alias("mode"), decision([(rule, why) for rule, _, why in rules], "default_natural").alias("reason"))


def eligibility_rules(domain: Column, review: Column, confidence: Column, density: Column, validated: Column, complexity: Column, budget: Column, code: Column) -> dict[str, Column]:
    """struct(passed, code, score) of each of the seven rules, in order."""
    made = lambda *cases: [F.struct(F.lit(ok).alias("passed"), F.lit(code_).alias("code"), F.lit(score).cast("double").alias("score")) if not isinstance(score, Column) else F.struct(F.lit(ok).alias("passed"), F.lit(code_).alias("code"), score.alias("score")) for ok, code_, score in cases]

    def first(*rules: tuple[Column | None, bool, str, Column | float]) -> Column:
        structs = made(*[rule[1:] for rule in rules])
        out = F.when(F.lit(False), structs[-1])
        for (when, *_), struct in zip(rules[:-1], structs, strict=False):
            out = out.when(when, struct)
        return out.otherwise(structs[-1])

    low = F.lower(domain)
    unsure = F.coalesce(confidence, F.lit(0.0)) < HIGH_CONFIDENCE
    over = (code - budget) / budget
    return {
        "domain_safety": first((domain.isNull(), True, "no_domain_specified", 1), (low.isin(PROHIBITED), False, "prohibited_domain", 0), (low.isin(NATURAL_ONLY), False, "natural_only_category", 0), (None, True, "domain_allowed", 1)),
        "human_review": first((F.coalesce(review, F.lit(False)), False, "human_review_required", 0), (None, True, "no_human_review_required", 1)),
        "parse_confidence": first((confidence.isNull() | F.isnan(confidence), False, "confidence_missing", 0), (confidence < REVIEW_BELOW, False, "confidence_below_minimum", confidence), (None, True, "confidence_sufficient", confidence)),
        "literal_density": first((density.isNull() | F.isnan(density), True, "density_unknown", 1), (density >= MOST_LITERALS, False, "high_literal_density", 1 - density), (None, True, "literal_density_acceptable", 1 - density)),
        "validated_semantics": first((F.coalesce(validated, F.lit(False)), True, "semantics_validated", 1), (None, True, "semantics_unvalidated", 0.5)),
        "semantic_complexity": first((complexity.isNull(), True, "complexity_unknown", 1), ((complexity == "complex") & unsure, True, "complex_moderate_confidence", 0.5), ((complexity == "moderate") & unsure, True, "moderate_moderate_confidence", 0.75), (complexity == "trivial", True, "trivial_semantics", 1), (None, True, "simple_semantics", 0.8)),
        "token_budget": first((budget.isNull() | code.isNull(), True, "budget_unknown", 1), (code > budget, False, "over_budget", F.greatest(F.lit(0.0), 1 - over)), (None, True, "within_budget", 1 - code / budget)),
    }


def semantic_complexity(clauses: Column, nested: Column, modalities: Column, negations: Column) -> Column:
    """Level by the numbers of clauses, nested clauses, modalities and negations of an object."""
    rich, deep = modalities >= 3, nested > 0
    return decision([((clauses >= 7) & (rich | deep), "complex"), (((clauses >= 4) & deep) | ((clauses >= 5) & rich), "moderate"), ((clauses >= 2) & ((negations > 0) | deep | (modalities >= 2)), "simple")], "trivial")


def clause_complexity(roles: Column, nested: Column, modal: Column, negated: Column) -> Column:
    return decision([((roles >= 5) | (nested >= 2) | (modal & negated), "complex"), ((roles >= 3) | (nested >= 1) | (modal & (roles >= 2)), "moderate"), ((roles >= 2) | modal | negated, "simple")], "trivial")


def record_risk(negated: Column, obliged: Column, permitted: Column, literal: Column) -> Column:
    bound = obliged | permitted
    return decision([(negated & bound, "critical"), (literal, "high"), (bound, "high"), (negated, "medium")], "low")


def risk_reasons(predicate: Column, modality: Column, negated: Column, condition: Column) -> Column:
    """Why a clause is of high risk; an empty array where it is not."""
    quoted = lambda before, x, after: F.concat(F.lit(before), x, F.lit(after))
    return reasons(
        (predicate.isin(RISKY_PREDICATES), quoted("predicate '", predicate, "' is safety-critical")),
        (modality.isin(RISKY_MODALITIES), F.concat(F.lit("modality '"), modality, F.lit("' on '"), predicate, F.lit("' implies obligation/prohibition"))),
        (negated & predicate.isin(RISKY_PREDICATES), quoted("negated safety-critical predicate '", predicate, "'")),
        (condition.isin(RISKY_PREDICATES), quoted("condition predicate '", condition, "' is safety-critical")),
    )


def fallback(confidence: Column, missing_roles: Column, unknown_predicate: Column, missing_features: Column, most_missing: int = 2) -> Column:
    """struct(action, reasons): fallback for a hard reason, review for a soft one, else store."""
    shown = F.format_string("%.3f", confidence)
    hard = reasons((confidence < REVIEW_BELOW - BAND, F.concat(F.lit("confidence "), shown, F.lit(f" below minimum {REVIEW_BELOW}"))), (F.size(missing_roles) > 0, F.concat(F.lit("missing expected roles: "), F.array_join(missing_roles, ", "))), (missing_features > most_missing, F.concat(missing_features.cast("string"), F.lit(f" missing features exceeds maximum {most_missing}"))))
    soft = reasons(((confidence >= REVIEW_BELOW - BAND) & (confidence < REVIEW_BELOW), F.concat(F.lit("confidence "), shown, F.lit(f" in review band [{REVIEW_BELOW - BAND:.3f}, {REVIEW_BELOW:.3f})"))), (unknown_predicate.isNotNull(), F.concat(F.lit("predicate '"), unknown_predicate, F.lit("' not in controlled vocabulary"))))
    return F.struct(decision([(F.size(hard) > 0, "fallback"), (F.size(soft) > 0, "review")], "store").alias("action"), F.concat(hard, soft).alias("reasons"))


def parse_confidence(*evidence: Column) -> Column:
    """Weighted evidence, less where the least of it is low; 0 where some of it is no number."""
    known = [F.coalesce(e, F.lit(0.0)) for e in evidence]
    least, score = F.least(*known), sum((e * w for e, w in zip(known, EVIDENCE_WEIGHTS, strict=True)), F.lit(0.0))
    scaled = F.when(least < LEAST_EVIDENCE, score * (least / LEAST_EVIDENCE)).otherwise(score)
    bad = F.array_contains(F.array(*map(F.isnan, known)), True)
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def enough_evidence(*evidence: Column) -> Column:
    return F.least(*[F.coalesce(e, F.lit(0.0)) for e in evidence]) >= LEAST_EVIDENCE


def uncertainty_action(score: Column, enough: Column) -> Column:
    """store, review or fallback; a missing score falls back, and so does a lack of evidence."""
    missing = score.isNull() | F.isnan(score)
    return decision([(missing | (score < REVIEW_BELOW - BAND) | ~enough, "fallback"), (score < REVIEW_BELOW, "review")], "store")


def review_triggers(domain_confidence: Column, confidence: Column, blocking: Column, density: Column) -> Column:
    """Why a person must look, the most urgent first."""
    return reasons(
        ((domain_confidence >= NEAR_DOMAIN[0]) & (domain_confidence < NEAR_DOMAIN[1]), "prohibited_domain_proximity"),
        (finite(confidence) < REVIEW_CONFIDENCE, "low_confidence"),
        (blocking == 1, "safety_invariant_near_miss"),
        (density >= REVIEW_DENSITY, "protected_literal_density"),
    )


def abstention(confidence: Column, clauses: Column, low: Column, ambiguous: Column) -> Column:
    """struct(score, level, abstain) by a parse's confidence and its shares of sure and of clear clauses."""
    n = F.greatest(clauses, F.lit(1))
    score = confidence * 0.5 + (n - low) / n * 0.3 + (n - ambiguous) / n * 0.2
    level = decision([(score >= 0.9, "high"), (score >= 0.7, "medium"), (score >= 0.5, "low")], "abstain")
    return F.struct(score.alias("score"), level.alias("level"), ((level == "abstain") | (level == "low") & (ambiguous > clauses * 0.5)).alias("abstain"))


def prompt_gate(tokens: Column, preserved: Column, most: int = 4096, least: float = 0.8) -> Column:
    """Errors and warnings of a prompt: too many tokens, nearly too many, too little preserved."""
    return reasons((tokens > most, "too_many_tokens"), ((tokens <= most) & (tokens > most * 0.8), "near_token_limit"), (preserved < least, "preservation_below_minimum"))


def compaction_verdict(scores: Mapping[str, Column]) -> Column:
    failed = [scores[gate] < least for gate, least in COMPACTION_GATES.items()]
    some = failed[0] | failed[1] | failed[2]
    return decision([(failed[3], "blocked"), (some, "fallback-natural")], "compact")


def failed_parse_gates(rates: Mapping[str, Column]) -> Column:
    return reasons(*[(rates[gate] > least if gate == "fallback" else rates[gate] < least, gate) for gate, least in PARSE_GATES.items()])


def downstream_gate(score: Column, warn: float, fail: float, metrics: Mapping[str, tuple[Column, float]]) -> Column:
    """fail, warn or pass by a task's score; a metric under its minimum warns."""
    short = F.lit(False)
    for value, least in metrics.values():
        short = short | F.coalesce(value < least, F.lit(False))
    return decision([(score < fail, "fail"), ((score < warn) | short, "warn")], "pass")


def allowed(role: Column, endpoint: Column, method: Column) -> Column:
    out = F.lit(False)
    for name, endpoints in PERMISSIONS.items():
        for path, methods in endpoints.items():
            out = out | ((role == name) & (endpoint == path) & method.isin(*methods))
    return F.coalesce(out, F.lit(False))


def model_identity(digest: Column, name: Column, architecture: Column, family: Column) -> Column:
    """struct(method, identified): by a digest of the weights, else by metadata, else by name."""
    has, metadata = F.coalesce(digest != "", F.lit(False)), name.isNotNull() & architecture.isNotNull()
    method = decision([(has, "weight-hash"), (metadata, "gguf-metadata"), (name.isNotNull() & family.isNotNull(), "name-only")], "unknown")
    return F.struct(method.alias("method"), F.when(has, digest.rlike("^[a-f0-9]{64}$")).otherwise(method != "unknown").alias("identified"))


def margin(measured: Column, limit: Column, kind: str) -> Column:
    """Percent of a limit that is left: of latencies and rates, of an availability's budget, or above a least throughput."""
    if kind == "availability":
        return F.when(limit == 1, F.when(measured >= 1, 100.0).otherwise(-100.0)).otherwise(((1 - limit) - (1 - measured)) / (1 - limit) * 100)
    if kind == "throughput":
        return F.when(limit == 0, 100.0).otherwise((measured - limit) / limit * 100)
    return F.when(limit == 0, F.when(measured == 0, 100.0).otherwise(-100.0)).otherwise((limit - measured) / limit * 100)
