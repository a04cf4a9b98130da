"""Rule classifiers and predicates as columns. All are ordered rules over promoted columns; none needs a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories whose records may be kept in compact form, and those that never are.
ELIGIBLE_CATEGORIES = "preference simple_fact tool_event project_state retrieval_rule system_fact benchmark_result".split()
NATURAL_ONLY = "conditional_instruction safety_constraint safety_event exact_quote code command file_path url legal_text medical_text social_nuance ambiguous complex_modality".split()
#: The risk that a category has unless another is given.
TYPICAL_RISK = dict.fromkeys(ELIGIBLE_CATEGORIES, "low") | {"conditional_instruction": "medium", "safety_constraint": "high", "safety_event": "high", "exact_quote": "low", "code": "medium", "command": "medium", "file_path": "low", "url": "low", "legal_text": "high", "medical_text": "high", "social_nuance": "medium", "ambiguous": "medium", "complex_modality": "medium"}
#: Text that must be kept as it is.
EXACT_PATTERN = r"```|https?://|(^|\s)([A-Za-z]:\\|/)[^\s]+|\b(rm|sudo|curl|wget|git|npm|pnpm|python|node)\s+-?[^\n]*"
#: Patterns of personal data.
EMAIL, PHONE, TITLE_NAME = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"(\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}", r"\b(Mr|Ms|Mrs|Dr|Prof)\b\.?\s+[A-Z][a-z]+"
TENANT = r"^[A-Za-z0-9_-]{1,128}$"
#: Sensitivity of a path; the first match decides, and internal is the default.
SENSITIVITY = [("restricted", r"secret|credential|key|\.env"), ("sensitive", r"user|input|pilot"), ("public", r"eval-results/|datasets/|docs/")]
#: The phases of a retained record, each left when it has lasted its time.
PHASES = "active frozen warm cold deleted".split()
#: Patterns of the secret audit: name, kind, pattern.
SECRET_PATTERNS = [
    ("openai-api-key", "api-key", r"sk-[A-Za-z0-9]{20,}"),
    ("generic-key-prefix", "api-key", r"""(?i)(api[_-]?key|apikey)\s*[:=]\s*['"]?([A-Za-z0-9]{16,})"""),
    ("aws-access-key", "api-key", r"AKIA[0-9A-Z]{16}"),
    ("bearer-token", "bearer-token", r"Bearer\s+[A-Za-z0-9._\-]{20,}"),
    ("basic-auth", "basic-auth", r"Basic\s+[A-Za-z0-9+/=]{16,}"),
    ("env-api-key", "env-credential", r"""(API_KEY|APIKEY|API-KEY)\s*=\s*['"]?[^\s'"]{8,}"""),
    ("env-secret", "env-credential", r"""SECRET\s*=\s*['"]?[^\s'"]{8,}"""),
    ("env-token", "env-credential", r"""TOKEN\s*=\s*['"]?[^\s'"]{8,}"""),
    ("env-password", "env-credential", r"""PASSWORD\s*=\s*['"]?[^\s'"]{8,}"""),
    ("pem-file", "credential-file", r"[\w/\\.~-]+\.pem\b"),
    ("key-file", "credential-file", r"[\w/\\.~-]+\.key\b"),
    ("ssh-private-key", "credential-file", r"[\w/\\.~-]*id_rsa\b"),
]


def decision(rules: list[tuple[Column, str]], default: str | None) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda out, rule: out.when(rule[0], F.lit(rule[1])), rules, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(default))


def reasons(*rules: tuple[Column, Column | str]) -> Column:
    """The texts of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(text) if isinstance(text, str) else text) for rule, text in rules]))


def eligibility_reasons(text: Column, category: Column, risk: Column, confidence: Column, semantic: Column) -> Column:
    """Why a record must stay in natural form; an empty array where it need not."""
    category, risk = F.coalesce(category, F.lit("unknown")), F.coalesce(risk, F.lit("unknown"))
    natural = category.isin(NATURAL_ONLY)
    return reasons(
        (~semantic.eqNullSafe(F.lit(True)), "no_validated_semantics"),
        (F.coalesce(confidence, F.lit(0.0)) < 0.9, "confidence_below_0.90"),
        (risk != "low", F.concat(F.lit("risk_"), risk)),
        (~category.isin(ELIGIBLE_CATEGORIES), F.concat(F.when(natural, "natural_only_category_").otherwise("category_not_allowlisted_"), category)),
        (F.coalesce(text, F.lit("")).rlike(EXACT_PATTERN), "exact_or_executable_text_detected"),
    )


def classified_reasons(text: Column, category: Column, risk: Column, confidence: Column, semantic: Column) -> Column:
    """Like ``eligibility_reasons``, against the taxonomy of all categories."""
    return reasons(
        (~semantic.eqNullSafe(F.lit(True)), "no_validated_semantics"),
        (confidence < 0.9, "confidence_below_90"),
        (risk != "low", F.concat(F.lit("risk_"), risk)),
        (~category.isin(ELIGIBLE_CATEGORIES), F.concat(F.when(category.isin(NATURAL_ONLY), "natural_only_category_").otherwise("category_not_in_taxonomy_"), category)),
        (F.coalesce(text, F.lit("")).rlike(EXACT_PATTERN), "exact_or_executable_text_detected"),
    )


def typical_risk(category: Column) -> Column:
    return decision([(category.isin([c for c, r in TYPICAL_RISK.items() if r == risk]), risk) for risk in ("low", "medium", "high")], "unknown")


def first_rule(value: Column, rules: list[tuple[str, str]], default: str) -> Column:
    return decision([(F.lower(value).rlike(pattern), name) for name, pattern in rules], default)


def fallback_decision(confidence: Column, missing: Column, high_risk: Column) -> Column:
    """store, review or fallback by confidence bands; a high risk turns store to review."""
    base = F.when((confidence < 0.55) | (missing > 2), "fallback").when((confidence < 0.7) | (missing > 0), "review").otherwise("store")
    return F.when((base == "store") & high_risk, "review").otherwise(base)


def next_phase(phase: Column, elapsed_s: Column, hold: Column, ttl: dict[str, Column]) -> Column:
    """The phase after ``phase`` once it has lasted its time; a deleted or held record keeps its phase."""
    out = F.when(hold | (phase == "deleted"), phase)
    for now, after in zip(PHASES, PHASES[1:], strict=False):
        out = out.when((phase == now) & (elapsed_s >= ttl[now]), F.lit(after))
    return out.otherwise(phase)


def redacted(secret: Column) -> Column:
    return F.when(F.char_length(secret) <= 8, "***").otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("***"), F.right(secret, F.lit(4))))


def domain_confidence(keywords: Column, patterns: Column, tags: Column) -> Column:
    return F.least(F.lit(1.0), 0.35 + 0.12 * keywords + 0.25 * patterns + 0.05 * tags)
