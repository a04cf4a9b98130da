"""Baseline parsing by rules: every rule whose pattern a text has makes a clause, its roles from first groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules by language, in order: predicate, pattern, and the patterns of its roles. ``(?i)`` ignores case.
RULES = {
    "en": [
        ("statement", r"(?i)\b(?:is|are|was|were|be|been|being)\b", {"subject": r"^(?:\s*)([A-Z][a-z]+)(?:\s+(?:is|are|was|were|be|been|being))", "object": r"^(?:is|are|was|were|be|been|being)\s+(.+)$"}),
        ("question", r"(?i)\b(?:what|where|when|who|why|how)\b", {"questionWord": r"(?i)((?:what|where|when|who|why|how))", "subject": r"(?i)^(?:what|where|when|who|why|how)\s+(.+)$"}),
        ("location", r"(?i)\b(?:in|on|at|to|from|by|with)\b", {"location": r"(?:in|on|at|to|from|by|with)\s+(.+)$"}),
        ("negation", r"(?i)\b(?:not|no|never|neither|nobody|nothing)\b", {}),
    ],
    "el": [
        ("statement", r"(?i)(είναι|είμαι|είσαι|ήταν|ήμουν|ήσουν)", {"subject": r"([Α-Ω][α-ω]+)(?:\s+(?:είναι|είμαι|είσαι|ήταν))", "object": r"(?i)^(?:είναι|είμαι|είσαι|ήταν)\s+(.+)$"}),
        ("question", r"(?i)(τι|πού|πότε|ποιος|γιατί|πώς)", {"questionWord": r"(?i)((?:τι|πού|πότε|ποιος|γιατί|πώς))", "subject": r"(?i)^(?:τι|πού|πότε|ποιος|γιατί|πώς)\s+(.+)$"}),
        ("location", r"(?i)(σε|από|με|για|χωρίς|πάνω)", {"location": r"(?i)(?:σε|από|με|για|χωρίς|πάνω)\s+(.+)$"}),
        ("negation", r"(?i)(όχι|δεν|κανένας|κανένα|ποτέ|τίποτα)", {}),
    ],
    "es": [
        ("statement", r"(?i)\b(?:es|son|está|están|fue|fueron|era|eran)\b", {"subject": r"(?:^|\s)([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)(?:\s+(?:es|son|está|están|fue|fueron|era|eran))", "object": r"(?:es|son|está|están|fue|fueron|era|eran)\s+(.+)$"}),
        ("question", r"(?i)\b(?:dónde|cuándo|cómo|quién|qué|por qué|cuánto)\b", {"questionWord": r"(?i)((?:dónde|cuándo|cómo|quién|qué|por qué|cuánto))", "subject": r"(?i)(?:dónde|cuándo|cómo|quién|qué|por qué|cuánto)\s+(.+)$"}),
        ("location", r"(?i)\b(?:en|a|de|con|sin|para|por|sobre|bajo)\b", {"subject": r"(.+?)(?:\s+(?:en|a|de|con|sin|para|por|sobre|bajo))\s+(.+)$"}),
        ("negation", r"(?i)\b(?:no|nunca|tampoco|nadie)\b", {"subject": r"^(?:no|nunca|tampoco|nadie)\s+(.+)$"}),
    ],
    "id": [
        ("statement", r"(?i)\b(?:adalah|merupakan|berada|terletak)\b", {"subject": r"(.+?)(?:\s+(?:adalah|merupakan|berada|terletak))", "object": r"(?:adalah|merupakan|berada|terletak)\s+(.+)$"}),
        ("question", r"(?i)\b(?:apa|siapa|di mana|kapan|bagaimana|mengapa|berapa)\b", {"questionWord": r"(?i)((?:apa|siapa|di mana|kapan|bagaimana|mengapa|berapa))", "subject": r"(?i)(?:apa|siapa|di mana|kapan|bagaimana|mengapa|berapa)\s+(.+)$"}),
        ("location", r"(?i)\b(di|pada|ke|dari|dengan|tanpa|untuk|oleh|atas|bawah)\b", {"subject": r"(.+?)(?:\s+(?:di|pada|ke|dari|dengan|tanpa|untuk|oleh|atas|bawah))\s+(.+)$"}),
        ("negation", r"(?i)\b(bukan|tidak|belum|sama sekali)\b", {"subject": r"^(?:bukan|tidak|belum|sama sekali)\s+(.+)$"}),
    ],
}
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """A rule's pattern for the JVM: edges of ASCII words, as the rules mean them, and letters of any script without case."""
    return pattern.replace(r"\b", _EDGE).replace("(?i)", "(?iu)")


def parsed(text: Column, language: Column) -> Column:
    """array<struct<predicate, negated, roles: map>> of the clauses that the language's rules find; null for other languages."""
    out = F.when(F.lit(False), F.array())
    for name, rules in RULES.items():
        clauses = []
        for predicate, pattern, roles in rules:
            pairs = [F.struct(F.lit(role).alias("key"), F.nullif(F.trim(F.regexp_extract(text, java(p), 1)), F.lit("")).alias("value")) for role, p in roles.items()]
            pairs = F.array(*pairs) if pairs else F.array().cast("array<struct<key:string,value:string>>")
            found = F.struct(F.lit(predicate).alias("predicate"), F.lit(predicate == "negation").alias("negated"), F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("roles"))
            clauses.append(F.when(text.rlike(java(pattern)), found))
        out = F.when(language == name, F.array_compact(F.array(*clauses))) if name == "en" else out.when(language == name, F.array_compact(F.array(*clauses)))
    return out
