"""Deterministic checks of model output: personal data, toxic terms, numbers without a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern and severity by kind of personal data or credential; the prefixes belong to the patterns.
PII = {
    "email": (r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b", 0.4),
    "credit_card": (r"\b(?:\d[ -]*?){13,19}\b", 0.9),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", 0.9),
    "phone": (r"\b(?:\+\d{1,3}[ -]?)?(?:\(\d{3}\)|\d{3})[ -]\d{3}[ -]\d{4}\b", 0.4),
    "api_key": (r"\b(?:sk-[A-Za-z0-9_-]{16,}|lo_live_[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{36})\b", 1.0),
    "aws_key": (r"\bAKIA[0-9A-Z]{16}\b", 1.0),
}
#: Toxic terms, found anywhere in the lower-cased output.
TOXIC_TERMS = ["disgusting", "dumbass", "hate you", "idiot", "kill yourself", "moron", "pathetic", "shut up", "stupid", "worthless"]
#: Numbers that are evidence of nothing.
COMMON_NUMBERS = ["0", "1", "2", "3", "4", "5", "10", "100"]
NUMBER = r"\b\d[\d,]*(?:\.\d+)?%?\b"
LISTED = 5


def redacted(value: Column) -> Column:
    v = F.trim(value)
    n = F.length(v)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(v, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(v, F.lit(2))))


def luhn_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def pii_matches(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + PII[kind][0]), F.lit(0))
    return F.filter(found, luhn_valid) if kind == "credit_card" else found


def pii_finding(text: Column) -> Column:
    """struct(severity, matches by kind, redacted); null if nothing is found."""
    matches = {k: pii_matches(text, k) for k in PII}
    severity = F.greatest(*[F.when(F.size(m) > 0, F.lit(PII[k][1])).otherwise(F.lit(0.0)) for k, m in matches.items()])
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.transform(F.slice(m, 1, LISTED), redacted).alias("values")) for k, m in matches.items()])
    return F.when(severity > 0, F.struct(severity.alias("severity"), F.filter(listed, lambda x: F.size(x["values"]) > 0).alias("matches")))


def toxic_terms(text: Column) -> Column:
    lowered = F.lower(text)
    return F.filter(F.array(*map(F.lit, TOXIC_TERMS)), lambda t: F.contains(lowered, t))


def toxicity_severity(text: Column) -> Column:
    n = F.size(toxic_terms(text))
    return F.when(n > 0, F.least(F.lit(1.0), 0.5 + 0.25 * (n - 1)))


def unsupported_numbers(text: Column, context: Column) -> Column:
    """Numbers of the output that do not occur in the context; null without a context."""
    haystack = F.replace(F.array_join(context, " "), F.lit(","), F.lit(""))
    clean = lambda m: F.replace(F.rtrim(m, F.lit("%")), F.lit(","), F.lit(""))
    found = F.regexp_extract_all(text, F.lit("(?U)" + NUMBER), F.lit(0))
    missing = F.filter(found, lambda m: (clean(m) != "") & ~clean(m).isin(COMMON_NUMBERS) & ~F.contains(haystack, clean(m)))
    return F.when(F.size(context) > 0, missing)


def grounding_severity(text: Column, context: Column) -> Column:
    n = F.size(unsupported_numbers(text, context))
    return F.when(n > 0, F.round(F.least(F.lit(0.8), 0.3 + 0.15 * n), 6))


CHECKS = ("pii", "grounding", "toxicity")


def findings(text: Column, context: Column, enabled: dict[str, Column] | None = None, more: dict[str, Column] | None = None) -> Column:
    """Findings (check, severity), worst first; equal ones in the order of CHECKS. enabled: conditions by check, all if None.

    more: checks of one's own by name, as struct(value: severity or null, error) of isolated(); one that fails gives no finding
    for its row, and check_errors() says why."""
    severities = {"pii": pii_finding(text)["severity"], "grounding": grounding_severity(text, context), "toxicity": toxicity_severity(text)}
    severities |= {name: c["value"] for name, c in (more or {}).items()}
    made = []
    for i, name in enumerate(severities):
        s = severities[name]
        on = F.lit(True) if enabled is None else enabled.get(name, F.lit(False))
        made.append(F.when(on & s.isNotNull(), F.struct((-s).alias("key"), F.lit(i).alias("ordinal"), F.lit(name).alias("check"), s.alias("severity"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*made))), lambda f: F.struct(f["check"].alias("check"), f["severity"].alias("severity")))


def check_errors(more: dict[str, Column]) -> Column:
    """(check, reason) of the own checks that failed for a row."""
    return F.array_compact(F.array(*[F.when(c["error"].isNotNull(), F.struct(F.lit(n).alias("check"), c["error"].alias("reason"))) for n, c in more.items()]))


def worst(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda f: f["severity"])), F.lit(0.0))
