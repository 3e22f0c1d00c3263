"""Personal-data patterns: redaction, counts and detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and placeholders. (?U) gives digits, blanks and word
# boundaries their Unicode meaning.
PII_PATTERNS = {
    "email": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?U)(?:(?:\+|00)\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{4}\b",
    "iban": r"(?iU)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "credit_card": r"(?U)\b(?:\d[ -]*?){13,19}\b",
}
PII_REPLACEMENTS = {
    "email": "[EMAIL_REDACTED]",
    "phone": "[PHONE_REDACTED]",
    "iban": "[IBAN_REDACTED]",
    "credit_card": "[CARD_REDACTED]",
}
PII_ORDERS = {
    # The phone pattern eats the digit tail of IBANs and cards when it runs first.
    "compat": ("email", "phone", "iban", "credit_card"),
    "specific_first": ("iban", "credit_card", "email", "phone"),
}


def _possible(kind: str, text: Column) -> Column:
    """Cheap linear test that must hold before the pattern can match."""
    return text.contains("@") if kind == "email" else text.rlike(r"(?U)\d")


def redact_pii(df: DataFrame, col: str = "text", out: str = "redacted_text", counts: str = "redactions", mode: str = "compat") -> DataFrame:
    """Add the redacted text and a map type -> count; each pattern sees the output of the one before."""
    order = PII_ORDERS[mode]
    step = df.withColumn("_pii_0", F.col(col))
    for i, kind in enumerate(order):
        text, pattern = F.col(f"_pii_{i}"), PII_PATTERNS[kind]
        # One projection per pattern: the text of a step is computed once and read twice.
        step = step.withColumn(
            f"_pii_n_{kind}", F.when(_possible(kind, text), F.regexp_count(text, F.lit(pattern))).otherwise(F.lit(0))
        ).withColumn(
            f"_pii_{i + 1}",
            F.when(F.col(f"_pii_n_{kind}") > 0, F.regexp_replace(text, pattern, F.lit(PII_REPLACEMENTS[kind]))).otherwise(text),
        )
    pairs = [x for kind in PII_ORDERS["compat"] for x in (F.lit(kind), F.col(f"_pii_n_{kind}"))]
    return step.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col(f"_pii_{len(order)}").alias(out),
        F.create_map(*pairs).alias(counts),
    )


def contains_pii(col: Column) -> Column:
    """True when any pattern matches; null text holds none."""
    hit = None
    for kind, pattern in PII_PATTERNS.items():
        match = _possible(kind, col) & col.rlike(pattern)
        hit = match if hit is None else hit | match
    return F.coalesce(hit, F.lit(False))
