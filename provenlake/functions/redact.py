"""Redaction by fixed rules, profiles of consequential words, and the leak re-scan, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: what is replaced, in this order. Written so that RE2 and java.util.regex read them alike.
RULES = (
    (r"\bsk-[A-Za-z0-9_\-]{16,}", "[REDACTED_API_KEY]"),
    (r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\bxox[baprs]-[A-Za-z0-9\-]{10,}", "[REDACTED_SLACK_TOKEN]"),
    (r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}", "[REDACTED_STRIPE_KEY]"),
    (r"\bpypi-[A-Za-z0-9_\-]{20,}", "[REDACTED_PYPI_TOKEN]"),
    (r"\bATATT[A-Za-z0-9_\-=]{20,}", "[REDACTED_ATLASSIAN_TOKEN]"),
    (r"\bBearer\s+[A-Za-z0-9._\-]{20,}", "Bearer [REDACTED_TOKEN]"),
    (r"(?s)-----BEGIN[^-]{0,40}PRIVATE KEY-----.*?-----END[^-]{0,40}PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(?i)\b([A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASSWD|APIKEY|API_KEY)[A-Z0-9_]*)\s*[=:]\s*['\"]?[A-Za-z0-9._\-/+]{12,}['\"]?", "$1=[REDACTED]"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "user@example.invalid"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "0.0.0.0"),
)
LEAK_RULES = 11
PROFILES = {
    "money": ("stripe", "billing", "payment", "payout", "refund", "charge", "invoice", "subscription", "payroll", "transfer", "checkout", "paymentintent"),
    "deploy": ("deploy", "release", "rollout", "rolled out", "shipped to prod", "production", "hotfix", "cut over"),
    "data": ("migration", "migrate", "backfill", "drop table", "truncate", "delete", "purge", "schema change", "reindex"),
    "security": ("auth", "token", "secret", "permission", "acl", "role", "credential", "rotate", "key rotation", "allowlist"),
}
# --- End of fixed values


def redacted(text: Column) -> Column:
    for pattern, value in RULES:
        text = F.regexp_replace(text, pattern, value.replace("[", "\\["))
    return text


def leaks(text: Column) -> Column:
    """Does a secret of the first rules still stand in the text."""
    out = F.lit(False)
    for pattern, _ in RULES[:LEAK_RULES]:
        out = out | text.rlike(pattern)
    return out


def profiles(text: Column) -> Column:
    """The profiles whose words stand in a text; a text can match several."""
    t = F.lower(text)
    hits = []
    for name, words in PROFILES.items():
        c = F.lit(False)
        for w in words:
            c = c | t.contains(w)
        hits.append(F.when(c, name))
    return F.array_compact(F.array(*hits))
