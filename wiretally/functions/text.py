"""Lexical column functions over names; everything stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------
MAX_DOMAIN = 253
DOMAIN_PATTERN = r"^[a-z0-9_*-]{1,63}(\.[a-z0-9_*-]{1,63})*$"
DNS_LEXICAL_FEATURES = (
    "dns_domain_length", "dns_label_count", "dns_longest_label_length", "dns_subdomain_depth",
    "dns_payload_length", "dns_suffix_length", "dns_char_entropy", "dns_digit_ratio",
    "dns_vowel_ratio", "dns_unique_char_ratio", "dns_hex_ratio", "dns_longest_consonant_run",
    "dns_hyphen_count", "dns_digit_present",
)
# --------------------------------------------------------------------------------


def chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _share(x: Column, keep: str) -> Column:
    """Share of characters matching the class `keep`."""
    n = F.length(x)
    hits = F.length(F.regexp_replace(x, f"[^{keep}]", ""))
    return F.when(n > 0, hits / n).otherwise(0.0)


def char_entropy(x: Column) -> Column:
    n = F.length(x).cast("double")
    counts = F.transform(
        F.array_distinct(chars(x)),
        lambda c: (F.length(x) - F.length(F.replace(x, c, F.lit("")))) / n,
    )
    bits = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.length(x) > 0, bits).otherwise(0.0)


def digit_ratio(x: Column) -> Column:
    return _share(x, "0-9")


def hex_ratio(x: Column) -> Column:
    return _share(x, "0-9a-f")


def vowel_ratio(x: Column) -> Column:
    letters = F.length(F.regexp_replace(x, "[^a-zA-Z]", ""))
    vowels = F.length(F.regexp_replace(x, "[^aeiou]", ""))
    return F.when(letters > 0, vowels / letters).otherwise(0.0)


def unique_char_ratio(x: Column) -> Column:
    return F.when(F.length(x) > 0, F.size(F.array_distinct(chars(x))) / F.length(x)).otherwise(0.0)


def longest_consonant_run(x: Column) -> Column:
    runs = F.regexp_extract_all(x, F.lit("([b-df-hj-np-tv-zA-Z]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def canonical_domain(x: Column) -> Column:
    """Trimmed, lower-case name without trailing dots, or null when it is not a valid name."""
    name = F.lower(F.regexp_replace(F.trim(x), r"\.+$", ""))
    ok = (F.length(name) <= MAX_DOMAIN) & name.rlike(DOMAIN_PATTERN)
    return F.when(ok, name)


def labels_of(x: Column) -> Column:
    return F.filter(F.split(x, r"\."), lambda p: p != "")


def payload_of(x: Column) -> Column:
    """Labels left of the last two, joined; the first label of a short name; else the name."""
    parts = labels_of(x)
    n = F.size(parts)
    left = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), n - 2)), "")
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    return F.when(n > 2, left).otherwise(first)


def dns_lexical(x: Column) -> dict[str, Column]:
    """The 14 lexical features of one validated name, as named columns."""
    return lexical_of(x, **name_parts(x))


def name_parts(x: Column) -> dict[str, Column]:
    """What most lexical features share; as columns of their own they are built once for a row."""
    payload = payload_of(x)
    return {"parts": labels_of(x), "payload": payload, "body": F.when(payload == "", x).otherwise(payload)}


def lexical_of(x: Column, parts: Column, payload: Column, body: Column) -> dict[str, Column]:
    n = F.size(parts)
    suffix = F.aggregate(
        F.slice(parts, F.greatest(F.lit(1), n - 1), F.lit(2)), F.lit(0), lambda a, p: a + F.length(p)
    )
    longest = F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0))
    out = {
        "dns_domain_length": F.length(x),
        "dns_label_count": n,
        "dns_longest_label_length": longest,
        "dns_subdomain_depth": F.greatest(F.lit(0), n - 2),
        "dns_payload_length": F.length(payload),
        "dns_suffix_length": F.when(n > 0, suffix).otherwise(0),
        "dns_char_entropy": char_entropy(body),
        "dns_digit_ratio": digit_ratio(body),
        "dns_vowel_ratio": vowel_ratio(body),
        "dns_unique_char_ratio": unique_char_ratio(body),
        "dns_hex_ratio": hex_ratio(body),
        "dns_longest_consonant_run": longest_consonant_run(body),
        "dns_hyphen_count": F.length(x) - F.length(F.replace(x, F.lit("-"), F.lit(""))),
        "dns_digit_present": F.when(body.rlike("[0-9]"), 1.0).otherwise(0.0),
    }
    return {k: v.cast("double") for k, v in out.items()}


def short_text(x: Column, limit: int = 256) -> Column:
    """Trimmed and cut text; empty becomes null."""
    return F.nullif(F.substring(F.trim(x), 1, limit), F.lit(""))
