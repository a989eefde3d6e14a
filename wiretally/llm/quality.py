"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import WORD

SYMBOLS = "#*$%&|<>"
PLACE_BITS = 24
#: Frequent short words of the languages looked for.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "be", "are",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "sich", "dem",
    "de", "la", "le", "les", "et", "des", "un", "une", "que", "est", "pour", "dans",
    "el", "los", "las", "en", "se", "del", "por", "con", "una", "para",
)


@dataclass(frozen=True)
class Rule:
    """A document fails where `measure` is below `least` or above `most`."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The limits suit prose of any of the four languages; each keeps all but clear junk.
RULES = (
    Rule("length", "n_words", 50, 100_000),
    Rule("repeated_windows", "repeat_share", None, 0.5),
    Rule("word_length", "mean_word_length", 2.5, 12.0),
    Rule("symbols", "symbol_share", None, 0.1),
    Rule("marks", "mark_share", None, 0.12),
    Rule("capitals", "capital_share", None, 0.5),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("repeated_lines", "dup_line_share", None, 0.3),
    Rule("bullets", "bullet_share", None, 0.9),
    Rule("ellipses", "ellipsis_share", None, 0.3),
)


def measures(text: str = "text") -> list[dict[str, Column]]:
    """Projections, each built on the columns of those before; later ones name earlier columns."""
    x = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(x, "\n"), lambda y: y.rlike(WORD))
    w, n = F.col("_w"), F.size("_w")
    # windows as hash bits and place in one number, sorted: equal windows are neighbours
    same = lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)
    place = lambda y: y.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    full = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    every = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    packed = F.when((n >= 3) & (n <= 1 << PLACE_BITS), F.sort_array(F.transform(
        every, lambda i: full(i).bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>"))
    s, t = F.col("_s"), F.col("_t")
    twice = F.filter(s, lambda y, i: same(y, F.get(s, i - 1)) | same(y, F.get(s, i + 1)))
    # Where the kept bits take unlike windows for equal, and in texts with more words than places, the
    # windows are sorted again by their whole hash
    unlike = lambda a, b: F.exists(F.sequence(F.lit(0), F.lit(2)), lambda j: F.get(w, (place(a) + j).cast("int")) != F.get(w, (place(b) + j).cast("int")))
    mixed = F.exists(F.transform(t, lambda y, i: F.coalesce(same(y, F.get(t, i + 1)) & unlike(y, F.get(t, i + 1)), F.lit(False))), lambda y: y)
    wide = F.when(mixed | (n > 1 << PLACE_BITS), F.sort_array(F.transform(every, lambda i: F.struct(full(i).alias("h"), i.cast("long").alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:bigint>>"))
    v = F.col("_v")
    again = F.filter(v, lambda y, i: (y.getField("h") == F.get(v, i - 1).getField("h")) | (y.getField("h") == F.get(v, i + 1).getField("h")))
    places = F.sort_array(F.when(F.size(v) > 0, F.transform(again, lambda y: y.getField("i"))).otherwise(F.transform(t, place)))
    q = F.col("_p")
    covered = F.aggregate(F.transform(q, lambda y, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(q, i + 1) - y, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)
    count = lambda pattern: F.regexp_count(x, F.lit(pattern)).cast("long")
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    long = lambda c: c.cast("long")
    return [
        {"_w": words, "_l": lines},
        {"_s": packed, "n_words": long(n), "word_chars": long(F.char_length(F.array_join(w, ""))), "n_symbols": count(f"[{SYMBOLS}]"),
         "n_lines": long(F.size("_l")), "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))),
         "n_stop_words": long(F.size(F.filter(w, lambda y: y.isin(*STOP_WORDS, *[v.capitalize() for v in STOP_WORDS])))),
         "_upper": count(r"\p{Lu}"), "_marks": count("[!?*#$%&|]"), "_bullets": count(r"(?m)^[ \t]*[-*•]"), "_ellipses": count(r"(?m)(?:\.\.\.|…)[ \t]*$")},
        {"_t": twice},
        {"_v": wide},
        {"_p": places},
        {"n_repeat_words": long(covered)},
        {"repeat_share": part("n_repeat_words", "n_words"), "mean_word_length": part("word_chars", "n_words"),
         "symbol_share": part("n_symbols", "word_chars"), "mark_share": part("_marks", "word_chars"), "capital_share": part("_upper", "word_chars"),
         "dup_line_share": part("n_dup_lines", "n_lines"), "bullet_share": part("_bullets", "n_lines"), "ellipsis_share": part("_ellipses", "n_lines")},
    ]


def verdict(rules=RULES) -> Column:
    """Names of the rules a row of measures fails, in table order."""
    failed = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (F.col(r.measure) < F.lit(float(r.least)))
        if r.most is not None:
            bad = bad | (F.col(r.measure) > F.lit(float(r.most)))
        failed.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*failed))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, measures, base_failed, failed_rules, kept) for every row; a null text has no words,
    so it fails on length. Columns of `docs` other than doc_id and text play no part."""
    rows = docs.select("doc_id", "text")
    for step in measures():
        held = [n for n in step if n in ("_w", "_l", "_s", "_t", "_v", "_p")]
        # arrays that later expressions look into are made once, by a generator of one row: a plain
        # projection would be merged into the next and computed again for every element
        for name in held:
            rows = rows.withColumn(name, F.explode(F.array(step[name])))
        rows = rows.withColumns({n: c for n, c in step.items() if n not in held})
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base).withColumn("failed_rules", verdict(rules))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return rows.drop("text", *[c for c in rows.columns if c.startswith("_")])
