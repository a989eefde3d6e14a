"""Personal data replaced by keyed surrogates of the same type, in DataFrame functions only.

Found: e-mail addresses, IPv4 addresses, payment cards, account numbers (IBAN form), US social
security numbers, telephone numbers, and names after a title. A surrogate is drawn from a keyed hash
of the entity's canonical form, so the same entity gets the same surrogate in every document, however
it is written. Its form follows the original: digits for digits with the same grouping, a card keeps
its first digit and whether its check digit is right, an account its country, a telephone number its
country code, an address its top-level domain, a name its title's gender, its script and its case.

Over the whole corpus no two entities of a type share a surrogate and none is the surrogate of
another: those that would are drawn again with the next attempt number until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import text_key, written

KEY = "replace-this-key"

# What an entity looks like -------------------------------------------
MALE = "Mr|Herr|Herrn|Monsieur|Señor|Sr|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Sra|Señorita|Госпожа|Κυρία"
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
CARD = (r"(?<![0-9A-Za-z-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"
        r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z-])")
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = (r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])"
         r"|(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
NAME = rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?"
ENTITY = "|".join((EMAIL, IP, IBAN, CARD, SSN, PHONE, NAME))
#: Syllables of invented names, by script.
SYLLABLES = {
    "latin": ("ba", "da", "fe", "ga", "ho", "je", "ka", "li", "mo", "na", "pe", "ro", "sa", "te", "vo", "zu"),
    "cyrillic": ("ба", "ва", "го", "да", "же", "за", "ки", "ле", "мо", "на", "по", "ро", "са", "те", "фо", "хи"),
    "greek": ("βα", "γα", "δε", "ζο", "θι", "κα", "λε", "μο", "να", "ξε", "πο", "ρα", "σο", "τε", "φι", "χα"),
}
ENDINGS = {("latin", "male"): "n", ("latin", "female"): "a", ("cyrillic", "male"): "в", ("cyrillic", "female"): "ва",
           ("greek", "male"): "ς", ("greek", "female"): "η"}
# -----------------------------------------------------------------------------------
TITLE = rf"^((?:{MALE}|{FEMALE})\.? )"


def _let(body, **values: Column) -> Column:
    """body(row) with `values` as fields of the row. A value that an expression needs often is made once
    and named here: inlined, these expressions would grow beyond what a driver can plan."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), 0)


def kind(m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return (
        F.when(m.contains("@"), "email").when(m.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip").when(m.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(m.rlike(r"^\+"), "phone").when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(m.rlike("^[0-9(]") & (digits <= 10), "phone")
        .when(m.rlike("^[0-9]"), "card").otherwise("name")
    )


def canonical(m: Column, k: Column) -> Column:
    """The form in which two spellings of an entity of kind k are equal."""
    gender = F.when(m.rlike(rf"^(?:{FEMALE})\.? "), "female").otherwise("male")
    return (
        F.when(k == "email", F.lower(m)).when(k == "ip", m).when(k == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .when(k == "name", F.concat(gender, F.lit(":"), F.lower(F.regexp_replace(m, TITLE, ""))))
        .when(k == "phone", F.concat(F.regexp_extract(m, r"^(\+[0-9]{1,3})(?=[ .(-])", 1), F.lit(":"), F.regexp_replace(F.regexp_replace(m, r"^\+[0-9]{1,3}(?=[ .(-])", ""), "[^0-9]", "")))
        .otherwise(F.regexp_replace(m, "[^0-9]", ""))
    )


def _byte(h: Column, i) -> Column:
    """Byte i (0 to 31, then again) of a hash in hex."""
    return F.conv(F.substr(h, (F.lit(i) if isinstance(i, int) else i) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _like(x: Column, h: Column, keep: int = 0) -> Column:
    """x with every digit and letter after the first `keep` characters replaced by one of its class."""

    def one(c, i):
        b = _byte(h, i) + F.floor(i / 32)
        put = lambda alphabet: F.substr(F.lit(alphabet), (b % len(alphabet) + 1).cast("int"), F.lit(1))
        new = F.when(c.rlike("[1-9]"), put("123456789")).when(c == "0", put("0123456789")).when(c.rlike("[a-z]"), put("abcdefghijklmnopqrstuvwxyz")).when(
            c.rlike("[A-Z]"), put("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        return F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), one), "")


def entities(found: Column) -> Column:
    """Mentions as structs (m, k, c)."""
    kinds = F.transform(found, lambda m: F.struct(m.alias("m"), kind(m).alias("k")))
    return F.transform(kinds, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), canonical(x["m"], x["k"]).alias("c")))


def _luhn(x: Column) -> Column:
    """Sum of the check over a string of digits, modulo 10; 0 is a right number."""
    n = F.length(x)

    def value(i):
        d = F.substr(x, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10


def draw(k: Column, c: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form in canonical form."""
    h = F.sha2(F.concat_ws("|", F.lit(key), k, attempt.cast("string"), c), 256)
    first = lambda r: _let(_draw, k=r["k"], c=r["c"], a=r["a"], h=r["h"], b=_like(r["c"], r["h"], keep=1))
    return _let(first, k=k, c=c, a=attempt, h=h)


def _draw(r: Column) -> Column:
    k, c, attempt, h, body = (r[n] for n in ("k", "c", "a", "h", "b"))
    longer = F.when(attempt > 6, F.substr(h, F.lit(1), F.least(attempt, F.lit(24)).cast("int"))).otherwise("")
    top = F.regexp_extract(c, r"\.[a-z]+$", 0)
    email = F.concat(_like(F.substr(c, F.lit(1), F.length(c) - F.length(top)), h), F.regexp_replace(longer, "[^a-f0-9]", ""), top)
    ip = F.concat_ws(".", _byte(h, 0) % 223 + 1, _byte(h, 1), _byte(h, 2), _byte(h, 3))
    # the last digit is moved so that the check sum is as before
    last = (F.substr(body, F.length(body), F.lit(1)).cast("int") + _luhn(c) - _luhn(body) + 20) % 10
    card = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), last)
    head = F.substring_index(c, ":", 1)
    phone = F.concat(head, F.lit(":"), _like(F.substring_index(c, ":", -1), h))
    script = F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def named(s, g):
        parts = F.array(*[F.lit(x) for x in SYLLABLES[s]])
        pick = lambda i: F.element_at(parts, (_byte(h, i) % 16 + 1).cast("int"))
        words = F.transform(F.split(F.substring_index(c, ":", -1), " "), lambda w, j: F.concat(
            *[F.element_at(parts, (_byte(h, j * 4 + i) % 16 + 1).cast("int")) for i in range(3)], F.lit(ENDINGS[s, g])))
        return F.concat(F.array_join(words, " "), F.when(attempt > 6, pick(20)).otherwise(""), F.when(attempt > 12, pick(21)).otherwise(""))

    name = F.lit(None).cast("string")
    for s in SYLLABLES:
        for g in ("male", "female"):
            name = F.when((script == s) & (head == g), F.concat(F.lit(g), F.lit(":"), named(s, g))).otherwise(name)
    return (
        F.when(k == "email", email).when(k == "ip", ip).when(k == "iban", _like(c, h, keep=2)).when(k == "card", card)
        .when(k == "phone", phone).when(k == "name", name).otherwise(_like(c, h))
    )


def _digits_into(m: Column, digits: Column) -> Column:
    """The digits of m replaced in order, everything between them kept."""
    between = F.split(m, "[0-9]", -1)
    return F.array_join(F.zip_with(between, F.filter(F.split(digits, ""), lambda c: c != ""), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def written_like(m: Column, k: Column, s: Column) -> Column:
    """A surrogate in canonical form, in the spelling of the mention it replaces."""
    upper = m == F.upper(m)
    prefix = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(m, F.length(prefix) + 1)
    title = F.regexp_extract(m, TITLE, 0)
    name = F.substring_index(s, ":", -1)
    iban = F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(
        F.substr(m, i, F.lit(1)) == " ", " ").otherwise(F.substr(s, i - F.length(m) + F.length(F.replace(m, F.lit(" "), F.lit(""))) + F.length(F.substr(m, i)) - F.length(F.replace(F.substr(m, i), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    return (
        F.when(k == "email", F.when(upper, F.upper(s)).otherwise(s)).when(k == "ip", s).when(k == "iban", iban)
        .when(k == "phone", F.concat(prefix, _digits_into(rest, F.substring_index(s, ":", -1))))
        .when(k == "name", F.concat(title, F.when(F.substr(m, F.length(title) + 1) == F.upper(F.substr(m, F.length(title) + 1)), F.upper(name)).otherwise(F.initcap(name))))
        .otherwise(_digits_into(m, s))
    )


def attempts(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """mentions (k, c) -> the distinct entities that need another attempt than 0, as (k, c, a)."""
    open_ = written(mentions.distinct(), "entities")
    real = open_.select("k", F.col("c").alias("s"))
    fixed = open_.withColumn("a", F.lit(0)).withColumn("s", draw(F.col("k"), F.col("c"), F.col("a"), key))
    while True:
        fixed = written(fixed, "drawn")
        clash = fixed.join(real, ["k", "s"], "left_semi").select("k", "c")
        twice = fixed.groupBy("k", "s").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("a"), "c")).getField("c").alias("first")).filter("n > 1")
        later = fixed.join(twice, ["k", "s"]).filter("c <> first").select("k", "c")
        again = written(clash.union(later).distinct(), "again")
        if again.isEmpty():
            return fixed.filter("a > 0").select("k", "c", "a")
        moved = fixed.join(again, ["k", "c"], "left_semi").select("k", "c", (F.col("a") + 1).alias("a"))
        moved = moved.withColumn("s", draw(F.col("k"), F.col("c"), F.col("a"), key)).select(*fixed.columns)
        fixed = fixed.join(again, ["k", "c"], "left_anti").union(moved)


def replace(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """`docs` with surrogates in `text`, and `n_entities` (mentions replaced, long; null text: 0).

    Null and empty texts stay as they are, and so does every character outside a mention. All other
    columns and repeated rows stay, but for an input column n_entities, which the new one replaces;
    equal rows are replaced alike. An address has at most 64 characters before its @, so long
    unbroken runs are read in time proportional to their length. `key` must be kept secret."""
    docs = docs.drop("n_entities")
    found = F.coalesce(F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1)), F.array().cast("array<string>"))
    holders = docs.select("doc_id", text_key(text).alias("__llm_key"), F.explode(entities(F.array_distinct(found))).alias("e"))
    holders = written(holders.select("doc_id", "__llm_key", "e.k", "e.c"), "mentions")
    other = written(attempts(holders.select("k", "c"), key), "attempts")
    rows = docs.withColumn("__llm_m", found)
    if other.isEmpty():  # no entity was drawn again
        rows = rows.withColumn("__llm_a", F.lit(None).cast("map<string,int>"))
    else:
        per = holders.join(other, ["k", "c"]).select("doc_id", "__llm_key", F.concat_ws("|", "k", "c").alias("e"), "a").distinct()
        per = per.groupBy("doc_id", "__llm_key").agg(F.map_from_entries(F.collect_list(F.struct("e", "a"))).alias("__llm_a"))  # of one document
        per = per.select(F.col("doc_id").alias("__llm_id"), F.col("__llm_key").alias("__llm_k"), "__llm_a")
        on = F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_k"))
        rows = rows.withColumn("__llm_key", text_key(text)).join(per, on, "left").drop("__llm_key", "__llm_id", "__llm_k")

    def surrogate(x):
        a = F.coalesce(F.try_element_at(F.col("__llm_a"), F.concat_ws("|", x["k"], x["c"])), F.lit(0))
        return F.struct(x["m"].alias("m"), x["k"].alias("k"), draw(x["k"], x["c"], a, key).alias("s"))

    new = F.transform(F.transform(entities(F.col("__llm_m")), surrogate), lambda x: written_like(x["m"], x["k"], x["s"]))
    between = F.split(F.col(text), ENTITY, -1)
    joined = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return rows.select(
        *[F.when(F.size("__llm_m") > 0, joined).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.size("__llm_m").cast("long").alias("n_entities"))


def clean(docs: DataFrame, key: str = KEY) -> DataFrame:
    """`docs` with surrogates and the length of the new text in n_chars; the same columns."""
    out = replace(docs, key)
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)
