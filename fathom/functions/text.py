"""String functions on columns: tokens, cleaning, hashing, highlighting. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the page parser sees it, non-breaking and zero-width-joined kinds included.
SPACE = r"[\s\u00A0\uFEFF\u2000-\u200A\u3000]+"


#: Private-use characters that stand for tags until the text is escaped.
_OPEN, _SHUT = "\ue000", "\ue001"


def tokenize(text: Column) -> Column:
    """Distinct lower-case ASCII letter and digit runs of two characters or more, in order of first sight."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: F.length(x) >= 2))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def collapse_whitespace(text: Column) -> Column:
    return trim(F.regexp_replace(text, SPACE, " "))


def cap_words(text: Column, most: int) -> Column:
    """The first `most` words joined by one space; the trimmed text itself if it has no more. Null for none."""
    words = F.filter(F.split(trim(text), SPACE), lambda w: w != "")
    return F.when(F.length(text) > 0, F.when(F.size(words) <= most, trim(text)).otherwise(F.array_join(F.slice(words, 1, most), " ")))


def first_non_empty(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(trim(t), F.lit("")) for t in texts])


def distinct_ignoring_case(items: Column) -> Column:
    """Trimmed non-empty items, the first casing of each."""
    clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), trim), lambda x: x != "")
    start = F.array().cast("array<string>")
    return F.aggregate(clean, start, lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.concat(out, F.array(x))))


def content_hash(text: Column) -> Column:
    """FNV-1a, 64 bits, over UTF-16 code units, as 16 hex digits; null for null.

    The state is two 32-bit limbs in longs: with prime 2**40 + 435 no step exceeds 2**42.
    """
    units = F.hex(F.encode(text, "UTF-16BE"))
    start = F.struct(F.lit(3421674724).cast("long").alias("hi"), F.lit(2216829733).cast("long").alias("lo"))

    def step(s, i):
        unit = F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
        m = s["lo"].bitwiseXOR(unit)
        low = m * 435
        high = (s["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(m, 8)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.struct(high.alias("hi"), low.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))

    def shown(s):
        return F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0")))

    indexes = F.filter(F.sequence(F.lit(0), F.greatest(F.length(units).cast("int") / 4 - 1, F.lit(0)).cast("int")), lambda i: i * 4 < F.length(units))
    return F.when(text.isNotNull(), F.aggregate(indexes, start, step, shown))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def mark_matches(text: Column, tokens: Column) -> Column:
    """Escaped text with every word that starts with a token in <match> tags."""
    any_of = F.array_join(tokens, "|")
    marked = F.regexp_replace(text, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])((?:"), any_of, F.lit(")[a-z0-9]*)")), F.lit(f"{_OPEN}$1{_SHUT}"))
    plain = F.when(F.size(tokens) > 0, marked).otherwise(text)
    return F.replace(F.replace(escape_xml(plain), F.lit(_OPEN), F.lit("<match>")), F.lit(_SHUT), F.lit("</match>"))


def segments(text: Column, tokens: Column) -> Column:
    """text as an array of structs (text, hit): words that start with a token, and what stands between them."""
    any_of = F.array_join(tokens, "|")
    marked = F.regexp_replace(text, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])((?:"), any_of, F.lit(")[a-z0-9]*)")), F.lit(f"{_OPEN}$1{_SHUT}"))
    parts = F.split(F.when(F.size(tokens) > 0, marked).otherwise(text), f"(?={_OPEN})|{_SHUT}")
    cut = F.transform(parts, lambda p: F.struct(F.replace(p, F.lit(_OPEN), F.lit("")).alias("text"), F.startswith(p, F.lit(_OPEN)).alias("hit")))
    return F.filter(cut, lambda p: p["text"] != "")


def month_year(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "MMM yyyy")
