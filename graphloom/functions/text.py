"""Text as column expressions: tokens, token costs, ids, display strings. All of it stays in the JVM."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def tokenize(text: Column) -> Column:
    """Split camelCase, acronym boundaries and anything but ASCII letters and digits; lower-cased, longer than one character."""
    split = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.transform(F.regexp_extract_all(split, F.lit("[a-zA-Z0-9]{2,}"), F.lit(0)), F.lower)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def token_cost(text: Column) -> Column:
    return F.ceil(utf16_length(text) / CHARS_PER_TOKEN).cast("int")


def node_text(label: str = "label", description: str = "description", kind: str = "type") -> Column:
    return F.concat(F.col(label), F.lit(" "), F.coalesce(F.col(description), F.lit("")), F.lit(" "), F.col(kind))


#: Thousandths that end in 5 and whose binary value lies at or above the tie.
_TIES_UP = [k for k in range(5, 1000, 10) if Fraction(k / 1000) >= Fraction(k, 1000)]


def two_decimals(x: Column) -> Column:
    """A value from 0 to 1 with at most three decimals, written with two: the nearest to its binary value, ties up."""
    k = F.round(x * 1000).cast("int")
    up = (k % 10 > 5) | k.isin(_TIES_UP)
    n = F.floor(k / 10).cast("int") + up.cast("int")
    return F.format_string("%d.%02d", F.floor(n / 100).cast("int"), n % 100)


def node_display(with_description: bool) -> Column:
    """The lines of one node; its score is shown only with a location."""
    location, description = F.col("source_location"), F.col("description")
    located, described = F.coalesce(location, F.lit("")) != "", F.coalesce(description, F.lit("")) != ""
    parts = [F.lit("### "), F.col("label"), F.lit(" ("), F.col("type"), F.lit(")"), F.when(located, F.concat(F.lit(" · score: "), two_decimals(F.coalesce("centrality", F.lit(0.0))))).otherwise("")]
    if with_description:
        parts.append(F.when(described, F.concat(F.lit("\n"), description)).otherwise(""))
    parts += [F.lit("\n→ File: "), F.col("source_file"), F.when(located, F.concat(F.lit(" "), location)).otherwise("")]
    return F.concat(*parts)


def node_cost() -> Column:
    return token_cost(F.concat(node_display(True), F.lit("\n\n")))


def node_id(path: Column, name: Column) -> Column:
    """Path separators become underscores, the last extension goes, and other characters of the name become underscores."""
    clean = F.regexp_replace(F.regexp_replace(path, r"[\\/]", "_"), r"\.[^.]+$", "")
    return F.concat_ws("_", clean, F.regexp_replace(name, r"[^a-zA-Z0-9_$]", "_"))


def extension(name: Column) -> Column:
    """From the last dot of the last path segment; empty without a dot."""
    return F.regexp_extract(name, r"(\.[^./\\]*)$", 1)


def round3(x: Column) -> Column:
    """Three decimals, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def one_line(text: Column, limit: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, limit)


def plural_title(kind: Column) -> Column:
    return F.concat(F.upper(F.substring(kind, 1, 1)), F.expr("substring(type, 2)"), F.lit("s"))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
