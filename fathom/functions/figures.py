"""Accounting figures of a table row as Column expressions.

A figure is ``struct<value double, raw string>``; a row's figures are an array in column order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import let
from .text import FLAGS

# What is read as a figure, as a nil and as a unit.
NUMBER = r"\(?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|\(?-?\d+(?:\.\d+)?\)?|(?<![\w-])[-–—](?![\w-])"
NIL = ["-", "–", "—"]
MILLIONS = r"[£€E]\s*[’'`]?\s*m\b|£\s*million|in\s+millions"
THOUSANDS = r"[£€E]\s*[’'`7]?\s*0{3}(?![\d,])|in\s+thousands"
# The same without the letter e as a damaged pound sign, which also counts words such as "them".
MILLIONS_STRICT = r"[£€]\s*[’'`]?\s*m\b|£\s*million|in\s+millions"
NOTE_REFERENCE = r"[(\[]?\s*(?:see\s+)?notes?\s+\d{1,2}\s*[)\]]?"
LEADING_JUNK = r"(?U)^[\s\-–—•*·:;|>»_]+"
TOLERANCE = 1.0

Figures = Column


def parse_number(raw: Column) -> Column:
    """The value of a printed figure: a dash is 0, brackets or a leading minus negate; else NULL."""
    minus_signs = lambda x: F.replace(F.replace(F.replace(x, F.lit(","), F.lit("")), F.lit("−"), F.lit("-")), F.lit("–"), F.lit("-"))

    def value(x: Column) -> Column:
        negative = x["inner"].startswith("-") | (x["raw"].startswith("(") & x["raw"].endswith(")"))
        plain = F.when(x["body"].rlike(r"(?U)\A\d+(?:\.\d+)?\z"), x["body"].try_cast("double"))
        return F.when(x["raw"].isin(NIL), F.lit(0.0)).when(negative, -plain).otherwise(plain)

    def body(x: Column) -> Column:
        inner = F.when(x["inner"].startswith("-"), F.substr(x["inner"], F.lit(2))).otherwise(x["inner"])
        return let(F.struct(x["raw"].alias("raw"), x["inner"].alias("inner"), inner.alias("body")), value)

    return let(F.trim(raw), lambda x: let(F.struct(x.alias("raw"), minus_signs(F.regexp_replace(x, r"^[()]+|[()]+$", "")).alias("inner")), body))


def strip_note_references(line: Column) -> Column:
    return F.regexp_replace(line, FLAGS + NOTE_REFERENCE, " ")


def strip_leading_junk(line: Column) -> Column:
    return F.regexp_replace(line, LEADING_JUNK, "")


def has_figure(text: Column) -> Column:
    """Whether any figure stands in the text; whatever is matched has a value."""
    return text.rlike("(?U)" + NUMBER)


def right_of(line: Column, label_end: Column) -> Column:
    """The text after the first ``label_end`` characters, with one stand-in for the label's last.

    A dash must not touch a word or hyphen, and that test looks back into the label.
    """
    guard = F.when(label_end < 1, "").when(F.substr(line, label_end, F.lit(1)).rlike(r"(?U)[\w-]"), "x").otherwise(" ")
    return F.concat(guard, F.substr(line, label_end + 1))


def row_figures(line: Column, label_end: Column) -> Figures:
    """Figures to the right of the first ``label_end`` characters."""
    found = F.regexp_extract_all(right_of(line, label_end), F.lit("(?U)(" + NUMBER + ")"), F.lit(1))
    return F.transform(found, lambda r: F.struct(parse_number(r).alias("value"), r.alias("raw")))


def _substantial(f: Column) -> Column:
    raw = F.trim(f["raw"])
    return raw.isin(NIL) | raw.startswith("(") | f["raw"].contains(",") | f["raw"].contains(".") | (F.abs(f["value"]) >= 100)


def clean_figures(figures: Figures, multiplier: Column) -> Figures:
    """Without note-reference columns."""

    def choose(x: Column) -> Column:
        every, big, decimals, first = x["every"], x["big"], x["decimals"], F.get(x["every"], F.lit(0))
        note_first = (multiplier == 1_000_000) & (F.size(decimals) > 0) & ~first["raw"].contains(".") & (F.abs(first["value"]) < 100)
        return F.when((F.size(big) > 0) & (F.size(big) < F.size(every)), big).when(note_first, decimals).otherwise(every)

    parts = lambda f: F.struct(f.alias("every"), F.filter(f, _substantial).alias("big"), F.filter(f, lambda x: x["raw"].contains(".")).alias("decimals"))
    return let(figures, lambda f: let(parts(f), choose))


def total_column(figures: Figures) -> Column:
    """Index (from 0) of the first figure from the third on that the ones before it add up to."""

    def adds_up(f: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(f, F.lit(1), k), F.lit(0.0), lambda a, x: a + x["value"])
        total = F.get(f, k)["value"]
        return (F.abs(before - total) <= TOLERANCE) & (F.abs(total) > 0)

    def first(f: Column) -> Column:
        return F.get(F.when(F.size(f) > 2, F.filter(F.sequence(F.lit(2), F.size(f) - 1), lambda k: adds_up(f, k))), F.lit(0))

    return let(figures, first)


def current_figure(clean: Figures) -> Column:
    """The current year's figure of cleaned figures, NULL if there is none."""
    return let(clean, lambda f: F.get(f, F.coalesce(total_column(f), F.lit(0))))


def comparative(clean: Figures) -> Column:
    """The prior year's value of cleaned figures: NULL for fewer than two, or past the end."""
    return let(clean, lambda f: F.when(F.size(f) >= 2, F.get(f, F.coalesce(total_column(f) * 2 + 1, F.lit(1)))["value"]))


def is_year(raw: Column) -> Column:
    x = F.trim(raw)
    return x.rlike(r"\A\d{4}\z") & x.try_cast("int").between(1990, 2100)


def unit_markers(text: Column, strict: bool = False) -> Column:
    """struct<m int, k int>: how often the text names millions and thousands."""
    count = lambda p: F.coalesce(F.regexp_count(text, F.lit(FLAGS + p)), F.lit(0))
    return F.struct(count(MILLIONS_STRICT if strict else MILLIONS).alias("m"), count(THOUSANDS).alias("k"))


def unit(section: Column, document: Column) -> tuple[Column, Column]:
    """(multiplier, evidence) from the markers of a section and of its document.

    The section's markers win over the document's, the unit with more markers wins, millions on a
    tie; without any marker thousands are assumed.
    """
    known = lambda x: x["m"] + x["k"] > 0
    best = lambda x: F.when(x["m"] >= x["k"], 1_000_000).otherwise(1_000)
    multiplier = F.when(known(section), best(section)).when(known(document), best(document)).otherwise(1_000)
    name = F.when(multiplier == 1_000, "£'000").otherwise("£m")
    evidence = F.when(known(section), F.concat(F.lit("section: "), name)).when(known(document), F.concat(F.lit("document: "), name))
    return multiplier, F.coalesce(evidence, F.lit("default: £'000 (no unit marker found)"))
