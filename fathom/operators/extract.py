"""Line items from section text by rule tables.

Rows are matched by ordered rules: one narrow pass over each section, parsing by Column expressions,
and one small aggregation to the best row of each item.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import text as X
from ..functions.frames import cut, fixed, join_on
from .sections import FILING

# Label rules of each item, in order, with their tier.
_DISPOSAL = r"^\s*(?:\(loss\)\s*/\s*)?(?:net\s+)?(?:profit|gain|surplus|loss(?:es)?)(?:\s*/\s*\(?(?:loss|profit)\)?)?\s+on\s+(?:the\s+)?disposals?"
_NOT_PLAYERS = r"(?!\s+of\s+(?:the\s+)?(?:players?[’'`]?s?\b|intangible\s+(?:fixed\s+)?assets\b))"
REVENUE = [
    (1, r"^\s*(?:group\s+|total\s+)?turnover\b(?!\s+by\b)"),
    (1, r"^\s*(?:group\s+|total\s+)?revenue\b(?!\s+recognition)"),
    (2, r"^\s*turnover\s+and\s+(?:group\s+)?operating"),
]
WAGES = [
    (1, r"^\s*(?:total\s+)?staff\s+costs\b(?!\s*:)"),
    (1, r"^\s*(?:total\s+)?employee\s+(?:costs|benefit\s+expense)\b"),
    (2, r"^\s*wages\s+and\s+salaries\b"),
]
AMORTISATION = [
    (1, r"^\s*amortisation\s+(?:charge\s+)?(?:of|on)\s+(?:players?[’'`]?s?\s+registrations?|player\s+registrations?)"),
    (1, r"^\s*(?:players?[’'`]?s?\s+registrations?|player\s+registrations?)\s+amortisation"),
    (2, r"^\s*amortisation\s+of\s+intangible\s+(?:fixed\s+)?assets\b"),
    (2, r"^\s*amortisation\s+(?:charged?|expense)\b"),
]
DISPOSAL = [
    (1, _DISPOSAL + r"\s+of\s+(?:tangible\s+)?fixed\s+assets?(?:\s+investments?)?\b"),
    (1, _DISPOSAL + r"\s+of\s+(?:a\s+)?(?:subsidiar(?:y|ies)|business(?:es)?|investments?|propert(?:y|ies)|fellow\s+group\s+(?:compan(?:y|ies)|undertakings?))"),
    (2, _DISPOSAL + _NOT_PLAYERS),
]
PLAYERS_DISPOSAL = [
    (1, _DISPOSAL + r"\s+of\s+players?[’'`]?s?(?:\s+registrations?)?\b"),
    (1, _DISPOSAL + r"\s+of\s+intangible\s+(?:fixed\s+)?assets\b"),
    (2, r"^\s*profits?\s+(?:arising\s+)?on\s+player\s+(?:sales|trading)\b"),
]
BARE_LOSS = r"^\s*(?:net\s+)?loss(?:es)?\s+on\s"
WAGES_LABEL = r"^\s*wages\s+and\s+salaries\b"


@dataclass
class Item:
    """A line item: its rules, the sections to search, best first, and whether it is a cost."""

    name: str
    rules: list[tuple[int, str]]
    sections: tuple[str, ...] = ("profit_and_loss", "notes")
    cost: bool = False


ITEMS = [
    Item("revenue", REVENUE, ("profit_and_loss", "notes", "strategic_report")),
    Item("wages", WAGES, ("notes", "profit_and_loss"), cost=True),
    Item("player_amortisation", AMORTISATION, ("notes", "profit_and_loss"), cost=True),
    Item("profit_on_disposal", DISPOSAL),
]
CONTEXT = [Item("profit_on_disposal_players", PLAYERS_DISPOSAL)]
WINDOW, MOST_FIGURES = 40, 9


_note, _number, _mark = re.compile(G.NOTE_REFERENCE, re.I), re.compile(G.NUMBER), re.compile(r"[\d\-–—]")
_note_ahead = re.compile(r"notes?\s*\Z", re.I)


def _bare(text: str) -> bool:
    """No figure in the text, note references aside."""
    return _mark.search(text) is None or _number.search(_note.sub(" ", text)) is None


def joined_rows(text: str) -> list[str]:
    """The rows of one text, in one walk over its lines.

    A row without a figure can only get one from the line that joins it, or from a number that turns
    out to follow its last word "note"; so no row is read twice, however many lines it joins.
    """
    out: list[str] = []
    parts: list[str] = []
    bare = False
    for line in map(str.rstrip, text.splitlines()):
        own = line.lstrip()
        if bare and "a" <= own[:1] <= "z":
            ahead = _note_ahead.search(parts[-1])
            parts.append(own)
            bare = _bare(f"{ahead[0]} {own}" if ahead else own)
            continue
        if parts:
            out.append(parts[0] if len(parts) == 1 else " ".join([parts[0].strip(), *parts[1:]]))
        parts, bare = [line], _bare(line)
    if parts:
        out.append(parts[0] if len(parts) == 1 else " ".join([parts[0].strip(), *parts[1:]]))
    return out


def logical_rows(text: Column) -> Column:
    """Array of rows, labels that wrap over lines joined back; NULL stays NULL.

    A line that starts in lower case continues the row before it as long as that row has no figure.
    Whether it has one is judged on the row joined so far, a fold over the lines that would copy
    its rows at every step as a Column expression: it is one Arrow visit to each text instead.
    """

    @F.arrow_udf("array<string>")
    def rows(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else joined_rows(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    return rows(text)


# A unit marker has fewer characters than this, white-space runs counted as one.
SEAM = 24


def section_rows(sections: DataFrame, keys: list[str], strict_units: bool = False) -> DataFrame:
    """(keys, section, multiplier, evidence, rows) of each non-blank section.

    Units come from the section, else from all the filing's sections, joined in name order. Markers
    are counted in each section; of its text only the edges, which may complete a marker over the seam
    to the next section, go to the filing.
    """
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    plus = lambda a, b: F.struct((a["m"] + b["m"]).alias("m"), (a["k"] + b["k"]).alias("k"))
    text = F.coalesce("text", F.lit(""))
    flat = F.regexp_replace(text, r"(?U)\s+", " ")
    edges = F.when(F.length(flat) <= 2 * SEAM, flat).otherwise(F.concat(F.left(flat, F.lit(SEAM)), F.lit("\x00"), F.right(flat, F.lit(SEAM))))
    parts = sections.select(*keys, "section", once(F.struct(G.unit_markers(text, strict_units).alias("own"), edges.alias("edges")), "p"))
    parts = parts.select(*keys, "section", "p.own", "p.edges").withColumn("inner", G.unit_markers(F.col("edges"), strict_units))
    whole = parts.groupBy(*keys).agg(F.sum(F.col("own.m") - F.col("inner.m")).alias("m"), F.sum(F.col("own.k") - F.col("inner.k")).alias("k"), F.sort_array(F.collect_list(F.struct("section", "edges"))).alias("s"))
    whole = whole.withColumn("seams", G.unit_markers(F.array_join(F.transform("s", lambda x: x["edges"]), "\n"), strict_units))
    whole = whole.select(*keys, plus(F.struct("m", "k"), F.col("seams")).alias("_whole"))
    some = sections.filter(F.col("text").rlike(r"(?U)\S")).select(*keys, "section", "text", once(G.unit_markers(F.col("text"), strict_units), "_own"))
    multiplier, evidence = G.unit(F.col("_own"), F.col("_whole"))
    return join_on(some.withColumn("rows", logical_rows(F.col("text"))).drop("text"), whole, keys, "inner").select(*keys, "section", multiplier.alias("multiplier"), evidence.alias("evidence"), "rows")


def candidates(rowed: DataFrame, keys: list[str], items: list[Item]) -> DataFrame:
    """One row per matching table row and item, with value, comparative and rank key."""
    wanted = sorted({s for i in items for s in i.sections})
    df = rowed.filter(F.col("section").isin(wanted)).select(*keys, "section", "multiplier", "evidence", F.posexplode("rows").alias("row_no", "raw_row"))
    df = df.filter(F.col("raw_row").rlike(r"(?iuU)turnover|revenue|staff|employee|wages|amortisation|dispos|profit" if items is ITEMS or items is CONTEXT else "."))
    df = df.withColumn("row", G.strip_note_references(G.strip_leading_junk(F.col("raw_row"))))
    found = []
    for item in items:
        hit = None
        for tier, pattern in item.rules:
            end = F.length(F.regexp_extract(F.col("row"), X.FLAGS + pattern, 0))
            ok = F.col("row").rlike(X.FLAGS + pattern) & G.has_figure(G.right_of(F.col("row"), end))
            value = F.struct(F.lit(tier).alias("tier"), end.alias("end"))
            hit = F.when(ok, value) if hit is None else hit.when(ok, value)
        place = F.array_position(F.array(*map(F.lit, item.sections)), F.col("section")).cast("int")
        found.append(F.when(F.col("section").isin(list(item.sections)), F.struct(F.lit(item.name).alias("item"), F.lit(item.cost).alias("cost"), place.alias("place"), hit.alias("hit"))))
    df = df.select("*", F.explode(F.array(*found)).alias("f")).filter("f.hit is not null")
    # the few rows that are left are parsed once; each explode of one value keeps Catalyst from
    # folding the parsing into the expressions that use it
    figs = G.row_figures(F.col("row"), F.col("f.hit.end"))
    df = df.select("*", F.explode(F.array(G.clean_figures(figs, F.col("multiplier")))).alias("figs"))
    df = df.select("*", F.explode(F.array(F.struct(G.current_figure(F.col("figs")).alias("now"), G.comparative(F.col("figs")).alias("then"), G.total_column(F.col("figs")).isNotNull().alias("total")))).alias("v"))
    df = df.filter("v.now is not null").select(*keys, "section", "multiplier", "evidence", "row_no", "row", "f.item", "f.cost", "f.place", "f.hit.tier", "figs", "v.now", "v.then", "v.total")
    n = F.size("figs")
    return df.select(
        *keys, "item", "cost", "section", "tier", "evidence", "multiplier",
        (F.col("now.value") * F.col("multiplier")).alias("value"), F.col("now.raw").alias("raw"),
        (F.col("then") * F.col("multiplier")).alias("comparative"), n.alias("n_figures"), "total",
        F.substring(F.regexp_replace(X.strip(F.col("row")), r"(?U)\s+", " "), 1, 220).alias("snippet"),
        F.struct("tier", F.when(F.col("tier") == 1, F.col("place")).otherwise(0).alias("a"), (-F.least(n, F.lit(3))).alias("b"), "place", "row_no").alias("rank"),
    )


def find_items(sections: DataFrame, keys: list[str] = FILING, items: list[Item] = ITEMS, strict_units: bool = False) -> DataFrame:
    """(keys, item, value_gbp, comparative_gbp, source_section, source_snippet, confidence, note).

    One row per filing and item. The best row has the lowest tier, then (up to three) most figures, then
    comes first; a tier-1 row ends the search after its section. Nothing found: NULL values and
    confidence none. NULL means not disclosed, 0 a disclosed nil.
    """
    rowed = cut(section_rows(sections, keys, strict_units))
    return best_items(sections.select(*keys).distinct(), candidates(rowed, keys, items), keys, items)


def best_items(filings: DataFrame, found: DataFrame, keys: list[str], items: list[Item]) -> DataFrame:
    fields = [c for c in found.columns if c not in (*keys, "item", "rank")]
    best = found.groupBy(*keys, "item").agg(F.min_by(F.struct(*fields), "rank").alias("b"))
    every = filings.select(*keys, F.explode(F.array(*[F.lit(i.name) for i in items])).alias("item"))
    out = join_on(every, best, [*keys, "item"]).select(*keys, "item", "b.*")
    # fixed values: the wording of notes and confidences
    value = F.when(F.col("cost"), F.abs("value")).when(F.col("snippet").rlike(X.FLAGS + BARE_LOSS) & (F.col("value") > 0), -F.col("value")).otherwise(F.col("value"))
    level = F.when(F.col("tier") == 1, "high").otherwise("medium")
    level = F.when(F.col("evidence").startswith("default"), "low").when(F.col("evidence").startswith("document") & (level == "high"), "medium").otherwise(level)
    level = F.when(F.col("n_figures") < 2, F.when(level == "high", "medium").otherwise("low")).otherwise(level)
    level = F.when((F.col("n_figures") > 2) & (level == "high"), "medium").otherwise(level)
    column = F.when(F.col("n_figures") > 2, F.concat(F.lit("; row has "), F.col("n_figures"), F.lit(" figures, took the "), F.when(F.col("total"), "computed total column").otherwise("first column"))).otherwise("")
    note = F.concat(F.col("evidence"), F.lit("; matched tier "), F.col("tier"), F.lit("; took figure '"), F.col("raw"), F.lit("' of "), F.col("n_figures"), F.lit(" on row"), column)
    none = F.col("tier").isNull()
    return out.select(
        *keys, "item",
        F.rint(value).cast("long").alias("value_gbp"), F.rint("comparative").cast("long").alias("comparative_gbp"),
        F.col("section").alias("source_section"), F.col("snippet").alias("source_snippet"),
        F.when(none, "none").otherwise(level).alias("confidence"), F.when(none, "no matching row found").otherwise(note).alias("note"),
    )


def derived_totals(rowed: DataFrame, keys: list[str] = FILING, item: str = "wages") -> DataFrame:
    """(keys, item, value_gbp, source_section, source_snippet, note): totals summed from components.

    From a "wages and salaries" row on, the current figures of the next 40 rows are read; the first
    run of two or more that adds up to the figure after it gives the total. Notes come before the
    profit and loss account.
    """
    df = rowed.filter(F.col("section").isin("notes", "profit_and_loss"))

    def pick(row: Column) -> Column:
        now = G.current_figure(G.clean_figures(G.row_figures(G.strip_note_references(row), F.lit(0)), F.col("multiplier")))
        return F.when(now.isNotNull() & ~G.is_year(now["raw"]), now["value"])

    df = df.filter(F.exists("rows", lambda r: r.rlike(r"(?iuU)wages\s+and\s+salaries")))
    label = lambda r: G.strip_note_references(G.strip_leading_junk(r)).rlike(X.FLAGS + WAGES_LABEL)
    df = df.withColumn("picks", F.transform("rows", pick))
    df = df.withColumn("start", F.explode(F.filter(F.transform("rows", lambda r, i: F.when(label(r), i)), lambda i: i.isNotNull())))
    df = df.withColumn("f", F.slice(F.filter(F.slice("picks", F.col("start") + 1, F.lit(WINDOW)), lambda v: v.isNotNull()), 1, MOST_FIGURES))
    df = df.filter(F.size("f") >= 3)
    first = F.sequence(F.lit(0), F.greatest(F.size("f") - 3, F.lit(0)))

    def runs(i: Column) -> Column:
        return F.transform(F.sequence(i + 2, F.size("f") - 1), lambda k: F.struct(i.alias("first"), k.alias("k")))

    def adds_up(r: Column) -> Column:
        total, head = F.get("f", r["k"]), F.get("f", r["first"])
        before = F.aggregate(F.slice("f", r["first"] + 1, r["k"] - r["first"]), F.lit(0.0), lambda a, v: a + v)
        return (total != 0) & (F.abs(before - total) <= G.TOLERANCE) & (head != 0)

    df = df.withColumn("run", F.get(F.filter(F.flatten(F.transform(first, runs)), adds_up), F.lit(0))).filter("run is not null")
    order = F.struct((F.col("section") != "notes").alias("a"), "start")
    df = df.groupBy(*keys).agg(F.min_by(F.struct("section", "multiplier", "evidence", "f", "run"), order).alias("b"))
    total = F.get("b.f", F.col("b.run.k"))
    # fixed values: the wording of the snippet and the note
    parts = F.array_join(F.transform(F.slice("b.f", F.col("b.run.first") + 1, F.col("b.run.k") - F.col("b.run.first")), lambda v: F.format_number(v, 0)), " + ")
    return df.select(
        *keys, F.lit(item).alias("item"), F.rint(total * F.col("b.multiplier")).cast("long").alias("value_gbp"),
        F.col("b.section").alias("source_section"),
        F.concat(F.lit("derived total staff costs: "), parts, F.lit(" = "), F.format_number(total, 0)).alias("source_snippet"),
        F.concat(F.col("b.evidence"), F.lit("; summed from the components in the employees note (no labelled total is printed)")).alias("note"),
    )


def line_items(sections: DataFrame, keys: list[str] = FILING, strict_units: bool = False) -> DataFrame:
    """``find_items``, with a derived wages total where wages are blank or only a wages-and-salaries
    row was found."""
    rowed = cut(section_rows(sections, keys, strict_units))
    items = best_items(sections.select(*keys).distinct(), candidates(rowed, keys, ITEMS), keys, ITEMS)
    total = derived_totals(rowed, keys).select(*keys, "item", F.struct("value_gbp", F.lit(None).cast("long").alias("comparative_gbp"), "source_section", "source_snippet", F.lit("medium").alias("confidence"), "note").alias("d"))
    out = join_on(items, total, [*keys, "item"])
    narrow = F.col("value_gbp").isNull() | F.col("source_snippet").rlike(X.FLAGS + WAGES_LABEL)
    use = F.col("d").isNotNull() & narrow
    fields = ("value_gbp", "comparative_gbp", "source_section", "source_snippet", "confidence", "note")
    return out.select(*keys, "item", *[F.when(use, F.col(f"d.{c}")).otherwise(F.col(c)).alias(c) for c in fields])


# Checks -----------------------------------------------------------------------------------------

GAP = 0.01
SERIES_ITEMS = ["revenue", "wages", "player_amortisation"]
SERIES_LOW, SERIES_HIGH = 0.25, 4.0


def cross_check(items: DataFrame, entity: list[str] = ["club"]) -> DataFrame:  # noqa: B006
    """Adds ``cross_check`` and ``restated_next_year`` from the filing of exactly the next year.

    Values are never overwritten; a mismatch lowers the confidence. A blank value, a missing next
    year or its blank comparative give NULL. (entity, year, item) is taken as a key of ``items``.
    """
    items = items.drop("cross_check", "restated_next_year")
    later = items.select(*entity, "item", (F.col("year").cast("int") - 1).cast("string").alias("year"), F.col("comparative_gbp").cast("double").alias("_b"))
    keys = [*entity, "year", "item"]
    df = join_on(items, later, keys)
    a, b = F.col("value_gbp").cast("double"), F.col("_b")
    checked = a.isNotNull() & b.isNotNull()
    agrees = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= GAP
    bad = checked & ~agrees
    # fixed values: the wording of the verdict
    said = F.when(bad, F.concat(F.lit("MISMATCH: "), (F.col("year").cast("int") + 1).cast("string"), F.lit(" filing restates this as "), F.format_number(b, 0))).when(checked, F.concat(F.lit("agrees with "), F.col("year"), F.lit("+1 comparative")))
    return df.withColumn("cross_check", said).withColumn("restated_next_year", F.when(bad, F.rint(b).cast("long"))).withColumn("confidence", F.when(bad, "low").otherwise(F.col("confidence"))).drop("_b")


def series_check(items: DataFrame, entity: list[str] = ["club"]) -> DataFrame:  # noqa: B006
    """Flags values under a quarter or over four times the entity's own median of the item.

    After ``cross_check``: its text is appended to. The exact median is a small aggregation that joins
    back. Fewer than two values or a zero median: no flag.
    """
    keys = [*entity, "item"]
    middle = items.filter(F.col("item").isin(SERIES_ITEMS) & F.col("value_gbp").isNotNull()).groupBy(*keys).agg(F.expr("median(abs(cast(value_gbp as double)))").alias("_mid"), F.count("*").alias("_n"))
    middle = middle.filter("_n >= 2 and _mid <> 0")
    df = join_on(items, middle, keys)
    ratio = F.abs(F.col("value_gbp").cast("double")) / F.col("_mid")
    out = F.coalesce((ratio < SERIES_LOW) | (ratio > SERIES_HIGH), F.lit(False))
    # fixed values: the wording of the verdict
    said = F.concat(F.lit("OUTLIER: "), fixed(ratio, 2), F.lit("x this club's median "), F.col("item"), F.lit(" ("), F.format_number("_mid", 0), F.lit(")"))
    text = F.when(out, F.concat_ws("; ", F.nullif(F.col("cross_check"), F.lit("")), said)).otherwise(F.col("cross_check"))
    return df.withColumn("cross_check", text).withColumn("confidence", F.when(out, "low").otherwise(F.col("confidence"))).drop("_mid", "_n")
