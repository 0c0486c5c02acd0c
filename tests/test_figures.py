import pytest
from pyspark.sql import functions as F

from fathom.functions import figures as G


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, value",
    [("468,712", 468712.0), ("(441,208)", -441208.0), ("-1,234", -1234.0), ("82,500", 82500.0), ("12.4", 12.4), ("(12.4)", -12.4), ("-", 0.0), ("—", 0.0), ("", None), ("(5", 5.0), ("1a", None), (None, None)],
)
def test_printed_numbers(spark, raw, value):
    assert one(spark, raw, G.parse_number) == value


ROWS = [
    ("Turnover 2 468,712 442,364", "Turnover", 1000, 468712.0, 442364.0),
    ("Turnover 468,712 442,364 (restated)", "Turnover", 1000, 468712.0, 442364.0),
    ("Turnover 3 468.7 442.4", "Turnover", 1_000_000, 468.7, 442.4),
    ("Group turnover 3 615,206 1,374 616,580 465,228 1,457 466,685", "Group turnover", 1000, 616580.0, 466685.0),
    ("Operating expenses 4 (493,875) (171,099) (664,974) (364,778) (157,151) (521,929)", "Operating expenses", 1000, -664974.0, -521929.0),
    ("Profit - 51,073 51,073 - 10,732 10,732", "Profit", 1000, 51073.0, 10732.0),
    ("Wages _ 286,960 204,648", "Wages", 1000, 286960.0, 204648.0),
    ("Turnover 186,902 - 186,902 172,155 172,155", "Turnover", 1000, 186902.0, None),
    ("Investments 16 - - - 198,749", "Investments", 1000, 0.0, 0.0),
    ("Equipment (25) -", "Equipment", 1000, -25.0, 0.0),
]


@pytest.mark.parametrize("line, label, unit, now, then", ROWS)
def test_columns_of_a_row(spark, line, label, unit, now, then):
    clean = lambda c: G.clean_figures(G.row_figures(c, F.lit(len(label))), F.lit(unit))
    got = one(spark, line, lambda c: F.struct(G.current_figure(clean(c))["value"].alias("a"), G.comparative(clean(c)).alias("b")))
    assert (got["a"], got["b"]) == (now, then)


def test_a_dash_inside_a_word_is_no_figure(spark):
    assert one(spark, "long-term loans 5", lambda c: F.size(G.row_figures(c, F.lit(4)))) == 1
    assert one(spark, "no figures", lambda c: F.size(G.row_figures(c, F.lit(0)))) == 0


@pytest.mark.parametrize("text, multiplier", [("£'000 £'000", 1000), ("All amounts in £m", 1_000_000), ("Note £7000 £7000", 1000), ("E'000", 1000), ("in thousands; in millions", 1_000_000)])
def test_units_of_a_section(spark, text, multiplier):
    got = one(spark, text, lambda c: F.struct(*[x.alias(n) for x, n in zip(G.unit(G.unit_markers(c), G.unit_markers(F.lit(""))), "me")]))
    assert got["m"] == multiplier and got["e"].startswith("section")


def test_amounts_are_no_units_and_strict_units_skip_words(spark):
    bare = lambda c: G.unit(G.unit_markers(c), G.unit_markers(F.lit("")))[1]
    assert one(spark, "a grant of £7,000", bare).startswith("default")
    assert one(spark, "the system helped them", lambda c: G.unit_markers(c)["m"]) == 2
    assert one(spark, "the system helped them", lambda c: G.unit_markers(c, strict=True)["m"]) == 0
    assert one(spark, "", lambda c: G.unit(G.unit_markers(c), G.unit_markers(F.lit("£'000")))[1]) == "document: £'000"


def test_note_references_and_junk(spark):
    assert one(spark, "Amortisation (note 11) 5", G.strip_note_references) == "Amortisation   5"
    assert one(spark, "-• Wages", G.strip_leading_junk) == "Wages"
    assert [one(spark, y, G.is_year) for y in ("2025", "1899", "20255")] == [True, False, False]
