import re

import pytest
from pyspark.sql import functions as F

from fathom.operators import extract as E
from fathom.operators import sections as S

KEYS = ["club", "company_number", "year"]
ITEM = "club string, company_number string, year string, item string, value_gbp long, comparative_gbp long, confidence string, cross_check string, restated_next_year long"


def sections(spark, **texts):
    return spark.createDataFrame([("c", "n", "2024", k, v) for k, v in texts.items()], "club string, company_number string, year string, section string, text string")


def found(spark, item="profit_on_disposal", items=None, **texts):
    rows = E.find_items(sections(spark, **texts), KEYS, items or E.ITEMS).collect()
    return next(r for r in rows if r["item"] == item)


def test_items_of_the_filing(spark, filing):
    texts = S.section_texts(S.carried_lines(S.with_lines(filing, KEYS), KEYS), KEYS)
    got = {r["item"]: r for r in E.line_items(texts, KEYS).collect()}
    assert {k: r["value_gbp"] for k, r in got.items()} == {"revenue": 468_712_000, "wages": 245_419_000, "player_amortisation": 118_940_000, "profit_on_disposal": 82_500_000}
    assert got["revenue"]["confidence"] == "high" and got["wages"]["source_section"] == "notes" and got["revenue"]["comparative_gbp"] == 442_364_000
    assert E.find_items(texts, KEYS, E.CONTEXT).first()["value_gbp"] == 76_441_000


# Rows and what must be read from them.
@pytest.mark.parametrize(
    "row, value",
    [
        ("Profit on disposal of player registrations 51,073 10,732", None),
        ("(Loss)/profit on disposal of fixed assets (2,985) - (2,985) | 54", -2_985_000),
        ("Profit on disposal of fixed asset investments 16 - - - 198,749", 0),
        ("Profit on disposal of intangible fixed assets 6 - 52,565 52,565", None),
        ("Loss on disposal of tangible fixed assets - -", 0),
        ("Loss on disposal of fixed assets 2,985 1,000", -2_985_000),
        ("Profit on disposal of property, plant and equipment (25) -", -25_000),
        ("Profit on disposal of\nplayer registrations 10,732 5", None),
        ("Nothing relevant here", None),
        # rows of our own
        ("Profit on disposals of player registrations 7,001 6,002", 7_001_000),
        ("Gain on the disposal of subsidiaries (note 4) 1,250 -", 1_250_000),
        ("  » Surplus on disposal of businesses 12.5 3.25", 12_500),
        ("Losses on disposal of investments 3,100 2,900", -3_100_000),
        ("Profit on disposal of é–x 1,000 900", 1_000_000),
    ],
)
def test_disposal_rows(spark, row, value):
    got = found(spark, profit_and_loss=row)
    assert got["value_gbp"] == value and (value is not None or got["confidence"] == "none")


def test_search_order_and_ties(spark):
    got = found(spark, "wages", notes="Wages and salaries 5,000 4,000", profit_and_loss="Staff costs 7,000 6,000")
    assert (got["value_gbp"], got["source_section"]) == (7_000_000, "profit_and_loss")
    got = found(spark, "revenue", profit_and_loss="Turnover 5,000\nRevenue 6,000 5,500\nRevenue 8,000 7,000", notes="Revenue 1,000 2,000 3,000")
    assert (got["value_gbp"], got["source_section"]) == (6_000_000, "profit_and_loss")


# Notes and the total that must be derived from them.
@pytest.mark.parametrize(
    "notes, value",
    [
        ("Wages and salaries 352,355 297,569\nSocial security costs 49,831 40,974\nPension costs 1,776 1,706\n403,962 340,249", 403_962_000),
        ("-Wages and salaries\nSocial security costs\nPension costs\n2025\n312,812\n44,041\n2,412\n359,265", 359_265_000),
        ("Wages and salaries 100\nSocial security 20\n999", None),
    ],
)
def test_totals_from_components(spark, notes, value):
    rows = E.derived_totals(E.section_rows(sections(spark, notes="£'000\n" + notes), KEYS), KEYS).collect()
    assert [r["value_gbp"] for r in rows] == ([value] if value else [])


def fold(text):
    number = re.compile(r"\(?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|\(?-?\d+(?:\.\d+)?\)?|(?<![\w-])[-–—](?![\w-])")
    note = re.compile(r"[(\[]?\s*(?:see\s+)?notes?\s+\d{1,2}\s*[)\]]?", re.I)
    rows = []
    for line in [x.rstrip() for x in text.splitlines()]:
        if rows and re.match(r"\s*[a-z]", line) and not number.search(note.sub(" ", rows[-1])):
            rows[-1] = f"{rows[-1].strip()} {line.strip()}"
        else:
            rows.append(line)
    return rows


def test_wrapped_labels_against_a_plain_loop(spark):
    texts = ["a\nb 5\nc", "Label (note\n11) of\nthings 5 4\nnext", "", "\n\nx", "Profit on\ndisposal of\nassets -\nmore", "A -\n b", "Å\nå 5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", E.logical_rows(F.col("t")).alias("rows"))
    assert [r["rows"] for r in df.orderBy("i").collect()] == [fold(t) for t in texts]


def check(spark, rows):
    return spark.createDataFrame([("c", None, *r, "medium", None, None) for r in rows], ITEM)


def test_next_year_confirms_or_contradicts(spark):
    rows = [("2023", "revenue", 49_633_000, 443_415_000), ("2024", "revenue", 517_763_000, 549_633_000), ("2026", "revenue", 5, 517_763_000), ("2023", "wages", None, 1), ("2024", "wages", 7, None)]
    got = {(r["item"], r["year"]): r for r in E.cross_check(check(spark, rows), ["club", "company_number"]).collect()}
    assert got["revenue", "2023"]["cross_check"] == "MISMATCH: 2024 filing restates this as 549,633,000"
    assert (got["revenue", "2023"]["restated_next_year"], got["revenue", "2023"]["confidence"]) == (549_633_000, "low")
    assert got["revenue", "2024"]["cross_check"] is None and got["wages", "2023"]["cross_check"] is None
    agree = E.cross_check(check(spark, [("2023", "wages", 352_355_000, 1), ("2024", "wages", 2, 352_355_000)]), ["club"]).filter("year = '2023'").first()
    assert agree["cross_check"] == "agrees with 2023+1 comparative"


def test_series_outliers(spark):
    rows = [("2023", "revenue", 7_215_000, None), ("2024", "revenue", 186_902_000, None), ("2025", "revenue", 196_697_000, None)]
    rows += [(y, "profit_on_disposal", v, None) for y, v in (("2023", 76_524_000), ("2024", 198_749_000), ("2025", 0))]
    got = {(r["item"], r["year"]): r for r in E.series_check(check(spark, rows), ["club", "company_number"]).collect()}
    assert got["revenue", "2023"]["cross_check"] == "OUTLIER: 0.04x this club's median revenue (186,902,000)" and got["revenue", "2023"]["confidence"] == "low"
    assert [k for k, r in got.items() if r["cross_check"]] == [("revenue", "2023")]
    both = E.series_check(check(spark, rows).withColumn("cross_check", F.lit("agrees with x")), ["club"]).filter("item = 'revenue' and year = '2023'").first()
    assert both["cross_check"].startswith("agrees with x; OUTLIER")
