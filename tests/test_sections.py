import pytest
from pyspark.sql import functions as F

from fathom.functions import text as X
from fathom.operators import sections as S

KEYS = ["club", "company_number", "year"]


@pytest.mark.parametrize(
    "line, section",
    [
        ("STRATEGIC REPORT", "strategic_report"), ("Strategic report (continued)", "strategic_report"), ("The Strategic Report and the Directors' Report", "strategic_report"),
        ("Directors' Report for the year ended 30 June 2024", "directors_report"), ("Independent auditor’s report to the members", "auditors_report"),
        ("GROUP PROFIT AND LOSS ACCOUNT ;", "profit_and_loss"), ("Consolidated income statement and statement of other comprehensive income", "profit_and_loss"),
        ("Notes to the Financial Statements 16", "notes"), ("Balance sheet as at 30 June", "balance_sheet"), ("Cash flow statement", "cash_flow"), ("Contents", "contents"),
        ("Strategic Report ........ 2", None), ("The strategic report describes our plans", None), ("", None), ("x" * 91, None), (None, None),
    ],
)
def test_headings(spark, line, section):
    assert spark.createDataFrame([(line,)], "t string").select(X.classify_heading(F.col("t"))).first()[0] == section


def test_lines_are_those_of_the_text(spark):
    for text in ("a\nb\n", "a\r\nb", "", "\n", "a\x0bb\x85c d", "a\n\nb"):
        assert spark.createDataFrame([(text,)], "t string").select(X.lines(F.col("t"))).first()[0] == text.splitlines()


def test_quality_tokens_and_labels(spark):
    df = spark.createDataFrame([("The cost of the £1,234 squad's long-term 5% deal",)], "t string")
    assert df.select(X.tokens(F.col("t"))).first()[0] == ["the", "cost", "of", "the", "squad's", "long-term", "deal"]
    assert df.select(X.n_common(F.col("t"))).first()[0] == 3
    row = spark.createDataFrame([("2024-06-30", "2025-01-01", "http://x/document/AbC/"), (None, "2025-01-01", None), ("", None, "")], "m string, f string, u string")
    got = row.select(X.year_label(F.col("m"), F.col("f")), X.date_key(F.col("m")), X.last_path_part(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("2024", 20240630, "AbC"), ("2025", 0, None), ("", 0, None)]
    banner = spark.createDataFrame([("a\n docusign envelope id: 12\nb",)], "t string")
    assert banner.select(X.strip_banner(F.col("t"))).first()[0] == "a\n\nb"


def test_a_filing_falls_into_its_sections(spark, filing):
    carried = S.carried_lines(S.with_lines(filing, KEYS), KEYS)
    texts = {r["section"]: r["text"] for r in S.section_texts(carried, KEYS).collect()}
    assert set(texts) == {"front_matter", "strategic_report", "directors_report", "profit_and_loss", "notes"}
    assert "Turnover" not in texts["strategic_report"] and texts["notes"].startswith("5 Staff costs")
    parsed = S.parse_filings(filing, KEYS).first()
    assert parsed["contents_pages_skipped"] == [2] and parsed["heading_hits"][0]["page"] == 3
    assert parsed["flags"] == ["empty_text_layer", "short_strategic_report"] and not parsed["combined_strategic_and_directors_report"]
    assert parsed["sections_detected"] == ["strategic_report", "directors_report", "profit_and_loss", "notes"]


def test_sections_resume_after_gaps_and_repeat_no_event(spark):
    pages = [("c", None, "1", 1, "Strategic report\na"), ("c", None, "1", 2, "STRATEGIC REPORT (continued)\nb\nNotes to the accounts\nn"), ("c", None, "1", 3, "Strategic Report\nc"), ("c", None, "1", 4, None)]
    df = spark.createDataFrame(pages, "club string, company_number string, year string, page int, text string")
    carried = S.carried_lines(S.with_lines(df, KEYS), KEYS)
    assert {r["section"]: r["text"] for r in S.section_texts(carried, KEYS).collect()} == {"strategic_report": "a\nb\nc", "notes": "n"}
    assert [r["section"] for r in S.heading_events(carried, KEYS).orderBy("page", "line_no").collect()] == ["strategic_report", "notes", "strategic_report"]


def test_latest_scan_of_a_page(spark):
    rows = [(1, "c", None, "1", 1, "old", "2020-01-01"), (2, "c", None, "1", 1, "new", "2021-01-01"), (2, "c", None, "1", 1, "new", "2021-01-01"), (3, "c", None, "1", 1, "never", None)]
    df = spark.createDataFrame(rows, "page_id long, club string, company_number string, year string, page int, text string, scanned_at string").withColumn("scanned_at", F.to_timestamp("scanned_at"))
    assert [r["text"] for r in S.latest_pages(df).collect()] == ["new"]


def test_split_tables_and_second_reading(spark):
    split = "Turnover\nCost of sales\n512,467 481,278\n467,205 386,794\n45,262 94,484"
    whole = "Turnover 512,467 481,278\nCost of sales 467,205 386,794\nGross 45,262 94,484"
    df = spark.createDataFrame([(1, split), (2, whole), (3, None)], "page int, text string")
    assert [r["looks_split"] for r in S.split_tables(df).orderBy("page").collect()] == [True, False, False]
    again = spark.createDataFrame([(1, whole), (2, split)], "page int, text string")
    got = S.keep_better(df, again, ["page"]).orderBy("page").collect()
    assert [(r["repaired"], r["text"]) for r in got] == [(True, whole), (False, whole), (False, None)]


def test_empty_input_gives_no_rows(spark, filing):
    none = filing.limit(0)
    assert S.parse_filings(none, KEYS).count() == 0
    assert S.section_texts(S.carried_lines(S.with_lines(none, KEYS), KEYS), KEYS).count() == 0
