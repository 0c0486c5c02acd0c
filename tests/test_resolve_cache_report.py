from pyspark.sql import functions as F

from fathom.operators import cache, report, resolve

AA = "accounts-with-accounts-type-"
FILINGS = "company_number string, type string, date string, description string, transaction_id string, made_up_date string, ordinal int"


def filings(spark, rows):
    return spark.createDataFrame([(n, t, d, AA + k if k else None, x, m, i) for i, (n, t, d, k, x, m) in enumerate(rows)], FILINGS)


def test_plausible_names(spark):
    rows = [("The Example Club Limited", None), ("EXAMPLE HOLDINGS", "active"), ("Example Supporters Trust", None), ("Example Ltd", "dissolved"), ("Age UK Example", None), ("North Blue Co 22 Ltd", None), ("Exampled", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, s string").withColumn("q", F.array(F.lit("Example FC"), F.lit("Blue Co 22")))
    assert [r[0] for r in df.select(resolve.plausible(F.col("t"), F.col("s"), F.col("q"))).collect()] == [True, True, False, False, False, True, False, False]


def test_first_hit_of_a_company_counts(spark):
    hits = spark.createDataFrame([("c", 1, 0, "Example B", "1", None, None), ("c", 0, 5, "Example A", "1", None, None), ("c", 0, 0, "Other", "1", None, None), ("c", 0, 1, "Example X", None, None, None)], "club string, query_no int, result_no int, title string, company_number string, company_status string, date_of_creation string")
    clubs = spark.createDataFrame([("c", ["Example"])], "club string, queries array<string>")
    assert [(r["company_number"], r["title"]) for r in resolve.search_candidates(hits, clubs).collect()] == [("1", "Example A")]


def test_entities_are_ranked(spark):
    rows = [("1", "AA", f"202{i}-01-01", "full", str(i), None) for i in range(4)] + [("2", "AA", "2019-01-01", "group", "a", None), ("3", "AA", "2024-01-01", "dormant", "b", None), ("1", "CS", "2025-01-01", "full", "z", None), ("1", "AA", None, None, "y", None)]
    candidates = spark.createDataFrame([("c", n) for n in "1234"], "club string, company_number string")
    got = {r["company_number"]: r for r in resolve.resolve(candidates, filings(spark, rows)).collect()}
    assert [n for n in sorted(got, key=lambda n: got[n]["place"])] == ["2", "1", "3", "4"] and got["2"]["chosen"] and not got["1"]["chosen"]
    assert (got["1"]["accounts_filings"], got["1"]["n_usable_recent"], got["1"]["latest_date"], got["4"]["best_rank"]) == (4, 4, "2023-01-01", 7)


def test_three_newest_periods_and_amendments(spark):
    rows = [("1", "AA", "2024-12-01", "full", "a", "2024-06-30"), ("1", "AA", "2025-02-01", "full", "b", "2024-06-30"), ("1", "AA", "2023-12-01", "group", "c", "2023-06-30"), ("1", "AA", "2022-12-01", "full", "d", None), ("1", "AA", "2021-12-01", "full", "e", "2021-06-30"), ("1", "AA", "2020-12-01", "small", "f", "2020-06-30"), ("2", "AA", "2020-12-01", "small", "g", "2020-06-30")]
    got = resolve.pick_filings(filings(spark, rows)).orderBy("place").collect()
    assert [(r["transaction_id"], r["year"]) for r in got] == [("b", "2024"), ("c", "2023"), ("d", "2022")]


def test_upsert_and_work_list(spark):
    old = spark.createDataFrame([("c", None, 1, "x"), ("c", "1", 2, "x")], "club string, year string, v int, extra string")
    new = spark.createDataFrame([("c", None, 9), ("d", "1", 3), ("d", "1", 4)], "club string, year string, v int")
    got = {(r["club"], r["year"], r["v"], r["extra"]) for r in cache.upsert(old, new, ["club", "year"]).collect()}
    assert got == {("c", None, 9, None), ("c", "1", 2, "x"), ("d", "1", 4, None)}
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "club string")
    cached = spark.createDataFrame([("a", False, 200, 3, 2), ("b", False, 300, 3, 2), ("c", False, 200, 3, 1), ("d", True, None, None, None)], "club string, unreadable boolean, dpi int, psm int, method_version int")
    got = {r["club"]: (r["reason"], r["reuse_text"]) for r in cache.work_list(wanted, cached, ["club"]).collect()}
    assert got == {"b": ("dpi 300 != 200", False), "c": ("method 1 != 2", True), "d": ("unreadable cache", False), "e": ("missing", False)}
    assert {r["club"] for r in cache.not_yet(wanted, cached, ["club"]).collect()} == {"e"}


def test_cache_is_complete_only_with_every_club(spark):
    clubs = spark.createDataFrame([("a",), ("b",)], "club string")
    chosen = spark.createDataFrame([("a", True), ("b", True)], "club string, chosen boolean")
    files = spark.createDataFrame([(c, n) for c in "ab" for n in (1, 2, 3)], "club string, bytes long")
    said = lambda *x: cache.complete(*x).first()["complete"]
    assert said(clubs, chosen, files) is True
    assert said(clubs, chosen, files.filter("club = 'a' or bytes < 3")) is False
    assert said(clubs.filter("club = 'a'"), chosen, files) is False and said(clubs, chosen.filter("club = 'a'"), files) is False
    assert said(clubs.limit(0), chosen.limit(0), files) is False


ITEMS = "club string, year string, item string, value_gbp long, corrected_value string, cross_check string, source_section string, source_snippet string, confidence string"


def test_tables(spark):
    rows = [("c", "2023", "revenue", 1_250_000, "", None, "notes", "a|b", "high"), ("c", "2023", "profit_on_disposal", 0, None, "agrees with x; OUTLIER: y", "", None, "low"), ("c", "2024", "profit_on_disposal", 5, "76524000", "MISMATCH: z", "p", "s", "low"), ("c", "2024", "wages", None, "0", "agrees with q", "p", "s", "none")]
    items = spark.createDataFrame(rows, ITEMS)
    wide = {r["year"]: r for r in report.items_table(items).collect()}
    assert (wide["2023"]["revenue"], wide["2023"]["profit_on_disposal"], wide["2023"]["wages"]) == ("1.2", "0.0", "—") and (wide["2024"]["profit_on_disposal"], wide["2024"]["wages"]) == ("76.5", "0.0")
    change = spark.createDataFrame([("c", "2024", 0.2, 4.0)], "club string, year string, cosine_novelty double, surprisal_bits double")
    got = {r["year"]: tuple(r)[2:] for r in report.alignment(items, change).collect()}
    assert got == {"2023": ("0.0", "— (no prior year)", "—"), "2024": ("76.5", "0.200", "4.00")}
    printed = {(r["item"], r["year"]): r for r in report.validation_rows(items).collect()}
    assert printed["profit_on_disposal", "2023"]["check"] == "ok; **OUTLIER: y**" and printed["profit_on_disposal", "2024"]["check"] == "**MISMATCH: z**"
    assert printed["wages", "2024"]["value"] == "—" and printed["revenue", "2023"]["source_row"] == "a\\|b" and printed["revenue", "2023"]["value"] == "£1,250,000"
    sheet = report.validation_sheet(items, items.filter("item = 'wages'"))
    assert sheet.count("## c") == 1 and any("player registrations" in x for x in sheet)
    ranks = spark.createDataFrame([("b", 0.2, 0.3, 5.0), ("a", 0.2, 0.4, 5.125)], "club string, mean_cosine_novelty double, max_cosine_novelty double, mean_surprisal_bits double")
    assert [(r["place"], r["club"]) for r in report.ranking_table(ranks).orderBy("place").collect()] == [(1, "a"), (2, "b")]
    assert report.markdown(report.ranking_table(ranks), ["place"])[2] == "| 1 | a | 0.200 | 0.400 | 5.12 |"
    assert report.prefer(None, items)[1] == "raw" and report.prefer(items, items)[1] == "validated"
