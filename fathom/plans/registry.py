"""All registered queries of the core, over whole tables, and their SQL.

Filings are identified by club, company number and year. Measures are rounded on their exact value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import text as X
from ..functions.frames import cut, exact_round, table
from ..operators import cache, drift, extract, report, resolve, sections, similarity
from ..operators.sections import FILING
from . import extract_sql, sql

Query = Callable[[SparkSession, str], DataFrame]
ENTITY = ["club", "company_number"]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def all_pages(spark: SparkSession, d: str) -> DataFrame:
    """All scans of all pages, with banners emptied."""
    return table(spark, d, "ocr_pages").withColumn("text", X.strip_banner(F.col("text")))


def filing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Last scans, a filing's pages together."""
    return sections.pages_together(all_pages(spark, d))


def filing_lines(spark: SparkSession, d: str) -> DataFrame:
    return sections.carried_lines(sections.with_lines(filing_pages(spark, d)))


def filing_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.section_texts(filing_lines(spark, d))


def scored_reports(spark: SparkSession, d: str) -> DataFrame:
    return drift.scored(drift.reports(table(spark, d, "sections")))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "line_items").distinct()


def filings(spark: SparkSession, d: str) -> DataFrame:
    return resolve.manifest_filings(table(spark, d, "manifest"))


# Pages and sections -----------------------------------------------------------------------------


@query(sql.LATEST_PAGES)
def latest_pages(spark: SparkSession, d: str) -> DataFrame:
    return sections.latest_pages(table(spark, d, "ocr_pages")).select(*FILING, "page", "page_id")


@query(sql.PAGE_QUALITY)
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    return sections.page_quality(sections.page_measures(all_pages(spark, d)))


@query(sql.HEADINGS)
def headings(spark: SparkSession, d: str) -> DataFrame:
    """Every heading line of every page, whether or not it opens a section."""
    return sections.page_headings(all_pages(spark, d))


@query(sql.DENSE_PAGES)
def dense_pages(spark: SparkSession, d: str) -> DataFrame:
    return sections.page_measures(all_pages(spark, d)).filter("dense").select(*FILING, "page")


@query(sql.SECTIONS)
def filing_section_sizes(spark: SparkSession, d: str) -> DataFrame:
    return filing_sections(spark, d).select(*FILING, "section", F.md5("text").alias("text_md5"))


@query(sql.EVENTS)
def heading_events(spark: SparkSession, d: str) -> DataFrame:
    """Headings that open another section. Only heading lines are moved."""
    return sections.heading_events(sections.opening_headings(all_pages(spark, d)))


@query(sql.PARSED)
def parsed_filings(spark: SparkSession, d: str) -> DataFrame:
    """``parse_filings`` with its lists as text."""
    out = sections.parse_filings(all_pages(spark, d))
    hits = F.transform(F.coalesce("heading_hits", F.array().cast("array<struct<page:int,section:string,line:string>>")), lambda h: F.concat_ws("|", h["page"].cast("string"), h["section"], h["line"]))
    sizes = F.transform(F.array_sort(F.map_entries("section_chars")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    texts = {"flags": F.col("flags"), "sections_detected": F.col("sections_detected"), "contents_pages_skipped": F.col("contents_pages_skipped").cast("array<string>"), "heading_hits": hits, "section_chars": sizes}
    return out.withColumns({k: F.array_join(v, ";") for k, v in texts.items()})


@query(sql.FILING_CHECK)
def filing_check(spark: SparkSession, d: str) -> DataFrame:
    return sections.filing_check(sections.parse_filings(all_pages(spark, d)))


@query(sql.CORPUS)
def corpus_check(spark: SparkSession, d: str) -> DataFrame:
    rows = sections.latest(table(spark, d, "sections"), [*FILING, "section"], F.col("parsed_at").desc_nulls_last(), F.col("section_id").desc())
    return sections.corpus_check(rows.withColumn("n_chars", F.length(F.coalesce("text", F.lit("")))))


def table_measures(spark: SparkSession, d: str) -> DataFrame:
    rows = sections.split_tables(table(spark, d, "ocr_pages"))
    return rows.withColumn("text_md5", F.md5("text")).select(*FILING, "page", *sections.VERSION, "table_rows", "orphan_rows", "looks_split", "text_md5")


@query(sql.SPLIT_TABLES)
def split_tables(spark: SparkSession, d: str) -> DataFrame:
    return sections.latest_pages(table_measures(spark, d)).drop(*sections.VERSION, "text_md5")


@query(sql.BETTER)
def better_reading(spark: SparkSession, d: str) -> DataFrame:
    """Split pages, and whether their filing's earlier scan has more table rows. Both scans are
    measured where they are read: of a text only its hash is moved."""
    scans = sections.latest(table_measures(spark, d), ["page_id"], F.col("scanned_at").desc_nulls_last())
    at = sections.W.partitionBy(*FILING, "page").orderBy(F.col("scanned_at").desc_nulls_last(), F.col("page_id").desc())
    scans = scans.withColumn("place", F.row_number().over(at)).withColumn("again", F.lead(F.struct("table_rows", "text_md5")).over(at))
    better = F.coalesce(F.col("again.text_md5").isNotNull() & (F.col("again.table_rows") > F.col("table_rows")), F.lit(False))
    return scans.filter("place = 1 and looks_split").select(*FILING, "page", better.alias("repaired"), F.when(better, F.col("again.text_md5")).otherwise(F.col("text_md5")).alias("text_md5"))


# Line items -------------------------------------------------------------------------------------


@query(sql.NUMBERS)
def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct white-space tokens of the profit and loss accounts with the value they print."""
    rows = table(spark, d, "sections").filter("section = 'profit_and_loss'")
    tokens = rows.select(F.explode(F.split("text", r"[ \n]+")).alias("raw")).filter("raw <> ''").distinct()
    return tokens.select("raw", G.parse_number(F.col("raw")).alias("value"), G.is_year(F.col("raw")).alias("is_year"))


@query(extract_sql.ROW_FIGURES)
def row_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures, current value and comparative of every distinct line of the profit and loss accounts."""
    rows = table(spark, d, "sections").filter("section = 'profit_and_loss'").select(F.explode(X.lines(F.col("text"))).alias("line")).distinct()
    rows = rows.select("line", F.explode(F.array(G.row_figures(G.strip_note_references(F.col("line")), F.lit(0)))).alias("figs"))
    rows = rows.select("line", F.explode(F.array(G.clean_figures(F.col("figs"), F.lit(1000)))).alias("figs"))
    return rows.select("line", F.size("figs").alias("n_figures"), G.current_figure(F.col("figs"))["value"].alias("current"), G.comparative(F.col("figs")).alias("comparative"), G.total_column(F.col("figs")).alias("total_column"))


@query(sql.UNITS)
def units(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sections").filter("section = 'profit_and_loss' and text is not null")
    rows = rows.select("section_id", F.explode(F.array(G.unit_markers(F.col("text")))).alias("own")).dropDuplicates(["section_id"])
    multiplier, evidence = G.unit(F.col("own"), F.struct(F.lit(0).alias("m"), F.lit(0).alias("k")))
    return rows.select("section_id", multiplier.alias("multiplier"), evidence.alias("evidence"))


@query(extract_sql.EXTRACTED_ITEMS)
def extracted_items(spark: SparkSession, d: str) -> DataFrame:
    found = extract.line_items(cut(filing_sections(spark, d)))
    return extract.series_check(extract.cross_check(found, ENTITY), ENTITY)


@query(extract_sql.CONTEXT_ITEMS)
def context_items(spark: SparkSession, d: str) -> DataFrame:
    return extract.find_items(cut(filing_sections(spark, d)), items=extract.CONTEXT)


@query(extract_sql.DERIVED_TOTALS)
def derived_totals(spark: SparkSession, d: str) -> DataFrame:
    return extract.derived_totals(cut(extract.section_rows(cut(filing_sections(spark, d)), FILING)))


@query(sql.CROSS_CHECK)
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    return extract.cross_check(items(spark, d), ENTITY).select(*FILING, "item", "value_gbp", "cross_check", "restated_next_year", "confidence")


@query(sql.SERIES_CHECK)
def series_check(spark: SparkSession, d: str) -> DataFrame:
    return extract.series_check(extract.cross_check(items(spark, d), ENTITY), ENTITY).select(*FILING, "item", "value_gbp", "cross_check", "confidence")


# Drift ------------------------------------------------------------------------------------------


@query(sql.TOKENS)
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = X.tokens(F.coalesce("text", F.lit("")))
    rows = table(spark, d, "sections").select("section_id", F.explode(F.array(tokens)).alias("t"))
    return rows.select("section_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms")).dropDuplicates(["section_id"])


@query(sql.EXCLUDED)
def excluded_reports(spark: SparkSession, d: str) -> DataFrame:
    return drift.excluded(drift.report_reasons(table(spark, d, "sections")))


@query(sql.BLOCKED)
def blocked_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports that all flags of their parsed filing, and their tokens, keep from being scored."""
    flags = sections.parse_filings(all_pages(spark, d))
    return drift.excluded(drift.report_reasons(table(spark, d, "sections"), flags=flags))


@query(sql.YEAR_PAIRS)
def year_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = drift.report_reasons(table(spark, d, "sections"))
    return drift.year_pairs(rows.filter(F.size("reasons") == 0))


@query(sql.TFIDF)
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    weights = similarity.tfidf(scored_reports(spark, d), ENTITY)
    return weights.select("doc", "term", exact_round(F.col("weight")).alias("weight"))


@query(sql.DRIFT)
def drift_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lexical drift without surprisal."""
    return drift.drift(scored_reports(spark, d), ENTITY, with_surprisal=False)


@query(sql.SURPRISAL)
def surprisal(spark: SparkSession, d: str) -> DataFrame:
    return drift.surprisals(scored_reports(spark, d), ENTITY)


@query(sql.SANITY)
def sanity(spark: SparkSession, d: str) -> DataFrame:
    return drift.sanity(scored_reports(spark, d), ENTITY)


@query(sql.RANKING)
def ranking(spark: SparkSession, d: str) -> DataFrame:
    return drift.ranking(table(spark, d, "drift").distinct())


@query(sql.RANKING_TABLE)
def ranking_table(spark: SparkSession, d: str) -> DataFrame:
    return report.ranking_table(drift.ranking(table(spark, d, "drift").distinct()))


@query(sql.DRIFT_TABLE)
def drift_table(spark: SparkSession, d: str) -> DataFrame:
    return report.drift_table(table(spark, d, "drift").distinct(), ENTITY)


@query(sql.ORDERED)
def ordered_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The ranking in its order, which is one row per entity; the place makes the order visible."""
    rows = drift.ordered_ranking(drift.ranking(table(spark, d, "drift").distinct()))
    return rows.select(F.monotonically_increasing_id().alias("_i"), "club", "mean_cosine_novelty").select(F.row_number().over(sections.W.orderBy("_i")).alias("place"), "club", "mean_cosine_novelty")


def drift_report(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: texts to the drift of every pair of years, with surprisal."""
    return drift.drift(scored_reports(spark, d), ENTITY)


QUERIES["drift"] = drift_report
ORACLES["drift"] = sql.FULL_DRIFT


# Entities and filings ---------------------------------------------------------------------------


@query(sql.ACCOUNTS)
def accounts_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = resolve.accounts_summary(filings(spark, d))
    return rows.withColumn("recent_descriptions", F.array_join("recent_descriptions", ","))


@query(sql.RESOLVE)
def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    some = filings(spark, d)
    candidates = some.groupBy("club", "company_number").agg(F.min("company_name").alias("title"))
    return resolve.resolve(candidates, some).select("club", "company_number", "title", "best_rank", "n_usable_recent", "latest_date", "place", "chosen")


@query(sql.CANDIDATES)
def plausible_names(spark: SparkSession, d: str) -> DataFrame:
    """Company names found for a club by two searches, for its first word and for its whole name; a
    company's first plausible hit in that order stands."""
    some = filings(spark, d)
    word = F.get(F.split("club", "-"), F.lit(0))
    hits = some.select("club", F.explode(F.array(F.lit(0), F.lit(1))).alias("query_no"), F.dense_rank().over(sections.W.partitionBy("club").orderBy("company_name", "company_number")).alias("result_no"), F.col("company_name").alias("title"), "company_number", F.lit("active").alias("company_status"), F.lit(None).cast("string").alias("date_of_creation")).distinct()
    hits = hits.filter((F.col("query_no") == 1) | F.contains(F.lower("title"), word))
    clubs = some.select("club").distinct().withColumn("queries", F.array(word, F.replace("club", F.lit("-"), F.lit(" "))))
    return resolve.search_candidates(hits, clubs).select("club", "company_number", "title")


@query(sql.PICKED)
def picked_filings(spark: SparkSession, d: str) -> DataFrame:
    return resolve.pick_filings(filings(spark, d), keys=ENTITY).select("club", "company_number", "transaction_id", "year", "place")


@query(sql.LABELS)
def filing_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest").distinct()
    return rows.select("transaction_id", X.year_label(F.col("made_up_date"), F.col("filing_date")).alias("year_label"), X.date_key(F.col("made_up_date")).alias("date_key"), X.last_path_part(F.col("path")).alias("document"))


@query(sql.UPSERT)
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Group accounts upserted over all others, one row per filing."""
    rows = table(spark, d, "manifest").distinct()
    group = F.col("accounts_type") == resolve.ACCOUNTS[0]
    order = [F.col("filing_date").desc(), F.col("transaction_id").desc()]
    return cache.upsert(rows.filter(~group), rows.filter(group), FILING, order).select(*FILING, "transaction_id")


@query(sql.NOT_SCORED)
def filings_to_score(spark: SparkSession, d: str) -> DataFrame:
    """Filings that no pair of years ends with: the first of each company and those left out."""
    return cache.not_yet(table(spark, d, "manifest").select(*FILING).distinct(), table(spark, d, "drift"), FILING)


@query(sql.WORK)
def filings_to_read(spark: SparkSession, d: str) -> DataFrame:
    """Filings whose page text is missing or was made with other settings (a settings row each, the
    version taken from the year's parity)."""
    done = table(spark, d, "ocr_pages").select(*FILING).distinct()
    done = done.select(*FILING, F.lit(False).alias("unreadable"), F.lit(200).alias("dpi"), F.lit(3).alias("psm"), (F.col("year").cast("int") % 2 + 1).alias("method_version"))
    return cache.work_list(table(spark, d, "manifest").select(*FILING).distinct(), done, FILING)


@query(sql.COMPLETE)
def cache_complete(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest")
    entities = rows.select("club", F.lit(True).alias("chosen"))
    return cache.complete(table(spark, d, "ocr_pages").select("club"), entities, rows.select("club", "transaction_id", "bytes").distinct())


# Report -----------------------------------------------------------------------------------------


@query(sql.ITEMS_TABLE)
def items_table(spark: SparkSession, d: str) -> DataFrame:
    return report.items_table(items(spark, d), ENTITY)


def validated(spark: SparkSession, d: str) -> DataFrame:
    """The items as a reviewer returns them who accepts every restatement: ``corrected_value`` is
    the restated one, blank where nothing was restated."""
    return items(spark, d).withColumn("corrected_value", F.coalesce(F.col("restated_next_year").cast("string"), F.lit("")))


@query(sql.VALIDATED_TABLE)
def validated_items_table(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = report.prefer(validated(spark, d), items(spark, d))
    return report.items_table(rows, ENTITY)


@query(sql.VALIDATED_ALIGNMENT)
def validated_alignment(spark: SparkSession, d: str) -> DataFrame:
    return report.alignment(validated(spark, d), table(spark, d, "drift"), entity=ENTITY)


@query(sql.ALIGNMENT)
def alignment(spark: SparkSession, d: str) -> DataFrame:
    return report.alignment(items(spark, d), table(spark, d, "drift"), entity=ENTITY)


@query(sql.VALIDATION)
def validation_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.validation_rows(items(spark, d), ENTITY)


@query(extract_sql.SHEET)
def validation_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The extracted items and their context as reviewers see them."""
    texts = cut(filing_sections(spark, d))
    rowed = cut(extract.section_rows(texts, FILING))
    filings = texts.select(*FILING).distinct()
    found, context = (extract.best_items(filings, extract.candidates(rowed, FILING, x), FILING, x) for x in (extract.ITEMS, extract.CONTEXT))
    return report.sheet_rows(extract.cross_check(found, ENTITY), context, ENTITY)


@query(sql.CONFIDENCE)
def confidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.confidence_counts(items(spark, d))
