"""Pages into sections: page versions, heading rules, carry-forward, quality and flags.

A filing is identified by the columns ``keys``; its pages are rows with ``page`` and ``text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.frames import cut, exact_round, join_on, let

FILING = ["club", "company_number", "year"]
REQUIRED = ("strategic_report", "directors_report", "profit_and_loss", "notes")
MIN_REPORT_CHARS = 2000
MIN_WORDS = 500
MIN_COMMON = 0.08
DENSE_HEADINGS, DENSE_LINES, CONTENTS_HEADINGS = 4, 40, 3


def latest(df: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """One row per key, the first in the given order. NULL keys form a key of their own."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*newest_first))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_pages(pages: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """The last scan of every page of a filing; a repeated row counts once.

    Every column that is asked for moves with its row, so take measures of a text first and the last
    scan of the measures afterwards. Where the texts themselves are needed, see ``pages_together``.
    """
    return latest(pages, [*keys, "page"], F.col("scanned_at").desc_nulls_last(), F.col("page_id").desc())


def pages_together(pages: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """``latest_pages`` with a filing's pages in one partition: the only time a page's text is moved.

    What is grouped or ordered by filing, page or section afterwards needs no further shuffle.
    """
    return latest_pages(pages.repartition(*keys), keys)


def with_lines(pages: DataFrame, keys: list[str] = FILING, more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, page, n_words, n_common, chars, alpha, dense, rows): one narrow pass over each page.

    ``rows`` has each line's number, text and heading. ``dense`` marks a contents page: at least four
    headings among fewer than forty non-blank lines, or a line "contents" and three headings. On a
    dense page no line opens a section. NULL text counts as ''. Columns named in ``more`` are kept.
    """
    text = F.coalesce("text", F.lit(""))
    keys = [*keys, *more]
    df = pages.select(*keys, "page", text.alias("text")).withColumn("lines", X.lines(F.col("text")))
    df = df.withColumn("rows", F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), X.classify_heading(x).alias("heading"))))
    hits = F.size(F.filter("rows", lambda r: r["heading"].isNotNull()))
    full = F.size(F.filter("lines", lambda x: x.rlike(r"(?U)\S")))
    contents = F.col("text").rlike(r"(?iuUmd)^\s*contents\s*$")
    dense = ((hits >= DENSE_HEADINGS) & (full < DENSE_LINES)) | (contents & (hits >= CONTENTS_HEADINGS))
    return df.select(
        *keys, "page", X.n_words(F.col("text")).alias("n_words"), X.n_common(F.col("text")).alias("n_common"),
        F.length("text").alias("chars"), X.n_alpha(F.col("text")).alias("alpha"), dense.alias("dense"), "rows",
    )


VERSION = ("page_id", "scanned_at")


def opening_headings(pages: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """(keys, page, line_no, line, heading): heading lines of the last scans that open a section."""
    rows = with_lines(pages, keys, ("page_id",)).filter("not dense")
    rows = rows.select(*keys, "page_id", "page", F.explode(F.filter("rows", lambda r: r["heading"].isNotNull() & (r["heading"] != "contents"))).alias("r"))
    rows = rows.select(*keys, "page_id", "page", "r.*").dropDuplicates(["page_id", "line_no"])
    return rows.join(latest_pages(pages.select(*keys, "page", *VERSION), keys).select("page_id"), "page_id", "left_semi").drop("page_id")


def page_measures(pages: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """``with_lines`` without the lines, of the last scan of every page.

    Measured where a text is read; only the numbers are shuffled.
    """
    return latest_pages(with_lines(pages, keys, VERSION).drop("rows"), keys).drop(*VERSION)


def page_headings(pages: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """(keys, page, line_no, line, heading): every heading line of the last scan of every page,
    whether or not it opens a section. Only heading lines are shuffled."""
    rows = with_lines(pages, keys, ("page_id",)).select(*keys, "page_id", "page", F.explode(F.filter("rows", lambda r: r["heading"].isNotNull())).alias("r"))
    rows = rows.select(*keys, "page_id", "page", "r.line_no", X.strip(F.col("r.line")).alias("line"), "r.heading").dropDuplicates(["page_id", "line_no"])
    last = latest_pages(pages.select(*keys, "page", *VERSION), keys).select("page_id")
    return rows.join(last, "page_id", "left_semi").drop("page_id")


def page_quality(lined: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """(keys, page, n_words, common_word_ratio, alpha_ratio); a page without words has zeros."""
    some = F.col("n_words") > 0
    return lined.select(
        *keys, "page", "n_words",
        F.when(some, exact_round(F.col("n_common") / F.col("n_words"), 4)).otherwise(0.0).alias("common_word_ratio"),
        F.when(some, exact_round(F.col("alpha") / F.greatest("chars", F.lit(1)), 4)).otherwise(0.0).alias("alpha_ratio"),
    )


def carried_lines(lined: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """(keys, page, line_no, line, heading, section): each line with the section it belongs to.

    The last heading seen in the filing holds until the next, over page ends; before the first it is
    front_matter. Heading lines carry their own section and ``heading``. A window per filing: its
    size is that of one filing.
    """
    opens = F.when(~F.col("dense") & (F.col("r.heading") != "contents"), F.col("r.heading"))
    df = lined.select(*keys, "page", "dense", F.explode("rows").alias("r")).select(*keys, "page", "r.line_no", "r.line", opens.alias("heading"))
    so_far = W.partitionBy(*keys).orderBy("page", "line_no").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(so_far), F.lit("front_matter")))


def section_texts(carried: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """(keys, section, text, n_chars): a section's lines in order, also over gaps, trimmed."""
    body = carried.filter("heading is null").groupBy(*keys, "section").agg(F.sort_array(F.collect_list(F.struct("page", "line_no", "line"))).alias("l"))
    text = X.strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return body.select(*keys, "section", text.alias("text")).withColumn("n_chars", F.length("text"))


def heading_events(carried: DataFrame, keys: list[str] = FILING, more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, page, line_no, section, line): headings that change the section, pages from 1."""
    before = F.lag("heading", 1, "front_matter").over(W.partitionBy(*keys).orderBy("page", "line_no"))
    heads = carried.filter("heading is not null").withColumn("before", before)
    return heads.filter("heading <> before").select(*keys, *more, "page", "line_no", F.col("heading").alias("section"), X.strip(F.col("line")).alias("line"))


def parse_filings(pages: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """One row per filing: counts, quality, flags and what headings were found.

    ``pages`` has one row per page, or all scans with ``page_id`` and ``scanned_at``, of which the last
    counts. Flags: fewer than 500 words, else a share of common words under 0.08 (weighted over the
    page ratios as printed); each required section that is missing or blank; a short strategic
    report. An empty input gives no rows.

    Pages are measured where they are read, and only numbers and heading lines are kept of that
    pass; the texts move once, to be joined into sections.
    """
    versions = VERSION if set(VERSION) <= set(pages.columns) else ()
    measured = with_lines(pages, keys, versions).withColumn("heads", F.filter("rows", lambda r: r["heading"].isNotNull())).drop("rows")
    measured = cut(latest_pages(measured, keys) if versions else measured)
    ratio = page_quality(measured.withColumn("page", F.struct("page", "dense")), keys)
    quality = ratio.groupBy(*keys).agg(
        F.count("*").alias("n_pages"),
        F.sum("n_words").alias("total_words"),
        F.coalesce(F.sum(F.col("common_word_ratio") * F.col("n_words")) / F.nullif(F.sum("n_words"), F.lit(0)), F.lit(0.0)).alias("ratio"),
        F.sort_array(F.collect_list(F.when(F.col("page.dense"), F.col("page.page")))).alias("contents_pages_skipped"),
    )
    heads = measured.filter("not dense").select(*keys, "page", F.explode("heads").alias("r")).select(*keys, "page", "r.*").filter("heading <> 'contents'")
    combined = F.bool_or((F.col("heading") == "strategic_report") & X.is_combined_heading(F.col("line"))).over(W.partitionBy(*keys))
    events = heading_events(heads.withColumn("combined", combined), keys, ("combined",))
    hits = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page", "line_no", "section", "line"))).alias("heading_hits"), F.bool_or("combined").alias("combined"))
    together = pages_together(pages, keys) if versions else pages
    chars = section_texts(carried_lines(with_lines(together, keys), keys), keys).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "n_chars")))).alias("section_chars"))
    out = join_on(join_on(quality, chars, keys), hits, keys)
    out = out.withColumn("section_chars", F.coalesce("section_chars", F.create_map().cast("map<string,int>")))
    size = lambda name: F.coalesce(F.try_element_at("section_chars", F.lit(name)), F.lit(0))
    flags = F.array_compact(
        F.array(
            F.when(F.col("total_words") < MIN_WORDS, "empty_text_layer").when(F.col("ratio") < MIN_COMMON, "suspect_text_layer"),
            *[F.when(size(name) == 0, f"missing_section:{name}") for name in REQUIRED],
            F.when(size("strategic_report") < MIN_REPORT_CHARS, "short_strategic_report"),
        )
    )
    return out.select(
        *keys, "n_pages", "total_words", exact_round(F.col("ratio"), 4).alias("common_word_ratio"), flags.alias("flags"),
        F.array_distinct(F.transform(F.coalesce("heading_hits", F.array().cast("array<struct<page:int,line_no:int,section:string,line:string>>")), lambda h: h["section"])).alias("sections_detected"),
        F.coalesce("combined", F.lit(False)).alias("combined_strategic_and_directors_report"),
        F.transform("heading_hits", lambda h: F.struct(h["page"].alias("page"), h["section"].alias("section"), h["line"].alias("line"))).alias("heading_hits"),
        "contents_pages_skipped", "section_chars",
    )


def filing_check(parsed: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """(keys, n_pages, a count of characters for each required section, flags, short): one row per
    parsed filing (a result of ``parse_filings``); sections that are missing have 0."""
    size = lambda name: F.coalesce(F.try_element_at("section_chars", F.lit(name)), F.lit(0))
    return parsed.select(*keys, "n_pages", *[size(n).alias(n) for n in REQUIRED], F.array_join("flags", ",").alias("flags"), (size("strategic_report") < MIN_REPORT_CHARS).alias("short"))


def corpus_check(sections: DataFrame, keys: list[str] = FILING) -> DataFrame:
    """(section, n_filings, n_chars, n_short): how much text each section has; short is under 2000."""
    return sections.groupBy("section").agg(F.count("*").alias("n_filings"), F.sum("n_chars").alias("n_chars"), F.count_if(F.col("n_chars") < MIN_REPORT_CHARS).alias("n_short"))


# Split tables -----------------------------------------------------------------------------------

# A label and a figure column of a table row.
LABEL = r"[A-Za-z]{3,}"
COLUMN = r"\(?-?\d[\d,]*\)?"


def table_rows(text: Column) -> Column:
    """Lines with a label and at least two figures."""
    return F.size(F.filter(X.lines(text), lambda x: x.rlike(LABEL) & (F.regexp_count(x, F.lit(COLUMN)) >= 2)))


def orphan_rows(text: Column) -> Column:
    """Lines with at least two figures and no label."""
    return F.size(F.filter(X.lines(text), lambda x: ~x.rlike(LABEL) & (F.regexp_count(x, F.lit(COLUMN)) >= 2)))


def split_tables(pages: DataFrame) -> DataFrame:
    """``pages`` with ``table_rows``, ``orphan_rows`` and ``looks_split``: labels and figures of a
    table in separate blocks. NULL text has none of them. Both counts come from one pass of the lines."""
    rows = F.filter(X.lines(F.coalesce("text", F.lit(""))), lambda x: F.regexp_count(x, F.lit(COLUMN)) >= 2)
    kinds = let(rows, lambda r: F.struct(F.size(F.filter(r, lambda x: x.rlike(LABEL))).alias("table_rows"), F.size(F.filter(r, lambda x: ~x.rlike(LABEL))).alias("orphan_rows")))
    out = pages.withColumn("_kinds", kinds).withColumn("table_rows", F.col("_kinds.table_rows")).withColumn("orphan_rows", F.col("_kinds.orphan_rows")).drop("_kinds")
    return out.withColumn("looks_split", (F.col("orphan_rows") >= 3) & (F.col("table_rows") < F.col("orphan_rows")))


def keep_better(pages: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with the text of a second reading where that has strictly more table rows."""
    second = again.select(*keys, F.col("text").alias("_again"))
    out = join_on(pages, second, keys)
    better = F.col("_again").isNotNull() & (table_rows(F.col("_again")) > table_rows(F.coalesce("text", F.lit(""))))
    return out.withColumn("repaired", better).withColumn("text", F.when(better, F.col("_again")).otherwise(F.col("text"))).drop("_again")


# Exclusion --------------------------------------------------------------------------------------

BLOCKING = ["empty_text_layer", "suspect_text_layer", "short_strategic_report"]
MIN_TOKENS = 200


def scoring_reasons(flags: Column, n_tokens: Column) -> Column:
    """Why a report is not scored: its blocking flags, else too few tokens; [] if it is."""
    blocking = F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda f: f.isin(BLOCKING))
    few = F.when(n_tokens < MIN_TOKENS, F.array(F.lit("too_few_tokens"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(blocking) > 0, blocking).otherwise(few)
