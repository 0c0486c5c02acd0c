"""Ranking, wide tables and Markdown sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import fixed, join_on

DASH = "—"
ITEMS = ["revenue", "wages", "player_amortisation", "profit_on_disposal"]


def pounds(value: Column) -> Column:
    """£1,234, or a dash for NULL."""
    return F.coalesce(F.concat(F.lit("£"), F.format_number(value.cast("double"), 0)), F.lit(DASH))


def millions(value: Column) -> Column:
    """Millions with one decimal, or a dash for what is no number."""
    return F.coalesce(F.format_number(value.try_cast("double") / 1_000_000, 1), F.lit(DASH))


def final_value(corrected: Column, extracted: Column) -> Column:
    """The corrected value unless blank ('0' is not blank), else the extracted one."""
    return F.coalesce(F.nullif(corrected.cast("string"), F.lit("")), extracted.cast("string"))


def prefer(validated: DataFrame | None, raw: DataFrame) -> tuple[DataFrame, str]:
    """The validated table as a whole if there is one, else the raw one, with its name."""
    return (validated, "validated") if validated is not None else (raw, "raw")


def items_table(items: DataFrame, entity: list[str] = ["club"]) -> DataFrame:  # noqa: B006
    """(entity, year, one column an item): values in millions; the first row of a repeated key by
    value. Rows appear where any item exists."""
    value = final_value(F.col("corrected_value") if "corrected_value" in items.columns else F.lit(None).cast("string"), F.col("value_gbp"))
    df = items.select(*entity, "year", "item", value.alias("v"))
    wide = df.groupBy(*entity, "year").pivot("item", ITEMS).agg(F.min(F.struct(F.col("v").isNull().alias("none"), F.col("v").try_cast("double").alias("n"), "v")))
    return wide.select(*entity, "year", *[millions(F.col(f"{i}.v")).alias(i) for i in ITEMS])


def ranking_table(ranking: DataFrame, entity: str = "club") -> DataFrame:
    """(place, entity, measures as text): rank from 1 by mean cosine novelty, then name.

    A global order: its input is one row per entity, never the documents.
    """
    place = F.row_number().over(W.orderBy(F.col("mean_cosine_novelty").desc(), entity))
    return ranking.select(place.alias("place"), entity, fixed(F.col("mean_cosine_novelty"), 3).alias("mean_cosine_novelty"), fixed(F.col("max_cosine_novelty"), 3).alias("max_cosine_novelty"), fixed(F.col("mean_surprisal_bits"), 2).alias("mean_surprisal_bits"))


def drift_table(drift: DataFrame, entity: list[str] = ["club"]) -> DataFrame:  # noqa: B006
    return drift.select(*entity, F.concat("year_prev", F.lit("→"), "year").alias("pair"), fixed(F.col("cosine_novelty"), 3).alias("cosine_novelty"), fixed(F.col("jaccard_novelty"), 3).alias("jaccard_novelty"), fixed(F.col("surprisal_bits"), 2).alias("surprisal_bits"))


def alignment(items: DataFrame, drift: DataFrame, item: str = "profit_on_disposal", entity: list[str] = ["club"]) -> DataFrame:  # noqa: B006
    """(entity, year, value, cosine novelty, surprisal) of each year with items; a year without a
    drift pair says so."""
    years = items.select(*entity, "year").distinct()
    value = final_value(F.col("corrected_value") if "corrected_value" in items.columns else F.lit(None).cast("string"), F.col("value_gbp"))
    some = items.filter(F.col("item") == item).groupBy(*entity, "year").agg(F.min(F.struct(value.isNull().alias("none"), value.try_cast("double").alias("n"))).alias("s"))
    change = drift.groupBy(*entity, "year").agg(F.min(F.struct("cosine_novelty", "surprisal_bits")).alias("d"))
    df = join_on(join_on(years, some, [*entity, "year"]), change, [*entity, "year"])
    return df.select(
        *entity, "year", millions(F.col("s.n")).alias(item),
        F.coalesce(fixed(F.col("d.cosine_novelty"), 3), F.lit(f"{DASH} (no prior year)")).alias("cosine_novelty"),
        F.coalesce(fixed(F.col("d.surprisal_bits"), 2), F.lit(DASH)).alias("surprisal_bits"),
    )


def validation_rows(items: DataFrame, entity: list[str] = ["club"]) -> DataFrame:  # noqa: B006
    """(entity, year, item, value, confidence, check, section, source_row) as printed.

    An agreeing row that is an outlier of its series keeps that verdict visible.
    """
    check = F.nullif(F.col("cross_check"), F.lit(""))
    outlier = F.regexp_extract(check, "OUTLIER.*", 0)
    said = F.when(check.startswith("agrees") & (outlier != ""), F.concat(F.lit("ok; **"), outlier, F.lit("**"))).when(check.startswith("agrees"), "ok").when(check.startswith("MISMATCH"), F.concat(F.lit("**"), check, F.lit("**"))).otherwise(check)
    source = F.coalesce(F.nullif(F.replace(F.col("source_snippet"), F.lit("|"), F.lit("\\|")), F.lit("")), F.lit(DASH))
    return items.select(*entity, "year", "item", pounds(F.col("value_gbp")).alias("value"), "confidence", F.coalesce(said, F.lit(DASH)).alias("check"), F.coalesce(F.nullif(F.col("source_section"), F.lit("")), F.lit(DASH)).alias("section"), source.alias("source_row"))


def sheet_rows(items: DataFrame, context: DataFrame, entity: list[str] = ["club"]) -> DataFrame:  # noqa: B006
    """The rows of the sheet that reviewers fill in: ``validation_rows`` (kind item) and, of context items that
    were found or not, value and source row (kind context)."""
    names = [*entity, "year", "kind", "item", "value", "confidence", "check", "section", "source_row"]
    extra = context.select(
        *entity, "year", F.lit("context").alias("kind"), "item", pounds(F.col("value_gbp")).alias("value"), *[F.lit("").alias(c) for c in ("confidence", "check", "section")],
        F.coalesce(F.nullif(F.replace(F.col("source_snippet"), F.lit("|"), F.lit("\\|")), F.lit("")), F.lit(DASH)).alias("source_row"),
    )
    return validation_rows(items, entity).withColumn("kind", F.lit("item")).select(*names).unionByName(extra.select(*names))


def confidence_counts(items: DataFrame) -> DataFrame:
    """(confidence, n, disclosed): how many items have each confidence and how many a value."""
    return items.groupBy("confidence").agg(F.count("*").alias("n"), F.count("value_gbp").alias("disclosed"))


def markdown(df: DataFrame, order: list[str], align: dict[str, str] | None = None) -> list[str]:
    """Lines of a Markdown table, streamed to the driver in order. For report-sized results."""
    names = df.columns
    out = ["| " + " | ".join(names) + " |", "|" + "|".join((align or {}).get(n, "---") for n in names) + "|"]
    out += ["| " + " | ".join("" if r[n] is None else str(r[n]) for n in names) + " |" for r in df.orderBy(*order).toLocalIterator()]
    return out


def validation_sheet(items: DataFrame, context: DataFrame | None = None, entity: str = "club") -> list[str]:
    """Lines of the sheet that reviewers fill in: a table per entity, with the context items under it."""
    rank = F.array_position(F.array(*map(F.lit, ITEMS)), F.col("item"))
    rows = validation_rows(items, [entity]).withColumn("_k", rank)
    out, now = ["# Line-item validation", ""], None
    extra: dict[str, list[str]] = {}
    if context is not None:
        for r in context.select(entity, "year", pounds(F.col("value_gbp")).alias("v"), F.coalesce("source_snippet", F.lit(DASH)).alias("s")).orderBy(entity, "year").toLocalIterator():
            extra.setdefault(r[entity], []).append(f"| {r['year']} | {r['v']} | `{r['s']}` |")

    def close() -> None:
        if now in extra:
            out.extend(["", "_Context: profit on disposal of player registrations._", "", "| year | value | source row |", "|---|---|---|", *extra[now]])
        out.append("")

    for r in rows.orderBy(entity, "year", "_k").toLocalIterator():
        if r[entity] != now:
            if now is not None:
                close()
            now = r[entity]
            out += [f"## {now}", "", "| year | item | value | conf | check | section | source row | verified? | corrected_value |", "|---|---|---|---|---|---|---|---|---|"]
        out.append(f"| {r['year']} | {r['item']} | {r['value']} | {r['confidence']} | {r['check']} | {r['section']} | `{r['source_row']}` |  |  |")
    if now is not None:
        close()
    return out
