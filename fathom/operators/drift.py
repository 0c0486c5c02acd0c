"""Change of language between an entity's consecutive available years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.frames import cut, exact_round, join_on
from . import ngram
from .sections import MIN_REPORT_CHARS, latest, scoring_reasons
from .similarity import consecutive, cosine, jaccard, tfidf

ENTITY = ["club", "company_number"]
STRIDE = 7


def reports(sections: DataFrame, entity: list[str] = ENTITY, flags: DataFrame | None = None) -> DataFrame:
    """(entity, year, doc, text, tokens, reasons): the last parse of each filing's strategic report.

    ``reasons`` is empty for reports that can be scored. ``flags``: (entity, year, flags) of the parsed
    filings (``parse_filings``), whose blocking ones count; without them the length of the report
    alone is judged. NULL text counts as ''. The rows of an entity lie in one partition (it has one
    report a year), so its later windows need no shuffle.
    """
    rows = sections.filter("section = 'strategic_report'").repartition(*entity)
    rows = latest(rows, [*entity, "year"], F.col("parsed_at").desc_nulls_last(), F.col("section_id").desc())
    text = F.coalesce("text", F.lit(""))
    rows = rows.select(*entity, "year", F.col("section_id").alias("doc"), text.alias("text"), X.tokens(text).alias("tokens"))
    short = F.when(F.length("text") < MIN_REPORT_CHARS, F.array(F.lit("short_strategic_report"))).otherwise(F.array().cast("array<string>"))
    if flags is not None:
        rows = join_on(rows, flags.select(*entity, "year", F.col("flags").alias("_flags")), [*entity, "year"])
        short = F.coalesce("_flags", short)
    return rows.withColumn("reasons", scoring_reasons(short, F.size("tokens"))).drop("_flags")


def report_reasons(sections: DataFrame, entity: list[str] = ENTITY, flags: DataFrame | None = None) -> DataFrame:
    """(entity, year, doc, reasons) of every report: ``reports`` without its texts, which are measured
    where they are read and never moved."""
    rows = sections.filter("section = 'strategic_report'")
    text = F.coalesce("text", F.lit(""))
    rows = rows.select(*entity, "year", "section_id", "parsed_at", F.length(text).alias("chars"), F.size(X.tokens(text)).alias("n_tokens"))
    rows = latest(rows, [*entity, "year"], F.col("parsed_at").desc_nulls_last(), F.col("section_id").desc())
    short = F.when(F.col("chars") < MIN_REPORT_CHARS, F.array(F.lit("short_strategic_report"))).otherwise(F.array().cast("array<string>"))
    if flags is not None:
        rows = join_on(rows, flags.select(*entity, "year", F.col("flags").alias("_flags")), [*entity, "year"])
        short = F.coalesce("_flags", short)
    return rows.select(*entity, "year", F.col("section_id").alias("doc"), scoring_reasons(short, F.col("n_tokens")).alias("reasons"))


def scored(reports: DataFrame) -> DataFrame:
    return reports.filter(F.size("reasons") == 0).drop("reasons", "text")


def excluded(reports: DataFrame, entity: list[str] = ENTITY) -> DataFrame:
    return reports.filter(F.size("reasons") > 0).select(*entity, "year", F.array_join("reasons", ",").alias("reason"))


def year_pairs(docs: DataFrame, entity: list[str] = ENTITY) -> DataFrame:
    """(entity, year_prev, year, doc_prev, doc): each year with the one available before it."""
    w = W.partitionBy(*entity).orderBy("year")
    df = docs.select(*entity, "year", "doc", F.lag("year").over(w).alias("year_prev"), F.lag("doc").over(w).alias("doc_prev"))
    return df.filter("doc_prev is not null").select(*entity, "year_prev", "year", "doc_prev", "doc")


def drift(docs: DataFrame, entity: list[str] = ENTITY, with_surprisal: bool = True) -> DataFrame:
    """One row per consecutive pair of years of each entity, measures to six decimals.

    ``docs``: (entity, year, doc, tokens), ``doc`` unique. Term weights are fitted per entity. An
    entity with one year has no row. NULL entity columns are values like others.
    """
    docs = docs.select(*entity, "year", "doc", "tokens")
    if with_surprisal:
        docs = cut(docs)
    out = consecutive(docs.repartition(*entity) if with_surprisal else docs, entity)
    measures = [
        exact_round(F.col("cosine")).alias("cosine_similarity"), exact_round(1.0 - F.col("cosine")).alias("cosine_novelty"),
        exact_round(F.col("jaccard")).alias("jaccard_similarity"), exact_round(1.0 - F.col("jaccard")).alias("jaccard_novelty"),
    ]
    if with_surprisal:
        bits = ngram.surprisal(year_pairs(docs, entity).select("doc_prev", "doc"), docs.select("doc", "tokens"))
        out = out.join(bits, ["doc_prev", "doc"])
        measures.append(exact_round(F.col("bits")).alias("surprisal_bits"))
    return out.select(*entity, "year_prev", "year", "n_tokens_prev", "n_tokens", *measures)


def surprisals(docs: DataFrame, entity: list[str] = ENTITY) -> DataFrame:
    """(entity, year_prev, year, surprisal_bits): ``drift`` without its lexical measures."""
    docs = cut(docs.select(*entity, "year", "doc", "tokens"))
    pairs = year_pairs(docs, entity)
    bits = ngram.surprisal(pairs.select("doc_prev", "doc"), docs.select("doc", "tokens"))
    return pairs.join(bits, ["doc_prev", "doc"]).select(*entity, "year_prev", "year", exact_round(F.col("bits")).alias("surprisal_bits"))


def ranking(drift: DataFrame, entity: str = "club") -> DataFrame:
    """Entities by mean cosine novelty: counts, means and maxima of the rounded pair measures.

    The measures have six decimals and are summed as such: a mean on a rounding tie does not depend
    on the order of the rows.
    """
    mean = lambda c: exact_round(F.sum(F.col(c).cast("decimal(20,6)")).cast("double") / F.count(c))
    rows = drift.groupBy(entity).agg(
        F.count("*").alias("n_pairs"),
        mean("cosine_novelty").alias("mean_cosine_novelty"),
        F.max("cosine_novelty").alias("max_cosine_novelty"),
        mean("jaccard_novelty").alias("mean_jaccard_novelty"),
        mean("surprisal_bits").alias("mean_surprisal_bits"),
        F.max("surprisal_bits").alias("max_surprisal_bits"),
    )
    return rows


def ordered_ranking(ranking: DataFrame, entity: str = "club") -> DataFrame:
    return ranking.orderBy(F.col("mean_cosine_novelty").desc(), entity)


def sanity(docs: DataFrame, entity: list[str] = ENTITY) -> DataFrame:
    """One row: self-similarity and self-surprisal of the first entity's last report, against a fixed
    stride permutation of its words, and whether each check passes. No scored report: no row."""
    one = docs.orderBy(*entity, F.col("year").desc()).limit(1).select(*entity, "year", "tokens")
    n = F.size("tokens")
    stride = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("tokens", F.pmod(i * STRIDE, n).cast("int") + 1))
    forms = cut(one.select(*entity, "year", n.alias("n_tokens"), F.explode(F.array(F.struct(F.lit("a").alias("doc"), F.col("tokens").alias("tokens")), F.struct(F.lit("b").alias("doc"), F.col("tokens").alias("tokens")), F.struct(F.lit("s").alias("doc"), stride.alias("tokens")))).alias("f")).select(*entity, "year", "n_tokens", "f.doc", "f.tokens"))
    copies = forms.filter("doc <> 's'")
    pair = copies.groupBy(*entity, "year", "n_tokens").agg(F.min("doc").alias("doc_prev"), F.max("doc").alias("doc"), F.min_by("tokens", "doc").alias("x"), F.max_by("tokens", "doc").alias("y"))
    same_text = cosine(pair.select("doc_prev", "doc"), tfidf(copies.withColumn("all", F.lit(1)), ["all"]))
    links = forms.sparkSession.createDataFrame([("a", "b"), ("a", "s")], "doc_prev string, doc string").join(forms.select("doc"), "doc", "left_semi")
    bits = ngram.surprisal(links, forms.select("doc", "tokens")).groupBy().agg(F.max(F.when(F.col("doc") == "b", F.col("bits"))).alias("own"), F.max(F.when(F.col("doc") == "s", F.col("bits"))).alias("mixed"))
    bits = bits.withColumn("doc", F.lit("b"))
    out = pair.join(same_text, ["doc_prev", "doc"]).join(bits, "doc")
    cosine_novelty, jaccard_novelty = 1.0 - F.col("cosine"), 1.0 - jaccard(F.col("x"), F.col("y"))
    return out.select(
        *entity, "year", "n_tokens", exact_round(cosine_novelty, 9).alias("identical_cosine_novelty"), exact_round(jaccard_novelty, 9).alias("identical_jaccard_novelty"),
        exact_round(F.col("own")).alias("identical_surprisal_bits"), exact_round(F.col("mixed")).alias("shuffled_surprisal_bits"),
        (cosine_novelty < 1e-9).alias("identical_cosine_novelty_near_zero"), (jaccard_novelty < 1e-12).alias("identical_jaccard_novelty_zero"),
        (F.col("mixed") > F.col("own")).alias("shuffled_more_surprising_than_identical"),
    )
