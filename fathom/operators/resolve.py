"""Which company files for a club, and which of its filings to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.frames import join_on

# Kinds of accounts, best first; the first three are usable.
ACCOUNTS = [
    "accounts-with-accounts-type-group",
    "accounts-with-accounts-type-full",
    "accounts-with-accounts-type-medium",
    "accounts-with-accounts-type-small",
    "accounts-with-accounts-type-total-exemption-full",
    "accounts-with-accounts-type-micro-entity",
    "accounts-with-accounts-type-dormant",
]
USABLE = ACCOUNTS[:3]
# Parts of names of other bodies.
NOISE = ["supporters", "fan club", "ladies", "travel club", "foundation", "charitable", "community sports"]
RECENT, PER_COMPANY = 6, 3


def accounts_rank(description: Column) -> Column:
    """Place in ``ACCOUNTS`` from 0; NULL for any other kind."""
    place = F.array_position(F.array(*map(F.lit, ACCOUNTS)), description)
    return F.when(place > 0, (place - 1).cast("int"))


def plausible(title: Column, status: Column, queries: Column, noise: list[str] = NOISE) -> Column:
    """Whether a search hit can be the entity searched for.

    Its name holds no noise word, it is not dissolved, and it begins with the first word of a query
    (after "the") or contains a whole query. NULL title or status count as ''.
    """
    name = F.lower(F.coalesce(title, F.lit("")))
    first = F.get(F.split(F.regexp_replace(name, r"(?U)^the\s+", ""), r"(?U)[\s,.]+", 2), F.lit(0))
    noisy = F.exists(F.array(*map(F.lit, noise)), lambda n: F.contains(name, n))
    hit = F.exists(queries, lambda q: (first == F.get(F.split(F.trim(F.lower(q)), r"(?U)\s+"), F.lit(0))) | F.contains(name, F.lower(q)))
    return ~noisy & (F.coalesce(status, F.lit("")) != "dissolved") & F.coalesce(hit, F.lit(False))


def search_candidates(hits: DataFrame, clubs: DataFrame) -> DataFrame:
    """First plausible hit of each company of a club, in query and then result order.

    ``hits``: (club, query_no, result_no, title, company_number, company_status, date_of_creation);
    ``clubs``: (club, queries). Hits without a number are dropped.
    """
    df = join_on(hits.filter(F.col("company_number").isNotNull() & (F.col("company_number") != "")), clubs.select("club", "queries"), ["club"], "inner")
    df = df.filter(plausible(F.col("title"), F.col("company_status"), F.col("queries")))
    w = W.partitionBy("club", "company_number").orderBy("query_no", "result_no")
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "queries", "query_no", "result_no")


def accounts_summary(filings: DataFrame, keys: list[str] = ["company_number"]) -> DataFrame:  # noqa: B006
    """Per company: ranked accounts, and of the six most recent their kinds in order, best rank,
    usable number and latest date. ``filings``: (keys, type, date, description, ordinal); the
    ordinal breaks ties of date."""
    df = filings.filter((F.col("type") == "AA") & accounts_rank(F.col("description")).isNotNull())
    newest = W.partitionBy(*keys).orderBy(F.coalesce("date", F.lit("")).desc(), "ordinal")
    df = df.withColumn("rn", F.row_number().over(newest)).withColumn("total", F.count("*").over(W.partitionBy(*keys))).filter(F.col("rn") <= RECENT)
    return df.groupBy(*keys).agg(
        F.first("total").alias("accounts_filings"),
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "description"))), lambda x: x["description"]).alias("recent_descriptions"),
        F.min(accounts_rank(F.col("description"))).alias("best_rank"),
        F.count_if(F.col("description").isin(USABLE)).alias("n_usable_recent"),
        F.max_by("date", -F.col("rn")).alias("latest_date"),
    )


def resolve(candidates: DataFrame, filings: DataFrame) -> DataFrame:
    """Candidates of each club with their summary, ``place`` from 1 and ``chosen`` for the first.

    Order: best kind of accounts, more usable recent ones, newest, company number. A candidate
    without accounts has the rank after the last kind.
    """
    df = join_on(candidates, accounts_summary(filings), ["company_number"])
    df = df.withColumn("accounts_filings", F.coalesce("accounts_filings", F.lit(0))).withColumn("best_rank", F.coalesce("best_rank", F.lit(len(ACCOUNTS))))
    df = df.withColumn("n_usable_recent", F.coalesce("n_usable_recent", F.lit(0))).withColumn("recent_descriptions", F.coalesce("recent_descriptions", F.array().cast("array<string>")))
    order = W.partitionBy("club").orderBy("best_rank", F.col("n_usable_recent").desc(), X.date_key(F.col("latest_date")).desc(), "company_number")
    return df.withColumn("place", F.row_number().over(order)).withColumn("chosen", F.col("place") == 1)


def pick_filings(filings: DataFrame, n: int = PER_COMPANY, keys: list[str] = ["company_number"]) -> DataFrame:  # noqa: B006
    """The ``n`` newest periods of each company, the newest usable filing of each, with ``year``.

    Over several clubs name the club among ``keys``: filings without a number are then their club's.

    ``filings``: (keys, type, date, description, transaction_id, made_up_date). A filing without a
    made-up date stands for the period of its own date. Amended accounts never crowd out a year.
    """
    df = filings.filter((F.col("type") == "AA") & F.col("description").isin(USABLE))
    date = F.coalesce("date", F.lit(""))
    df = df.withColumn("_period", F.coalesce(F.nullif(F.col("made_up_date"), F.lit("")), date))
    newest = [date.desc(), F.coalesce("transaction_id", F.lit("")).desc()]
    df = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_period").orderBy(*newest))).filter("_n = 1")
    df = df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*newest))).filter(F.col("place") <= n)
    return df.drop("_n", "_period").withColumn("year", X.year_label(F.col("made_up_date"), F.col("date")))


def filing_links(filings: DataFrame) -> DataFrame:
    """``filings`` with ``document_id`` from ``links.document_metadata``, NULL without a link."""
    return filings.withColumn("document_id", X.last_path_part(F.col("links.document_metadata")))


def manifest_filings(manifest: DataFrame) -> DataFrame:
    """A manifest as filings: every row is of type AA; repeated rows are one."""
    df = manifest.select("club", "company_number", "company_name", F.lit("AA").alias("type"), F.col("filing_date").alias("date"), F.col("accounts_type").alias("description"), "transaction_id", "made_up_date").distinct()
    return df.withColumn("ordinal", F.col("transaction_id"))
