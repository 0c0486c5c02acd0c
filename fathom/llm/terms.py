"""How distinctive a term is for a record, from its two-by-two contingency table.

For a term of a record: how often it stands in the record and in the rest of the collection, against
all other tokens of both. Dunning's log-likelihood ratio G2 tests the table; ``weight`` is the count
times the log of the inverse share of records that hold the term.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut

# Figures with currency and percent signs, and the shape of a token.
FIGURE = r"[£$€]?\d[\d,.]*%?"
TOKEN = r"[a-z][a-z'’-]*"


def term_lists(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_tokens, terms array<struct<term, n>>), one row per key with non-empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figure, token = re.compile(FIGURE), re.compile(TOKEN)
        shape = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())]))
        for batch in batches:
            totals, starts, terms, counts = [], [0], [], []
            for x in batch.column(1).to_pylist():
                found = Counter(token.findall(figure.sub(" ", x.lower())))
                terms += found.keys()
                counts += found.values()
                starts.append(len(terms))
                totals.append(found.total())
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["term", "n"])
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), lists.cast(shape)], names=["key", "n_tokens", "terms"])

    rows = docs.filter((F.col(text).isNotNull()) & (F.col(text) != "")).select(F.col(key).cast("long"), text)
    return rows.mapInArrow(run, "key long, n_tokens long, terms array<struct<term:string,n:int>>").dropDuplicates(["key"])


def ratio(n: Column, tokens: Column, total_n: Column, total: Column) -> Column:
    """G2 of the table; negative where the term is rarer in the record than elsewhere."""
    rest = total - tokens
    cells = [
        (n, tokens * total_n / total),
        (total_n - n, rest * total_n / total),
        (tokens - n, tokens * (total - total_n) / total),
        (rest - total_n + n, rest * (total - total_n) / total),
    ]
    g2 = sum((F.when(o > 0, o * F.ln(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0)) * 2
    return F.when(n * rest < (total_n - n) * tokens, -g2).otherwise(g2)


def term_scores(docs: DataFrame, key: str = "section_id", text: str = "text") -> DataFrame:
    """(key, term, n, n_tokens, n_docs, n_total, weight, g2) for each term of each record.

    ``n_docs``: records with the term, ``n_total``: its count in the collection,
    ``weight = n * ln(N / n_docs)``. A repeated key is one record; NULL and empty texts are none, a
    text without tokens counts in N only.

    Terms are counted inside each record first; collection counts are pre-aggregated before their
    shuffle, and join back to the terms by term (a term of every record is a skewed key, which the
    adaptive join splits).
    """
    lists = cut(term_lists(docs, key, text))
    whole = lists.agg(F.count("*"), F.sum("n_tokens")).first()
    n_all, tokens_all = whole[0], whole[1] or 0
    rows = lists.select("key", "n_tokens", F.explode("terms").alias("t")).select("key", "n_tokens", "t.term", "t.n")
    totals = rows.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_total"))
    out = rows.join(totals, "term")
    weight = F.col("n") * F.ln(F.lit(float(n_all)) / F.col("n_docs"))
    g2 = ratio(F.col("n").cast("double"), F.col("n_tokens").cast("double"), F.col("n_total").cast("double"), F.lit(float(tokens_all)))
    return out.select(F.col("key").alias(key), "term", "n", "n_tokens", "n_docs", "n_total", weight.alias("weight"), g2.alias("g2"))


def most_distinctive(scores: DataFrame, key: str = "section_id", by: str = "weight", min_tokens: int = 200) -> DataFrame:
    """(key, term): the best term of each record of enough tokens; the first in the alphabet on a tie."""
    best = scores.filter(F.col("n_tokens") >= min_tokens).groupBy(key).agg(F.min(F.struct((-F.col(by)).alias("s"), "term")).alias("best"))
    return best.select(key, "best.term")
