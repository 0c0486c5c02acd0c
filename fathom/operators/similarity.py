"""Term vectors and set similarity of documents, as windows and aggregations on terms.

Documents are rows (group..., doc, tokens array<string>): a model is fitted within each group. All
steps of one group's model are keyed by the group first, so documents that are partitioned by it
(``docs.repartition(*group)``) are counted, weighted and compared without another shuffle. A group is
one entity: its documents are one a year, so it stays small whatever the collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, group: list[str], doc: str = "doc", more: tuple[str, ...] = ()) -> DataFrame:
    """(group, doc, more, term, n). Documents without tokens have no rows."""
    return docs.select(*group, doc, *more, F.explode("tokens").alias("term")).groupBy(*group, doc, *more, "term").agg(F.count("*").alias("n"))


def document_frequencies(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, term, df): documents of the group that hold the term."""
    return counts.groupBy(*group, "term").agg(F.count("*").alias("df"))


def raw_weight(n, df, n_docs):
    """Column: ``(1 + ln n) (ln((1 + n_docs) / (1 + df)) + 1)``."""
    return (1.0 + F.ln(n)) * (F.ln((1.0 + n_docs) / (1.0 + df)) + 1.0)


def tfidf(docs: DataFrame, group: list[str], doc: str = "doc") -> DataFrame:
    """(group, doc, term, weight): sublinear term frequency times smoothed inverse document
    frequency, unit length. ``tf = 1 + ln n``, ``idf = ln((1 + N) / (1 + df)) + 1``; N counts the
    group's documents, also those without tokens. NULL group columns are values like others."""
    sized = docs.withColumn("n_docs", F.count("*").over(W.partitionBy(*group)))
    counts = term_counts(sized, group, doc, ("n_docs",))
    counts = counts.withColumn("df", F.count("*").over(W.partitionBy(*group, "term")))
    raw = counts.select(*group, doc, "term", raw_weight(F.col("n"), F.col("df"), F.col("n_docs")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*group, doc)))
    return raw.withColumn("norm", norm).select(*group, doc, "term", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("weight"))


def consecutive(docs: DataFrame, group: list[str], order: str = "year", doc: str = "doc") -> DataFrame:
    """(group, order_prev, order, doc_prev, doc, n_tokens_prev, n_tokens, cosine, jaccard) of each
    document and the one before it in its group.

    One pass over the terms: a term's row meets the same term of the document before by ``lag`` in
    the term's own window, which also counts the documents that hold it; products, lengths and
    common terms are then one sum per document. Documents without tokens have 0 for both.
    """
    prev, prev_doc = f"{order}_prev", f"{doc}_prev"
    w, every = W.partitionBy(*group).orderBy(order), W.partitionBy(*group)
    lag = lambda c: F.lag(c).over(w)
    placed = docs.select(*group, order, doc, "tokens", F.size("tokens").alias("n_tokens"))
    placed = placed.withColumns({prev: lag(order), prev_doc: lag(doc), "n_tokens_prev": lag("n_tokens"), "n_docs": F.count("*").over(every)})
    keys = [*group, prev, order, prev_doc, doc, "n_tokens_prev", "n_tokens"]
    counts = placed.select(*keys, "n_docs", F.explode_outer("tokens").alias("term")).groupBy(*keys, "n_docs", "term").agg(F.count("term").alias("n"))
    at = W.partitionBy(*group, "term").orderBy(order)
    met = counts.withColumn("before", F.lag(F.struct(F.col(doc).alias("doc"), "n")).over(at)).withColumn("df", F.count("*").over(W.partitionBy(*group, "term")))
    weight = lambda n: F.when(F.col("term").isNotNull(), raw_weight(n, F.col("df"), F.col("n_docs"))).otherwise(0.0)
    both = F.col("term").isNotNull() & F.coalesce(F.col("before.doc") == F.col(prev_doc), F.lit(False))
    own = weight(F.col("n"))
    sums = met.groupBy(*keys).agg(
        F.sum(F.when(both, own * weight(F.col("before.n"))).otherwise(0.0)).alias("dot"),
        F.sqrt(F.sum(own * own)).alias("norm"), F.count("term").alias("terms"), F.count_if(both).alias("common"),
    )
    sums = sums.withColumns({"norm_prev": lag("norm"), "terms_prev": lag("terms")}).filter(F.col(prev_doc).isNotNull())
    length, union = F.col("norm") * F.col("norm_prev"), F.col("terms") + F.col("terms_prev") - F.col("common")
    return sums.select(*keys, F.when(length > 0, F.col("dot") / length).otherwise(0.0).alias("cosine"), F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("jaccard"))


def cosine(pairs: DataFrame, weights: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc_prev, doc, cosine) of any given pairs: the sum of products over common terms, 0 without any."""
    w = weights.select(doc, "term", "weight")
    a = pairs.join(w.select(F.col(doc).alias("doc_prev"), "term", F.col("weight").alias("wa")), "doc_prev")
    both = a.join(w.select(F.col(doc).alias("doc"), "term", F.col("weight").alias("wb")), ["doc", "term"])
    dot = both.groupBy("doc_prev", "doc").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.join(dot, ["doc_prev", "doc"], "left").select("doc_prev", "doc", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def jaccard(a, b):
    """Column: share of common tokens among the distinct tokens of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
