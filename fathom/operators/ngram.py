"""Interpolated Kneser-Ney surprisal of one document under a model of another, relationally.

The highest order (3) uses counts, the lower orders numbers of distinct preceding words; each order
backs off to the next with the mass that the discount frees, order 1 to a uniform distribution.

Model and probe trigrams meet in one table, shuffled once by the model's document. Every table of
the model is then a window over a prefix of the words: since all windows start with the document,
none needs another shuffle, and three sorts serve them all. Equal trigrams of a document are counted
first, so a frequent word multiplies no rows. A partition holds whole documents, never a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DISCOUNT = 0.75
START, END = "<s>", "</s>"


def trigrams(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, w1, w2, w3, c) over the tokens with two start pads and an end marker.

    Words are 64-bit hashes: within one document's vocabulary they are as good as the words.
    """
    seq = F.transform(F.concat(F.array(F.lit(START), F.lit(START)), F.col("tokens"), F.array(F.lit(END))), lambda w: F.xxhash64(w))
    at = F.expr("transform(sequence(0, size(_s) - 3), i -> struct(_s[i] as w1, _s[i + 1] as w2, _s[i + 2] as w3))")
    grams = docs.select(doc, seq.alias("_s")).select(doc, F.explode(at).alias("g"))
    return grams.groupBy(F.col(doc).alias("doc"), "g.w1", "g.w2", "g.w3").agg(F.count("*").alias("c"))


def surprisal(pairs: DataFrame, docs: DataFrame, doc: str = "doc", discount: float = DISCOUNT) -> DataFrame:
    """(doc_prev, doc, bits): mean surprisal in bits of ``doc`` under the model of ``doc_prev``.

    Pairs of (doc_prev, doc) keys of ``docs`` (key, tokens). A document without tokens still has
    its end marker to predict.
    """
    grams = trigrams(docs, doc)
    words = ["w1", "w2", "w3", "c"]
    models = grams.join(pairs.select(F.col("doc_prev").alias("doc")).distinct(), "doc", "left_semi")
    models = models.select(F.col("doc").alias("m"), F.lit(None).cast(grams.schema["doc"].dataType).alias("d"), *words)
    probes = grams.join(pairs.select("doc_prev", "doc"), "doc").select(F.col("doc_prev").alias("m"), F.col("doc").alias("d"), *words)
    rows = models.unionByName(probes).repartition("m").withColumn("own", F.col("d").isNull().cast("int"))

    def over(*keys: str) -> W:
        return W.partitionBy("m", *keys)

    total = lambda c, *keys: F.sum(c).over(over(*keys))
    own, own_c = F.col("own"), F.col("own") * F.col("c")
    rows = rows.withColumn("c3", total(own_c, "w1", "w2", "w3"))
    rows = rows.withColumn("d3", total(own_c, "w1", "w2")).withColumn("f3", total(own, "w1", "w2"))
    # the model's rows of (w2, w3) are its distinct preceding words; the first of them stands for the bigram
    first = F.row_number().over(over("w2", "w3").orderBy(F.col("own").desc(), "w1")) == 1
    rows = rows.withColumn("n2", total(own, "w2", "w3")).withColumn("bigram", (first & (own == 1)).cast("int"))
    rows = rows.withColumn("d2", total(own, "w2")).withColumn("f2", total(F.col("bigram"), "w2"))
    word = F.row_number().over(over("w3").orderBy(F.col("own").desc(), "w2", "w1")) == 1
    rows = rows.withColumn("n1", total(F.col("bigram"), "w3")).withColumn("word", (word & (own == 1)).cast("int"))
    # the pair of start pads is one more bigram, and the pad one more word that follows something
    rows = rows.withColumn("d1", total(F.col("bigram")) + 1).withColumn("v", total(F.col("word")) + 1)
    probe = rows.filter("own = 0")

    d = F.lit(discount)
    more = lambda c: F.greatest(F.col(c) - d, F.lit(0.0))

    def backed(n: str, total: str, follow: Column, lower: Column) -> Column:
        return F.when(F.col(total) == 0, lower).otherwise(more(n) / F.nullif(F.col(total), F.lit(0)) + d * follow / F.nullif(F.col(total), F.lit(0)) * lower)

    p1 = backed("n1", "d1", F.col("v"), 1.0 / F.col("v"))
    p3 = backed("c3", "d3", F.col("f3"), backed("n2", "d2", F.col("f2"), p1))
    bits = -F.log2(F.greatest(p3, 1.0 / (F.col("v") * 64)))
    mean = F.sum(bits * F.col("c")) / F.sum("c")
    return probe.groupBy(F.col("m").alias("doc_prev"), F.col("d").alias("doc")).agg(mean.alias("bits"))
