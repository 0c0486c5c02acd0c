"""Long verbatim spans shared between records.

A "paragraph" here is a stretch of ``span`` characters of the white-space-collapsed text, wherever it
starts, because a copied passage need not respect line or paragraph ends. Its MinHash is the smallest
hash among its grams of ``gram`` characters, and a band is one MinHash under a hash function of its own.
With paragraphs at every position (``stride`` 1) two texts with a common run of ``span`` characters
share a whole paragraph, so already one band has a recall of 1, not a probability. A larger stride
stores fewer grams and finds a run only with some probability, which more bands raise again.

Neighbouring paragraphs mostly have the same MinHash, so only about two in ``span - gram + 2``
positions are stored. Each stored gram knows the one before it (a hash of that gram and the
distance): where two texts agree on both, an earlier gram has already joined them at the same shift.
So a passage joins its texts once, by the grams where it begins, however long it is. Equal texts are
one from the start. Every joined place is verified by its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut

SPAN = 300
GRAM = 150
BASE = 0x9E3779B97F4A7C15 | 1


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over each window of ``width``, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def chosen(codes: np.ndarray, span: int, gram: int, powers: np.ndarray, inverse: np.ndarray, band: int = 0, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are the minimum of some paragraph (all of a tie)."""
    n = len(codes) - gram + 1
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[: len(codes)], out=sums[1:])
    h = (sums[gram:] - sums[:n]) * inverse[:n]
    h ^= np.uint64(band * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width = span - gram + 1
    least = sliding(h, width, np.minimum)
    if stride > 1:
        skipped = np.arange(len(least)) % stride != 0
        least = np.where(skipped, np.uint64(0), least)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    return at, h[at]


def collapse(text: str) -> str:
    return " ".join(text.split())


def normal_texts(reports: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """(id, doc, text) with white space collapsed, of texts that can hold a span. ``doc`` is a hash of
    the collapsed text: equal texts are one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, docs, out = [], [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x and len(y := collapse(x)) >= span:
                    keys.append(k)
                    docs.append(xxhash.xxh3_64_intdigest(y.encode("utf-8", "surrogatepass")) - (1 << 63))
                    out.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(out, pa.string())], names=["id", "doc", "text"])

    return reports.select(F.col(key).cast("long"), text).mapInArrow(run, "id long, doc long, text string")


PRINT = "doc long, hash long, pos int, before long, after long"


def fingerprints(texts: DataFrame, span: int, gram: int, bands: int = 1, stride: int = 1) -> DataFrame:
    """(doc, hash, pos, before, after) of the stored grams of each document. A document that several tasks
    meet gives its rows several times.

    ``before`` and ``after`` name the neighbouring stored gram of the band and its distance; at the ends
    of a text they are unlike any other's.
    """

    def neighbours(h: np.ndarray, at: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
        steps = np.diff(at).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        own = np.uint64((doc * 0x9FB21C651E98DF25 + 1) & (1 << 64) - 1)
        return np.concatenate([[own], h[:-1] * np.uint64(3) + steps]), np.concatenate([h[1:] * np.uint64(5) + steps, [~own]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = inverse = np.zeros(0, np.uint64)
        done: set[int] = set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc in done:
                    continue
                if len(done) < 1_000_000:
                    done.add(doc)  # equal texts in one task are read once
                codes = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                if len(codes) > len(powers):
                    n = max(1 << 16, 1 << len(codes).bit_length())
                    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
                    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)]))
                for band in range(bands):
                    at, h = chosen(codes, span, gram, powers, inverse, band, stride)
                    if not len(at):
                        continue
                    before, after = neighbours(h, at, doc)
                    for column, values in zip(out, (np.full(len(at), doc, np.int64), h.view(np.int64), at.astype(np.int32), before.view(np.int64), after.view(np.int64))):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["doc", "hash", "pos", "before", "after"])

    return texts.select("doc", "text").mapInArrow(run, PRINT)


def meetings(prints: DataFrame, side: str) -> DataFrame:
    """(a, b, shift, pos), a < b: places in a where a stretch common with b begins (``side`` before) or ends
    (after), as far as the stored grams tell. ``shift`` is the distance to the place in b.

    The places of a gram fall into classes by the neighbouring gram. Texts of one class agree on it, too,
    and meet there instead; so only places of different classes are paired, class by class, and a
    gram in the middle of a passage of many texts, which has one class, joins nothing. Which grams
    have several is told by two numbers a gram, combined before they are shuffled.
    """
    rows = prints.select("hash", "doc", "pos", F.col(side).alias("n"))
    several = cut(rows.groupBy("hash").agg(F.min("n").alias("low"), F.max("n").alias("high")).filter("low < high").select("hash"))
    rows = cut(rows.join(several, "hash", "left_semi").distinct())
    classes = rows.select("hash", "n").distinct()
    pairs = classes.withColumnRenamed("n", "n1").join(classes.withColumnRenamed("n", "n2"), "hash").filter("n1 < n2")
    side_ = lambda k: rows.select("hash", F.col("n").alias(f"n{k}"), F.col("doc").alias(f"d{k}"), F.col("pos").alias(f"p{k}"))
    met = pairs.join(side_(1), ["hash", "n1"]).join(side_(2), ["hash", "n2"]).filter("d1 <> d2")
    turned = F.col("d1") > F.col("d2")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    a, b, pos, other = pick("d1", "d2"), pick("d2", "d1"), pick("p1", "p2"), pick("p2", "p1")
    return met.select(a.alias("a"), b.alias("b"), (pos - other).alias("shift"), pos.alias("pos")).distinct()


def around(texts: DataFrame, wanted: DataFrame, before: int, after: int, gram: int) -> DataFrame:
    """(doc, first, last, left, inner, right) for each wanted (doc, first, last): up to ``before`` characters
    before the place ``first``, a 128-bit hash of the characters from there to the end of the gram at
    ``last``, and up to ``after`` characters from ``last`` plus ``gram``.

    Of a text only these are kept; the text itself moves once, by its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            docs, out = [], [[] for _ in range(5)]
            for doc, x, firsts, lasts in zip(*(c.to_pylist() for c in batch.columns)):
                for f, t in zip(firsts, lasts):
                    docs.append(doc)
                    for column, v in zip(out, (f, t, x[max(0, f - before) : f], digest(x[f : t + gram].encode("utf-8", "surrogatepass")), x[t + gram : t + gram + after])):
                        column.append(v)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=["doc", "first", "last", "left", "inner", "right"])

    places = wanted.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("at"))
    some = texts.dropDuplicates(["doc"]).join(places, "doc").select("doc", "text", F.expr("at.first"), F.expr("at.last"))
    return some.mapInArrow(run, "doc long, first int, last int, left string, inner binary, right string")


def agreed(x: str, y: str, at_end: bool) -> int:
    """How many characters ``x`` and ``y`` have in common at their beginning, or at their end: by halves,
    as a longer match holds all shorter ones."""
    n = min(len(x), len(y))
    low, high = 0, n
    while low < high:
        mid = high if high == n and not low else (low + high + 1) // 2
        if (x[len(x) - mid :] == y[len(y) - mid :]) if at_end else (x[:mid] == y[:mid]):
            low = mid
        else:
            high = mid - 1
    return low


def common(x: Column, y: Column, at_end: bool) -> Column:
    """``agreed`` of two columns: one Arrow visit. As expressions, the substrings took 36 CPU seconds for 230,000 rows."""

    @F.arrow_udf("int")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([agreed(u, v, at_end) for u, v in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return count(x, y)


def document_pairs(texts: DataFrame, span: int, gram: int, bands: int = 1, stride: int = 1) -> DataFrame:
    """(a, b), a < b: different documents with a common run of ``span`` characters, each verified by its
    characters around the place where they met."""
    reach = span - gram
    found = cut(meetings(cut(fingerprints(texts, span, gram, bands, stride).drop("after")), "before"))
    ends = found.select(F.col("a").alias("doc"), F.col("pos").alias("first")).unionByName(found.select(F.col("b").alias("doc"), (F.col("pos") - F.col("shift")).alias("first")))
    near = cut(around(texts.select("doc", "text"), ends.withColumn("last", F.col("first")), reach, span, 0))
    side = lambda d, p: near.select(F.col("doc").alias(d), F.col("first").alias(p), F.col("left").alias(f"left_{d}"), F.col("right").alias(f"right_{d}"))
    out = found.withColumn("pos_b", F.col("pos") - F.col("shift")).join(side("a", "pos"), ["a", "pos"]).join(side("b", "pos_b"), ["b", "pos_b"])
    run = common(F.col("left_a"), F.col("left_b"), True) + common(F.col("right_a"), F.col("right_b"), False)
    return out.filter(run >= span).select("a", "b").distinct()


def span_pairs(reports: DataFrame, key: str = "section_id", text: str = "text", span: int = SPAN, gram: int = GRAM, bands: int = 1, stride: int = 1) -> DataFrame:
    """(section_a, section_b): all pairs of records with a common run of ``span`` characters.

    NULL, empty and shorter texts have no pair; a repeated record counts once. Documents are paired
    first; their records are put in at the end, as are the pairs of records with equal texts.
    """
    texts = normal_texts(reports, key, text, span)
    members = cut(texts.select("id", "doc").distinct())
    pairs = document_pairs(texts, span, gram, bands, stride)
    one, two = members.select(F.col("doc").alias("a"), F.col("id").alias("x")), members.select(F.col("doc").alias("b"), F.col("id").alias("y"))
    across = pairs.join(one, "a").join(two, "b").select("x", "y")
    within = one.join(two.withColumnRenamed("b", "a"), "a").filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("section_a"), F.greatest("x", "y").alias("section_b"))


def span_links(reports: DataFrame, key: str = "section_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(u, v): edges that connect records as ``span_pairs`` does, without all its pairs: each record to the
    first of its equal texts, and the firsts of paired documents to each other."""
    texts = normal_texts(reports, key, text, span)
    members = cut(texts.select("id", "doc").distinct())
    first = members.groupBy("doc").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    pairs = document_pairs(texts, span, gram)
    a, b = first.select(F.col("doc").alias("a"), F.col("first").alias("u")), first.select(F.col("doc").alias("b"), F.col("first").alias("v"))
    copies = members.join(first.filter("n > 1"), "doc").filter("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    return pairs.join(a, "a").join(b, "b").select("u", "v").unionByName(copies)


def link_kinds(pairs: DataFrame, reports: DataFrame, drift: DataFrame, key: str = "section_id", entity: tuple[str, ...] = ("club", "company_number")) -> DataFrame:
    """``pairs`` with their kind: successive (one report of an entity and its next available one, by
    ``drift``), edition (two versions of one report), entity, club, or foreign to each other."""
    who = reports.select(key, *entity, "year").dropDuplicates([key])
    side = lambda s: who.select(F.col(key).alias(f"section_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in (*entity, "year")])
    rows = pairs.join(side("a"), "section_a").join(side("b"), "section_b")
    rows = rows.withColumns({"low": F.least("year_a", "year_b"), "high": F.greatest("year_a", "year_b")})
    steps = drift.select(*[F.col(c).alias(f"{c}_d") for c in entity], F.col("year_prev").alias("low"), F.col("year").alias("high"), F.lit(True).alias("step")).distinct()
    same = F.lit(True)
    for c in entity:
        same = same & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    met = rows.alias("r").join(steps.alias("s"), [F.col(f"r.{c}_a").eqNullSafe(F.col(f"s.{c}_d")) for c in entity] + [F.col("r.low") == F.col("s.low"), F.col("r.high") == F.col("s.high")], "left")
    club = F.col(f"{entity[0]}_a").eqNullSafe(F.col(f"{entity[0]}_b"))
    kind = F.when(same & F.col("r.low").eqNullSafe(F.col("r.high")), "edition").when(same & F.col("step"), "successive").when(same, "entity").when(club, "club").otherwise("foreign")
    return met.select("section_a", "section_b", kind.alias("kind"))


def stretches(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc, other, low, high): maximal common runs of ``span`` characters and more, in each of both texts.

    A run begins at a place where texts meet by the gram before and ends where they part by the gram
    after; in the order of their places the k-th beginning belongs to the k-th end. Between the two the
    characters are compared by a 128-bit hash, at the edges one by one.
    """
    reach = span - gram
    prints = cut(fingerprints(texts, span, gram))
    keys = ["a", "b", "shift"]
    ends = [meetings(prints, side).groupBy(*keys).agg(F.sort_array(F.collect_set("pos")).alias(side)) for side in ("before", "after")]
    met = cut(ends[0].join(ends[1], keys).select(*keys, F.explode(F.arrays_zip("before", "after")).alias("c")).select(*keys, F.col("c.before").alias("first"), F.col("c.after").alias("last")).filter("first <= last"))
    b_first, b_last = F.col("first") - F.col("shift"), F.col("last") - F.col("shift")
    wanted = met.select(F.col("a").alias("doc"), "first", "last").unionByName(met.select(F.col("b").alias("doc"), b_first.alias("first"), b_last.alias("last")))
    near = cut(around(texts.select("doc", "text"), wanted, reach, reach, gram))
    side = lambda d: near.select(F.col("doc").alias(d), F.col("first").alias(f"first_{d}"), F.col("last").alias(f"last_{d}"), *[F.col(c).alias(f"{c}_{d}") for c in ("inner", "left", "right")])
    out = met.select("a", "b", F.col("first").alias("first_a"), F.col("last").alias("last_a"), b_first.alias("first_b"), b_last.alias("last_b"))
    out = out.join(side("a"), ["a", "first_a", "last_a"]).join(side("b"), ["b", "first_b", "last_b"]).filter("inner_a = inner_b")
    back, ahead = common(F.col("left_a"), F.col("left_b"), True), common(F.col("right_a"), F.col("right_b"), False)
    out = out.withColumns({"back": back, "ahead": ahead}).filter(F.col("last_a") - F.col("first_a") + F.lit(gram) + F.col("back") + F.col("ahead") >= span)
    ran = lambda d, o: out.select(F.col(d).alias("doc"), F.col(o).alias("other"), (F.col(f"first_{d}") - F.col("back")).alias("low"), (F.col(f"last_{d}") + gram + F.col("ahead")).alias("high"))
    return ran("a", "b").unionByName(ran("b", "a"))


def span_shares(reports: DataFrame, key: str = "section_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per record with non-blank text: (key, n_chars, shared_chars, shared_share, n_partners).

    ``shared_chars`` counts the characters (of the collapsed text) inside runs of at least ``span``
    characters that stand in another record. Records without such a run have 0. A record whose text
    stands in another record, too, is shared as a whole if it is long enough.
    """
    texts = normal_texts(reports, key, text, 1)
    members = cut(texts.select("id", "doc", F.length("text").alias("n_chars")).distinct())
    both = cut(stretches(texts.filter(F.length("text") >= span), span, gram))
    ranges = both.groupBy("doc", "low").agg(F.max("high").alias("high")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("s"))
    merged = ranges.select("doc", F.expr("aggregate(s, struct(0 as n, 0 as done), (x, r) -> struct(x.n + greatest(r.high - greatest(r.low, x.done), 0) as n, greatest(x.done, r.high) as done)).n").alias("shared"))
    copies = members.groupBy("doc").agg(F.count("*").alias("copies"), F.max("n_chars").alias("chars"))
    partners = both.select("doc", "other").distinct().join(copies.select(F.col("doc").alias("other"), "copies"), "other").groupBy("doc").agg(F.sum("copies").alias("partners"))
    docs = copies.join(merged, "doc", "left").join(partners, "doc", "left")
    again = (F.col("copies") > 1) & (F.col("chars") >= span)
    docs = docs.select("doc", F.when(again, F.col("chars")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared_chars"), (F.coalesce("partners", F.lit(0)) + F.when(again, F.col("copies") - 1).otherwise(0)).alias("n_partners"))
    return members.join(docs, "doc").select(F.col("id").alias(key), "n_chars", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("shared_share"), "n_partners")
