"""Lines that one source repeats over many of its documents.

Lines get identifiers; those that stand on too few pages cannot be part of a repeated block and
separate runs of lines that can. What remains of a source is one long text over line identifiers, and
its suffix array is built the distributed way, by prefixes of doubling length (Karp, Miller and
Rosenberg): suffixes with an equal prefix form a group, which is an interval of the array, and its
number of pages one sum by the prefix's hash. For each suffix a binary search over the length finds
the longest prefix on enough pages. No source, line or block is ever gathered in one task, equal
sequences of lines are one with their number of pages, and the result has no parameter of the layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import cut

MIN_PAGES = 5
MIN_SHARE = 5  # at least one page in so many


def line_list(text: str) -> list[str]:
    """Non-blank lines, trimmed, white-space runs as one blank."""
    return [y for x in text.split("\n") if (y := " ".join(x.split()))]


def page_lines(pages: DataFrame, source: str, key: str, text: str) -> DataFrame:
    """(key, source, source_id, lines): identifiers of a page's lines in order, one row per page.

    An identifier is a 64-bit hash of source and line; blank lines have none. Pages without text have no lines but count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            sources, out = batch.column(1).to_pylist(), []
            for s, x in zip(sources, batch.column(2).to_pylist()):
                seed = digest(s)
                out.append([digest(y, seed) - (1 << 63) for y in line_list(x)] if x else [])
            seeds = pa.array([digest(s) - (1 << 63) for s in sources], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), seeds, pa.array(out, pa.list_(pa.int64()))], names=["key", "source_id", "lines"])

    rows = pages.filter(F.col(source).isNotNull()).select(F.col(key).cast("long").alias("key"), source, text)
    return rows.mapInArrow(run, "key long, source_id long, lines array<long>").dropDuplicates(["key"])


def sequence_id() -> Column:
    """Hash of a sequence; its gaps count, which a hash of NULLs would pass over."""
    return F.xxhash64("source_id", F.transform("seq", lambda x: F.coalesce(x, F.lit(0))))


class Repeats:
    """The repeated blocks of all sources.

    ``frequent``: (source_id, line_id, n, page, pages), lines that stand on enough pages, with one page
    that holds each. ``runs``: (key, seq, at), a page's frequent lines in order, NULL where another
    line stands between, and their places among the page's lines. ``suffixes``: (sid, source_id, i,
    rest, length, n_pages): of each distinct sequence and place the lines that follow in its run and
    how many of them form the longest block on enough pages.
    """

    def __init__(self, pages: DataFrame, source: str = "club", key: str = "page_id", text: str = "text", min_pages: int = MIN_PAGES, min_share: int = MIN_SHARE):
        """Enough are ``min_pages`` pages and a ``min_share``-th of all pages of the source, where a page
        with NULL or empty text counts, too, and one without a source does not."""
        listed = cut(page_lines(pages, source, key, text))
        totals = listed.groupBy("source_id").agg(F.count("*").alias("pages"))
        counted = listed.select("key", "source_id", F.explode(F.array_distinct("lines")).alias("line_id"))
        counted = counted.groupBy("source_id", "line_id").agg(F.count("*").alias("n"), F.min("key").alias("page")).filter(F.col("n") >= min_pages)
        self.frequent = cut(counted.join(totals, "source_id").filter(F.col("n") * min_share >= F.col("pages")))
        need = F.greatest(F.lit(float(min_pages)), F.col("pages") / F.lit(float(min_share)))
        marks = self.frequent.select("line_id", "n", need.alias("need"))
        hits = listed.select("key", "source_id", F.posexplode("lines").alias("i", "line_id")).join(marks, "line_id")
        runs = hits.groupBy("key", "source_id").agg(F.max("need").alias("need"), F.sort_array(F.collect_list(F.struct("i", "line_id", "n"))).alias("hits"))
        gaps = F.expr("flatten(transform(hits, (x, k) -> if(k > 0 and hits[k - 1].i < x.i - 1, array(null, x.line_id), array(x.line_id))))")
        self.runs = cut(runs.select("key", "source_id", "need", gaps.alias("seq"), F.expr("transform(hits, x -> x.i)").alias("at"), F.expr("map_from_entries(array_distinct(transform(hits, x -> struct(x.line_id, x.n))))").alias("n_of")))
        self.suffixes = self.longest()

    def longest(self) -> DataFrame:
        sequences = self.runs.groupBy("source_id", "seq").agg(F.count("*").alias("w"), F.max("need").alias("need"), F.max_by(F.struct("n_of"), "key").alias("c"))
        each = sequences.select(sequence_id().alias("sid"), "source_id", "w", "need", "c.n_of", "seq", F.posexplode("seq").alias("i", "line_id")).filter("line_id is not null")
        end = F.expr("coalesce(nullif(array_position(transform(slice(seq, i + 1, size(seq)), x -> x is null), true), 0) - 1, size(seq) - i)")
        rows = each.select("sid", "source_id", "i", "w", "need", F.expr("n_of[line_id]").alias("n_pages"), F.slice("seq", F.col("i") + 1, end.cast("int")).alias("rest"), F.lit(1).alias("length"))
        rows = cut(rows)
        most = rows.agg(F.max(F.size("rest"))).first()[0] or 0
        step = 1 << max(most - 1, 0).bit_length() >> 1
        while step:
            # A block is on enough pages only if its beginnings are, so each suffix tries one length; it also
            # counts for the shorter lengths that others with the same beginning try in this step.
            lengths = F.expr(f"if(size(rest) > {step}, filter(sequence({1 + step}, size(rest), {2 * step}), c -> c <= length + {step}), array())")
            counts = rows.select("sid", "w", "need", F.explode(F.transform(lengths, lambda c: F.xxhash64("source_id", F.slice("rest", F.lit(1), c)))).alias("k"))
            tried = rows.withColumn("k", F.when(F.size("rest") >= F.col("length") + step, F.xxhash64("source_id", F.slice("rest", F.lit(1), F.col("length") + step))))
            counts = counts.groupBy("k", "sid").agg(F.max("w").alias("w"), F.max("need").alias("need"))
            counts = counts.groupBy("k").agg(F.sum("w").alias("more"), F.max("need").alias("least")).filter("more >= least").select("k", "more")
            tried = tried.join(counts, "k", "left")
            rows = cut(tried.select("sid", "source_id", "i", "w", "need", F.coalesce("more", "n_pages").alias("n_pages"), "rest", (F.col("length") + F.when(F.col("more").isNotNull(), step).otherwise(0)).alias("length")))
            step >>= 1
        return rows.select("sid", "source_id", "i", "rest", "length", "n_pages")

    def blocks(self) -> DataFrame:
        """(source_id, block, n_pages): every block that stands somewhere without being a part of a
        longer one on enough pages. All frequent lines are in some block."""
        before = W.partitionBy("sid").orderBy("i")
        rows = self.suffixes.withColumn("last", F.lag(F.struct("i", "length")).over(before))
        inside = F.coalesce((F.col("last.i") == F.col("i") - 1) & (F.col("last.length") > F.col("length")), F.lit(False))
        return rows.filter(~inside).select("source_id", F.slice("rest", F.lit(1), F.col("length")).alias("block"), "n_pages").distinct()

    def occurrences(self, least: int = 1) -> DataFrame:
        """(key, drop): the places of a page's lines that lie in a block of ``least`` lines or more."""
        long = self.suffixes.filter(F.col("length") >= least).groupBy("sid").agg(F.collect_list(F.struct("i", "length")).alias("found"))
        pages = self.runs.withColumn("sid", sequence_id()).join(long, "sid")
        covered = F.expr("filter(sequence(0, size(seq) - 1), p -> seq[p] is not null and exists(found, b -> b.i <= p and p < b.i + b.length))")
        # the k-th line of a sequence that is no gap stands at the k-th place
        place = F.expr("transform(covered, p -> at[p - size(filter(slice(seq, 1, p + 1), x -> x is null))])")
        return pages.withColumn("covered", covered).select("key", place.alias("drop"))


def block_lines(found: Repeats, pages: DataFrame, source: str = "club", key: str = "page_id", text: str = "text") -> DataFrame:
    """(line_id, source, line): the text of every line that is in a block."""
    lines = found.blocks().select(F.explode("block").alias("line_id")).distinct().join(found.frequent.select("line_id", "page"), "line_id")
    wanted = lines.groupBy("page").agg(F.collect_list("line_id").alias("wanted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, a, b = [], [], []
            for s, x, want in zip(*(c.to_pylist() for c in batch.columns)):
                seed, want = digest(s), set(want)
                for y in line_list(x):
                    if (k := digest(y, seed) - (1 << 63)) in want:
                        ids.append(k)
                        a.append(s)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["line_id", "source", "line"])

    some = pages.select(F.col(key).cast("long").alias("page"), source, text).join(wanted, "page").select(source, text, "wanted")
    return some.mapInArrow(read, "line_id long, source string, line string").distinct()


def repeated_lines(pages: DataFrame, source: str = "club", key: str = "page_id", text: str = "text", min_pages: int = MIN_PAGES, min_share: int = MIN_SHARE) -> DataFrame:
    """(source, line): every line of a repeated block, in its collapsed form. Pages whose source is
    NULL belong to no source and give no line."""
    found = Repeats(pages, source, key, text, min_pages, min_share)
    return block_lines(found, pages, source, key, text).select(F.col("source").alias(source), "line").distinct()


def repeated_blocks(pages: DataFrame, source: str = "club", key: str = "page_id", text: str = "text", least: int = 2, min_pages: int = MIN_PAGES, min_share: int = MIN_SHARE) -> DataFrame:
    """(source, lines, n_lines, n_pages): blocks of ``least`` or more lines, their lines joined by line
    ends, with the number of pages they stand on."""
    found = Repeats(pages, source, key, text, min_pages, min_share)
    blocks = cut(found.blocks().filter(F.size("block") >= least).withColumn("b", F.xxhash64("source_id", "block")))
    texts = block_lines(found, pages, source, key, text)
    rows = blocks.select("b", "n_pages", F.posexplode("block").alias("i", "line_id")).join(texts, "line_id")
    rows = rows.groupBy("b", "n_pages", "source").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("l"))
    return rows.select(F.col("source").alias(source), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"), F.size("l").alias("n_lines"), "n_pages")


def without_repeated_lines(pages: DataFrame, source: str = "club", key: str = "page_id", text: str = "text", least: int = 1, min_pages: int = MIN_PAGES, min_share: int = MIN_SHARE) -> DataFrame:
    """(key, source, text, n_removed): each page once, without its occurrences of repeated blocks of
    ``least`` or more lines.

    Other lines stay as stored. A NULL text stays NULL; pages without a source are unchanged. A text
    moves once, by its key, to meet the places of its own lines.
    """
    drop = Repeats(pages, source, key, text, min_pages, min_share).occurrences(least)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for x, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n = 0
                if x and drop:
                    places, left, at = set(drop), [], 0
                    for row in x.split("\n"):
                        if row.split():
                            if at not in places:
                                left.append(row)
                            at += 1
                        else:
                            left.append(row)
                    n, x = len(places), "\n".join(left)
                texts.append(x)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["key", "source", "text", "n_removed"])

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).dropDuplicates(["key"])
    out = rows.join(drop, "key", "left").select("key", "source", "text", "drop").mapInArrow(clean, "key long, source string, text string, n_removed int")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), F.col("text").alias(text), "n_removed")
