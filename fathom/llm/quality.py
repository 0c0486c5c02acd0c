"""Per-document text statistics that tell prose from lists, tables and rubbish.

The statistics need several counts over the characters and words of one text; as SQL expressions each
is a regular-expression pass of its own (measured: seven times the time), so one Arrow function takes
them all in a single visit. Percentiles come from mergeable quantile sketches (KLL) of each statistic
per group (language or collection): no group is ever sorted or collected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\W\d_]+"

# Function words of English accounts prose.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "a", "for", "is", "on", "by", "with", "as", "at", "from", "that", "was", "be", "are", "or", "this")
STATISTICS = ("function_share", "symbol_share", "mean_token", "stop_line_share")
# Limits of the tails: statistic to (low, high). A NULL statistic is in its tail if named in NULL_FLAGS.
LIMITS = {"function_share": (0.15, None), "symbol_share": (None, 0.25), "mean_token": (3.2, 8.5), "stop_line_share": (0.02, None)}
NULL_FLAGS = ("function_share",)
PERCENTILES = 200


# Words that count as common in a language: so many of its most frequent ones.
COMMON, PARTS = 20, 64


def common_words(docs: DataFrame, group: str, text: str = "text", n: int = COMMON) -> dict[str | None, frozenset[str]]:
    """The ``n`` most frequent words of each language of the collection, ties by the alphabet.

    Counted in each batch first. The best of each of ``PARTS`` parts of a vocabulary come first, then the
    best of those, so no language's vocabulary is in one task. What comes back is ``n`` words a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(WORD).findall
        for batch in batches:
            total: Counter[tuple[str | None, str]] = Counter()
            for g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x:
                    for w, k in Counter(words(x.lower())).items():
                        total[g, w] += k
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in total], pa.string()), pa.array([w for _, w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["g", "w", "k"])

    rows = docs.select(F.col(group).cast("string"), text).mapInArrow(count, "g string, w string, k long").groupBy("g", "w").agg(F.sum("k").alias("k"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(PARTS)))
    for keys in (["g", "part"], ["g"]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("k").desc(), "w"))
        rows = rows.withColumn("place", place).filter(F.col("place") <= n).drop("place")
    out: dict[str | None, set[str]] = {}
    for r in rows.collect():
        out.setdefault(r["g"], set()).add(r["w"])
    return {g: frozenset(ws) for g, ws in out.items()}


def measure(batches: Iterator[pa.RecordBatch], at: int = -1, lists: dict[str | None, frozenset[str]] | None = None) -> Iterator[pa.RecordBatch]:
    """Counts of each text, whose column is the last; the other columns pass through.

    With ``lists`` the common words are those of the group in column ``at``, and words are runs of any letters.
    """
    letters = bytes(range(65, 91)) + bytes(range(97, 123))
    runs = re.compile("[a-z]+" if lists is None else WORD).findall
    english = frozenset(FUNCTION_WORDS)
    for batch in batches:
        keep, out = [], [[] for _ in range(7)]
        groups = None if lists is None else batch.column(at).to_pylist()
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            function = english if lists is None else lists.get(groups[i], frozenset())
            tokens = text.split() if text else None
            if not tokens:
                continue
            solid = "".join(tokens)
            raw = solid.encode("utf-8", "surrogatepass")
            words = runs(text.lower())
            lines = stops = 0
            for line in text.split("\n"):
                line = line.rstrip()
                if line:
                    lines += 1
                    stops += line[-1] in ".!?"
            keep.append(i)
            row = (len(tokens), len(solid), len(raw) - len(raw.translate(None, letters)), len(words), sum(map(function.__contains__, words)), lines, stops)
            for column, x in zip(out, row):
                column.append(x)
        keys = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:-1]]
        names = ["n_tokens", "n_solid", "n_letters", "n_words", "n_function", "n_lines", "n_stops"]
        yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x, pa.int32()) for x in out]], names=[*batch.schema.names[:-1], *names])


def flags(limits: dict[str, tuple[float | None, float | None]] = LIMITS) -> Column:
    """How many statistics lie in a tail."""
    total = F.lit(0)
    for name, (low, high) in limits.items():
        hit = F.lit(False)
        if low is not None:
            hit = hit | (F.col(name) < low)
        if high is not None:
            hit = hit | (F.col(name) > high)
        total = total + F.coalesce(hit, F.lit(name in NULL_FLAGS)).cast("int")
    return total


def text_statistics(docs: DataFrame, keys: list[str], text: str = "text", limits: dict = LIMITS, language: str | None = None) -> DataFrame:
    """``keys``, the statistics and ``n_flags`` for every text with at least one token.

    ``n_tokens`` white-space tokens; ``function_share`` share of function words among ``[a-z]+``
    runs (NULL without such a run; with a ``language`` column among the keys: the share of that language's
    own most frequent words among all words); ``symbol_share`` share of characters that are not ASCII letters
    among those that are not white space; ``mean_token`` characters per token; ``stop_line_share``
    share of non-blank lines that end in ``.``, ``!`` or ``?``.

    Rows that repeat a key are one record (they carry the same text). NULL, empty and blank texts
    give no row. Texts are measured whole and never shuffled; only keys and numbers are.
    """
    source = docs.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *(f"{n} int" for n in ("n_tokens", "n_solid", "n_letters", "n_words", "n_function", "n_lines", "n_stops"))])
    run = measure
    if language is not None:
        lists, at = common_words(docs, language, text), keys.index(language)
        run = lambda batches: measure(batches, at, lists)
    counted = source.mapInArrow(run, schema).dropDuplicates(keys)
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    stats = counted.select(
        *keys,
        "n_tokens",
        share("n_function", "n_words").alias("function_share"),
        ((F.col("n_solid") - F.col("n_letters")) / F.col("n_solid")).alias("symbol_share"),
        share("n_solid", "n_tokens").alias("mean_token"),
        share("n_stops", "n_lines").alias("stop_line_share"),
    )
    return stats.withColumn("n_flags", flags(limits))


def tail_report(stats: DataFrame, group: str, low: float = 0.05, high: float = 0.95, names: tuple[str, ...] = STATISTICS) -> DataFrame:
    """Each record with the percentile of every statistic in its group, its robust z-score and a tail flag.

    The z-score is the distance from the group's median over its interquartile range as a normal law's
    standard deviation, both from the sketch; NULL where that range is 0.

    One KLL sketch per group and statistic is merged over all partitions (a few kB each); its
    ``PERCENTILES`` cut points join back by group. Percentiles are within the sketch's rank error
    (under 1 %). ``<name>_tail`` is -1, 0 or 1; a NULL statistic has a NULL percentile and tail 0.
    """
    cuts = ", ".join(f"{k / PERCENTILES}D" for k in range(1, PERCENTILES))
    parts = stats.groupBy(F.col(group).alias("_g")).agg(*[F.expr(f"kll_sketch_agg_double({n}, 800)").alias(n) for n in names])
    # an empty sketch (a statistic that is NULL throughout a group) has no cut points
    parts = parts.select("_g", *[F.expr(f"if(kll_sketch_get_n_double({n}) > 0, kll_sketch_get_quantile_double({n}, array({cuts})), null)").alias(f"_{n}") for n in names])
    out = stats.join(parts, stats[group].eqNullSafe(parts["_g"]), "left").drop("_g")
    for n in names:
        below = F.expr(f"size(filter(_{n}, q -> q < {n}))") / F.lit(float(PERCENTILES))
        out = out.withColumn(f"{n}_pct", F.when(F.col(n).isNotNull(), below))
        at = lambda q: F.get(F.col(f"_{n}"), F.lit(int(q * PERCENTILES) - 1))  # noqa: B023, E731
        out = out.withColumn(f"{n}_z", (F.col(n) - at(0.5)) / F.nullif((at(0.75) - at(0.25)) / F.lit(1.349), F.lit(0.0)))
        out = out.withColumn(f"{n}_tail", F.coalesce(F.when(F.col(f"{n}_pct") < low, -1).when(F.col(f"{n}_pct") > high, 1), F.lit(0)))
    return out.drop(*[f"_{n}" for n in names])
