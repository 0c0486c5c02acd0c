"""Keyed upserts and cache tests for incremental runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import join_on
from .sections import latest

# Settings that page text must have been made with.
DPI, PSM, METHOD = 200, 3, 2


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Old rows with those of ``new`` over them, key by key: newer wins, then ``order``.

    Repeated keys within one side keep their first row by ``order`` (default: all columns
    descending, so the result does not depend on row order). Missing columns become NULL.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = order or [F.col(c).desc_nulls_last() for c in both.columns if c not in (*keys, "_side")]
    return latest(both, keys, F.col("_side").desc(), *rest).drop("_side")


def stale_reason(dpi: int = DPI, psm: int = PSM, method: int = METHOD) -> Column:
    """Why cached text does not match the settings, or NULL: unreadable, dpi, psm, method."""
    said = lambda name, now: F.concat(F.lit(f"{name} "), F.coalesce(F.col(c := {"method": "method_version"}.get(name, name)).cast("string"), F.lit("None")), F.lit(f" != {now}"))
    differs = lambda c, now: ~F.col(c).eqNullSafe(F.lit(now))
    return F.when(F.coalesce("unreadable", F.lit(False)), "unreadable cache").when(differs("dpi", dpi), said("dpi", dpi)).when(differs("psm", psm), said("psm", psm)).when(differs("method_version", method), said("method", method))


def work_list(wanted: DataFrame, cached: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """``wanted`` rows still to be done, with the ``reason``: missing, or why the cache is stale.

    A stale method alone leaves the text usable: ``reuse_text`` says that only the later step is due.
    """
    state = cached.select(*keys, F.lit(True).alias("_there"), stale_reason().alias("_stale"))
    df = join_on(wanted, state, keys)
    reason = F.when(F.col("_there").isNull(), "missing").when(F.lit(force), "forced").otherwise(F.col("_stale"))
    df = df.withColumn("reason", reason).filter("reason is not null")
    return df.withColumn("reuse_text", F.col("reason").startswith("method ")).drop("_there", "_stale")


def not_yet(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` rows whose key is not in ``done``. NULL keys match each other."""
    mark = done.select(*keys).distinct().withColumn("_done", F.lit(True))
    return join_on(wanted, mark, keys).filter("_done is null").drop("_done")


def complete(clubs: DataFrame, entities: DataFrame, files: DataFrame, per_club: int = 3) -> DataFrame:
    """One row ``complete``: the same clubs on both sides, each with a chosen entity and at least
    ``per_club`` non-empty files. ``files``: (club, bytes). Without clubs it is not complete."""
    have = files.filter("bytes > 0").groupBy("club").agg(F.count("*").alias("n"))
    picked = entities.groupBy("club").agg(F.bool_or(F.col("chosen")).alias("chosen"))
    df = clubs.select("club").distinct().withColumn("known", F.lit(True)).join(picked, "club", "full").join(have, "club", "left")
    ok = F.col("known") & F.coalesce("chosen", F.lit(False)) & (F.coalesce("n", F.lit(0)) >= per_club)
    return df.agg(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("complete"))
