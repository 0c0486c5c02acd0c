"""Session and DataFrame helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without it gets its own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="fathom-shared-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there.

    A lost executor costs nothing that was written, and unlike an RDD checkpoint the table is
    compressed, columnar and has statistics for the joins that follow. Removed by ``release``, at the
    latest when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fathom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` has written, once the results that read them are no longer needed.

    A session that runs many queries calls this between them, or its shared folder fills up. Returns
    how many there were.
    """
    n = len(_written)
    while _written:
        _remove(spark, _written.pop())
    return n


def _at_end() -> None:
    session = SparkSession.getActiveSession()
    if session is not None:
        release(session)


atexit.register(_at_end)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def exact_round(x: Column, digits: int = 6) -> Column:
    """Round a double on its exact binary value, half to even.

    ``round`` and ``bround`` work on the shortest decimal text and differ on ties.
    """
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit("")).cast("double")


def fixed(x: Column, digits: int) -> Column:
    """``x`` as text with so many decimals and no thousands separators."""
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on null-safe equality of ``keys``, which appear once, with the values of ``a``."""
    b = b.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return a.join(b, cond, how).drop(*[f"_right_{k}" for k in keys])
