"""Files in and out: page text of PDFs and scans, JSON and CSV tables with blank kept apart from 0."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.frames import cut
from ..operators.cache import not_yet
from ..operators.sections import keep_better, split_tables

PAGES = "path string, page int, text string, source string"


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on whatever file system the pattern names; none if nothing does."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    some = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(x.getPath().toString() for x in some or [])


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-string CSV with a header; blank is NULL; a missing file is an empty table."""
    if not found(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="", emptyValue="")


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """CSV folder with a header, fixed columns and order; NULL is blank."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_json(value: object, path: str) -> None:
    """Sorted keys, two blanks, UTF-8, final line end. For report-sized values."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def read_json(path: str) -> object:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def json_table(df: DataFrame, path: str) -> None:
    """One JSON object a row, keys in sorted order, in parallel."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def parsed_filings(spark: SparkSession, pattern: str) -> DataFrame:
    """Parsed-filing JSON documents of a path pattern as (club, year, section, text)."""
    schema = "club string, year string, company_number string, flags array<string>, sections map<string,string>"
    docs = spark.read.schema(schema).json(pattern, multiLine=True)
    return docs.select("club", "company_number", "year", "flags", F.explode("sections").alias("section", "text"))


def has_parsed_filings(spark: SparkSession, folder: str) -> bool:
    """Whether ``folder`` holds any parsed filing, as ``<club>/<year>.json``; placeholders do not count."""
    return bool(found(spark, f"{folder}/*/*.json"))


def club_years(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(club, year) of every parsed filing in ``folder``, in order. Names are listed, no file is read."""
    return sorted((x.rsplit("/", 2)[1], x.rsplit("/", 1)[1].removesuffix(".json")) for x in found(spark, f"{folder}/*/*.json"))


def cached_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """Cached page texts as (club, year, page, text), pages from 0, in their order."""
    docs = spark.read.schema("club string, year string, pages array<string>").json(pattern, multiLine=True)
    return docs.select("club", "year", F.posexplode("pages").alias("page", "text"))


def cache_settings(spark: SparkSession, pattern: str) -> DataFrame:
    """What cached texts were made with; a file that is no JSON is ``unreadable``."""
    rows = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "club string, year string, dpi int, psm int, method_version int, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("m"))
    return rows.select("path", "m.club", "m.year", "m.dpi", "m.psm", "m.method_version", F.col("m._corrupt").isNotNull().alias("unreadable"))


def text_layer(content: bytes) -> list[str]:
    """Text of each page of a PDF; a page that fails is ''. Needs pdfplumber."""
    import io

    import pdfplumber

    out = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            try:
                out.append(page.extract_text() or "")
            except Exception:
                out.append("")
    return out


def pdf_pages(spark: SparkSession, pattern: str, read: Callable[[bytes], list[str]] = text_layer) -> DataFrame:
    """(path, page, text, source) of PDF files, pages from 0. An unreadable file gives one row with
    page NULL and source unreadable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, i, t, "text_layer") for i, t in enumerate(read(bytes(content)))]
                except Exception:
                    rows.append((path, None, None, "unreadable"))
            frame = pd.DataFrame(rows, columns=["path", "page", "text", "source"])
            yield frame.astype({"page": "Int32"})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, PAGES)


def engine_version(engine: str = "tesseract") -> str:
    """First line of the engine's version, "unknown" if it is missing."""
    if shutil.which(engine) is None:
        return "unknown"
    said = subprocess.run([engine, "--version"], capture_output=True, text=True)
    return (said.stdout or said.stderr).splitlines()[0] if said.returncode == 0 else "unknown"


def command_reader(engine: str = "tesseract", psm: int = 3) -> Callable[[bytes], str]:
    """A page reader over an OCR command: image bytes in, text out, '' if it fails.

    One thread per process: the tasks are the parallelism.
    """

    def read(image: bytes) -> str:
        with tempfile.NamedTemporaryFile(suffix=".png") as f:
            f.write(image)
            f.flush()
            said = subprocess.run([engine, f.name, "stdout", "--psm", str(psm)], capture_output=True, text=True, env=dict(os.environ, OMP_THREAD_LIMIT="1"))
        return said.stdout if said.returncode == 0 else ""

    return read


def page_images(content: bytes, dpi: int = 200) -> list[bytes]:
    """PNG of each page. Needs pypdfium2."""
    import io

    import pypdfium2

    pdf, out = pypdfium2.PdfDocument(content), []
    for page in pdf:
        buffer = io.BytesIO()
        page.render(scale=dpi / 72).to_pil().save(buffer, "PNG")
        out.append(buffer.getvalue())
    return out


def page_count(content: bytes) -> int:
    """Pages of a PDF, without rendering any. Needs pypdfium2."""
    import pypdfium2

    pdf = pypdfium2.PdfDocument(content)
    try:
        return len(pdf)
    finally:
        pdf.close()


def page_counts(files: DataFrame, count: Callable[[bytes], int] = page_count) -> DataFrame:
    """(path, n_pages) of ``files`` (path, content); NULL for a file that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    out.append(count(bytes(content)))
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "n_pages": pd.array(out, "Int32")})

    return files.select("path", "content").mapInPandas(run, "path string, n_pages int")


def scanned_pages(files: DataFrame, images: Callable[[bytes], list[bytes]] = page_images, read: Callable[[bytes], str] | None = None, tasks: int = 200) -> DataFrame:
    """(path, page, text) by OCR of ``files`` (path, content). Pages of all files are spread over
    tasks before the costly step, so one long file does not hold up the rest."""
    read = read or command_reader()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                pages = images(bytes(content))
                yield pd.DataFrame({"path": path, "page": range(len(pages)), "image": pages})

    def recognise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "page": batch["page"], "text": [read(bytes(x)) for x in batch["image"]]})

    pages = files.select("path", "content").mapInPandas(split, "path string, page int, image binary")
    return pages.repartition(tasks, "path", "page").mapInPandas(recognise, "path string, page int, text string")


def repaired_pages(files: DataFrame, images: Callable[[bytes], list[bytes]] = page_images, read: Callable[[bytes], str] | None = None, again: Callable[[bytes], str] | None = None, pages: DataFrame | None = None, tasks: int = 200) -> DataFrame:
    """(path, page, text, repaired): OCR of ``files`` with pages whose tables fell apart read once more.

    ``again`` is a reader in a mode for tables; its text is kept where it has more table rows. ``pages``
    (path, page, text) are earlier readings to repair instead of reading all pages again. The second
    reading sees only the images of the pages that look split.
    """
    again = again or command_reader(psm=6)
    first = pages if pages is not None else scanned_pages(files, images, read, tasks)
    first = cut(first.select("path", F.col("page").cast("int"), "text"))
    split = split_tables(first).filter("looks_split").groupBy("path").agg(F.collect_list("page").alias("wanted"))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, wanted in zip(batch["path"], batch["content"], batch["wanted"]):
                some = images(bytes(content))
                yield pd.DataFrame({"path": path, "page": list(wanted), "text": [again(bytes(some[i])) for i in wanted]})

    reread = files.select("path", "content").join(split, "path").repartition(tasks, "path").mapInPandas(second, "path string, page int, text string")
    return keep_better(first, reread, ["path", "page"])


def preferred_text(ocr: DataFrame, layer: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, text, text_source): a filing's OCR pages if there are any, else its text layer.

    E-signing banners are emptied in OCR text only. NULL keys are values like others.
    """
    a = ocr.select(*keys, "page", X.strip_banner(F.col("text")).alias("text"), F.lit("ocr").alias("text_source"))
    b = not_yet(layer, ocr, keys).select(*keys, "page", "text", F.lit("text_layer").alias("text_source"))
    return a.unionByName(b)
