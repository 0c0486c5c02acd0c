"""Company register client and a Spark data source over it.

The client is plain Python: it runs inside a reader's partition. A rolling window limits calls; each
partition gets its share of the limit, as partitions have no common state.
"""

from __future__ import annotations

import base64
import json
import os
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.frames import cut
from ..operators.cache import upsert

CALLS, SECONDS, TRIES, BACKOFF_MOST = 600, 300.0, 5, 30.0


class RegisterError(RuntimeError):
    """A call that failed for good."""


class MissingKey(RegisterError):
    """No API key was given."""


def _get(url: str, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def seconds(told: str | None) -> float:
    """A Retry-After header in seconds, fractions included; 0 for a date or rubbish."""
    try:
        return max(0.0, float(told or 0))
    except ValueError:
        return 0.0


class Client:
    """Calls with a rolling limit and retries. ``get``, ``clock`` and ``sleep`` can be replaced."""

    def __init__(self, base: str, key: str | None = None, key_variable: str = "REGISTER_API_KEY", calls: int = CALLS, seconds: float = SECONDS, timeout: float = 60, get: Callable = _get, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        key = key or os.environ.get(key_variable)
        if not key:
            raise MissingKey(f"give a key or set {key_variable}")
        self._auth = "Basic " + base64.b64encode(f"{key}:".encode()).decode()
        self.base, self.calls, self.seconds, self.timeout = base.rstrip("/"), calls, seconds, timeout
        self._get, self._clock, self._sleep = get, clock, sleep
        self._made: deque[float] = deque()

    def throttle(self) -> None:
        """Waits until a call fits into the window."""
        now = self._clock()
        while self._made and now - self._made[0] >= self.seconds:
            self._made.popleft()
        if len(self._made) >= self.calls:
            self._sleep(self.seconds - (now - self._made[0]) + 0.5)
            self._made.popleft()
        self._made.append(self._clock())

    def request(self, url: str, accept: str | None = None) -> tuple[int, dict[str, str], bytes]:
        """Up to five tries: network errors and 5xx back off, 429 waits as told and at least as long
        as a back-off, 401 is final."""
        headers = {"Authorization": self._auth} | ({"Accept": accept} if accept else {})
        said = ""
        for n in range(TRIES):
            self.throttle()
            pause = min(2.0**n, BACKOFF_MOST) + random.uniform(0, 0.5)
            try:
                status, given, body = self._get(url, headers, self.timeout)
            except OSError as e:
                said = str(e)
                self._sleep(pause)
                continue
            if status == 401:
                raise RegisterError("the key was refused")
            if status == 429 or status >= 500:
                said = f"HTTP {status}"
                self._sleep(max(seconds(given.get("Retry-After")), pause) if status == 429 else pause)
                continue
            return status, given, body
        raise RegisterError(f"gave up after {TRIES} tries: {said}")

    def _json(self, path: str, **query: object) -> tuple[int, dict]:
        status, _, body = self.request(f"{self.base}{path}?{urllib.parse.urlencode(query)}")
        return status, json.loads(body) if status == 200 else {}

    def search(self, query: str, size: int = 20) -> list[dict]:
        status, said = self._json("/search/companies", q=query, items_per_page=size)
        if status != 200:
            raise RegisterError(f"search: HTTP {status}")
        return said.get("items") or []

    def profile(self, number: str) -> dict:
        status, said = self._json(f"/company/{number}")
        if status != 200:
            raise RegisterError(f"profile: HTTP {status}")
        return said

    def filings(self, number: str, category: str = "accounts", size: int = 100) -> Iterator[dict]:
        """All filings, page by page; a company the register does not know has none."""
        start = 0
        while True:
            status, said = self._json(f"/company/{number}/filing-history", category=category, items_per_page=size, start_index=start)
            if status == 404:
                return
            if status != 200:
                raise RegisterError(f"filings: HTTP {status}")
            rows = said.get("items") or []
            yield from rows
            start += len(rows)
            if not rows or start >= said.get("total_count", 0):
                return

    def document(self, base: str, number: str) -> tuple[bytes, str]:
        status, headers, body = self.request(f"{base.rstrip('/')}/document/{number}/content", "application/pdf")
        if status != 200:
            raise RegisterError(f"document: HTTP {status}")
        return body, headers.get("Content-Type", "")


HITS = "club string, query_no int, result_no int, title string, company_number string, company_status string, date_of_creation string"
FILINGS = "company_number string, ordinal int, type string, date string, description string, transaction_id string, description_values struct<made_up_date:string>, links struct<document_metadata:string>"


DOCUMENTS = "document_id string, content binary, content_type string, bytes long, error string"


class Part(InputPartition):
    def __init__(self, value: object):
        self.value = value


class RegisterReader(DataSourceReader):
    def __init__(self, options: dict[str, str], kind: str):
        self.options, self.kind = options, kind
        self.todo = json.loads(options["todo"])

    def partitions(self) -> list[Part]:
        """At most ``parallel`` partitions, each with a list of its own and one client for all of it:
        together they keep the limit, as each has its share of it from beginning to end."""
        return [Part(self.todo[i :: self.slots]) for i in range(self.slots)]

    @property
    def slots(self) -> int:
        return min(len(self.todo), CALLS, max(1, int(self.options.get("parallel", "8"))))

    def client(self) -> Client:
        share = max(1, CALLS // max(1, self.slots))
        if self.options.get("fixtures"):
            return Client("fixture:", key="none", calls=share, get=fixture_get(self.options["fixtures"]))
        return Client(self.options["base"], self.options.get("key"), calls=share)

    def read(self, part: Part) -> Iterator[tuple]:
        client = self.client()
        for one in part.value:
            yield from {"search": self.hits, "filings": self.filings, "documents": self.documents}[self.kind](client, one)

    def hits(self, client: Client, one: list) -> Iterator[tuple]:
        club, n, query = one
        for k, x in enumerate(client.search(query)):
            yield (club, n, k, x.get("title"), x.get("company_number"), x.get("company_status"), x.get("date_of_creation"))

    def filings(self, client: Client, number: str) -> Iterator[tuple]:
        for k, x in enumerate(client.filings(number)):
            yield (number, k, x.get("type"), x.get("date"), x.get("description"), x.get("transaction_id"), ((x.get("description_values") or {}).get("made_up_date"),), ((x.get("links") or {}).get("document_metadata"),))

    def documents(self, client: Client, number: str) -> Iterator[tuple]:
        """One row whatever happens: a document that cannot be had carries its error."""
        try:
            content, kind = client.document(self.options.get("documents", client.base), number)
            yield (number, content, kind, len(content), None)
        except RegisterError as e:
            yield (number, None, None, 0, str(e))


def fixture_get(folder: str) -> Callable:
    """Answers from files named by the quoted path and query, for runs without a network."""

    def get(url: str, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
        path = os.path.join(folder, urllib.parse.quote(url.removeprefix("fixture:"), safe=""))
        if not os.path.exists(path):
            return 404, {}, b""
        with open(path, "rb") as f:
            return 200, {"Content-Type": "application/json"}, f.read()

    return get


class RegisterSource(DataSource):
    """``spark.read.format("register")``: option ``kind`` is search, filings or documents; ``todo`` a
    JSON list of [club, query_no, query], of company numbers or of document numbers, spread over
    at most ``parallel`` partitions; ``base`` (``documents`` for the documents' own) and ``key``, or
    ``fixtures`` for a folder of answers."""

    @classmethod
    def name(cls) -> str:
        return "register"

    def schema(self) -> str:
        return {"search": HITS, "filings": FILINGS, "documents": DOCUMENTS}[self.options["kind"]]

    def reader(self, schema: StructType) -> RegisterReader:
        return RegisterReader(self.options, self.options["kind"])


NO_LINK = "no document_metadata link on filing"


def download(picked: DataFrame, folder: str, manifest: DataFrame | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Fetches the documents of ``picked`` filings; returns the manifest, one row per (club, year).

    ``picked``: (club, company_number, company_name, year, date, made_up_date, transaction_id,
    description, document_id), at most a few filings a club. Files are ``<folder>/<club>/<year>.pdf``;
    one that is there and not empty is not fetched again. A filing without a document number or
    whose fetch fails gets a row with its ``error``. Rows of ``manifest`` stay unless replaced. Numbers
    of documents, not documents, pass the driver; the files are written where they are fetched.
    """
    spark = picked.sparkSession
    rows = picked.select(
        "club", "year", "company_number", "company_name", F.col("date").alias("filing_date"), "made_up_date", "transaction_id",
        F.col("description").alias("accounts_type"), F.concat_ws("/", F.lit(folder.rstrip("/")), "club", F.concat("year", F.lit(".pdf"))).alias("path"), "document_id",
    )
    there = spark.createDataFrame([(p, n) for p, n in sizes(spark, f"{folder.rstrip('/')}/*/*.pdf") if n], "path string, have long")
    rows = cut(rows.join(there, "path", "left"))
    todo = [r[0] for r in rows.filter("have is null and document_id is not null").select("document_id").distinct().orderBy("document_id").toLocalIterator()]
    reader = spark.read.format("register").options(kind="documents", todo=json.dumps(todo), **(options or {}))
    due = rows.filter("have is null").select("document_id", "path")
    got = cut(save(reader.load().join(due, "document_id"))) if todo else spark.createDataFrame([], "path string, content_type string, got long, failed string")
    out = rows.join(got, "path", "left").select(
        *[c for c in rows.columns if c not in ("path", "document_id", "have")], "path", "content_type",
        F.coalesce("have", "got", F.lit(0)).alias("bytes"), F.coalesce("failed", F.when(F.col("document_id").isNull() & F.col("have").isNull(), NO_LINK)).alias("error"),
    )
    return out if manifest is None else upsert(manifest, out, ["club", "year"])


def sizes(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that match, as the pattern spells the scheme."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    some = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    plain = "://" not in pattern and not pattern.startswith("file:")
    return [(x.getPath().toUri().getPath() if plain else x.getPath().toString(), x.getLen()) for x in some]


def save(documents: DataFrame) -> DataFrame:
    """(path, content_type, got, failed): each document written to its path, in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["content"] is not None:
                    system, path = fs.FileSystem.from_uri(r["path"]) if ":" in r["path"] else (fs.LocalFileSystem(), r["path"])
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(path) as f:
                        f.write(r["content"])
                out.append({"path": r["path"], "content_type": r["content_type"], "got": r["bytes"], "failed": r["error"]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("content_type", pa.string()), ("got", pa.int64()), ("failed", pa.string())]))

    return documents.mapInArrow(run, "path string, content_type string, got long, failed string")
