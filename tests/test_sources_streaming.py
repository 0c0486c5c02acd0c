import json
import urllib.parse

import pytest

from fathom.sources import files, rest
from fathom.streaming import incremental


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def client(answers, **kw):
    clock, said = Clock(), iter(answers)

    def get(url, headers, timeout):
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x

    return rest.Client("http://x", key="k", get=get, clock=clock, sleep=clock.sleep, **kw), clock


def test_missing_key(monkeypatch):
    monkeypatch.delenv("REGISTER_API_KEY", raising=False)
    with pytest.raises(rest.MissingKey):
        rest.Client("http://x")
    assert issubclass(rest.MissingKey, rest.RegisterError)


def test_rolling_window():
    c, clock = client([], calls=2, seconds=10)
    for _ in range(3):
        c.throttle()
    assert clock.slept == [10.5]


def test_retries():
    ok = (200, {}, b'{"items": [{"title": "a"}]}')
    c, clock = client([OSError("down"), (503, {}, b""), (429, {"Retry-After": "7"}, b""), ok])
    assert c.search("q") == [{"title": "a"}] and 1 <= clock.slept[0] <= 1.5 and 2 <= clock.slept[1] <= 2.5 and clock.slept[2] == 7
    c, _ = client([(401, {}, b"")])
    with pytest.raises(rest.RegisterError):
        c.search("q")
    c, _ = client([(500, {}, b"")] * 5)
    with pytest.raises(rest.RegisterError):
        c.search("q")


def test_filing_pages():
    page = lambda *n: (200, {}, json.dumps({"items": [{"date": x} for x in n], "total_count": 3}).encode())
    c, _ = client([page("a", "b"), page("c")])
    assert [x["date"] for x in c.filings("1")] == ["a", "b", "c"]
    c, _ = client([(404, {}, b"")])
    assert list(c.filings("1")) == []


def test_register_source(spark, tmp_path):
    said = {"items": [{"title": "Example", "company_number": "7"}]}
    url = "/search/companies?" + urllib.parse.urlencode({"q": "Example FC", "items_per_page": 20})
    (tmp_path / urllib.parse.quote(url, safe="")).write_text(json.dumps(said))
    spark.dataSource.register(rest.RegisterSource)
    rows = spark.read.format("register").option("kind", "search").option("fixtures", str(tmp_path)).option("todo", json.dumps([["c", 0, "Example FC"]])).load().collect()
    assert [(r["club"], r["title"], r["company_number"], r["company_status"]) for r in rows] == [("c", "Example", "7", None)]
    none = spark.read.format("register").option("kind", "filings").option("fixtures", str(tmp_path)).option("todo", '["9"]').load()
    assert none.count() == 0


def test_pauses_are_never_shorter_than_a_back_off():
    ok = (200, {}, b"{}")
    c, clock = client([(429, {"Retry-After": "0"}, b""), (429, {"Retry-After": "2.75"}, b""), (429, {"Retry-After": "soon"}, b""), ok])
    c.profile("1")
    assert 1 <= clock.slept[0] <= 1.5 and clock.slept[1] == 2.75 and 4 <= clock.slept[2] <= 4.5


def test_documents_are_asked_for_as_pdf():
    said = []
    c = rest.Client("http://x", key="k", get=lambda url, headers, timeout: said.append((url, headers.get("Accept"))) or (200, {"Content-Type": "application/pdf"}, b"%PDF"))
    assert c.document("http://d/", "9") == (b"%PDF", "application/pdf") and said == [("http://d/document/9/content", "application/pdf")]


def test_partitions_share_the_limit():
    reader = rest.RegisterReader({"todo": json.dumps([str(i) for i in range(1000)]), "parallel": "8", "fixtures": "x"}, "filings")
    parts = reader.partitions()
    assert len(parts) == 8 and sorted(x for p in parts for x in p.value) == sorted(str(i) for i in range(1000))
    assert sum(reader.client().calls for _ in parts) <= rest.CALLS
    assert rest.RegisterReader({"todo": "[]"}, "filings").partitions() == []


def test_download_keeps_what_is_there_and_says_what_failed(spark, tmp_path):
    answers, out = tmp_path / "answers", tmp_path / "raw"
    answers.mkdir()
    (out / "c").mkdir(parents=True)
    (out / "c" / "2020.pdf").write_bytes(b"old")
    (out / "c" / "2022.pdf").write_bytes(b"")
    (answers / urllib.parse.quote("/document/D22/content", safe="")).write_bytes(b"%PDF-22")
    spark.dataSource.register(rest.RegisterSource)
    rows = [("c", "7", "C Ltd", y, f"{y}-12-01", f"{y}-06-30", f"t{y}", "full", doc) for y, doc in (("2020", "D20"), ("2021", None), ("2022", "D22"), ("2023", "gone"))]
    picked = spark.createDataFrame(rows, "club string, company_number string, company_name string, year string, date string, made_up_date string, transaction_id string, description string, document_id string")
    before = spark.createDataFrame([("c", "2019", "kept", 5)], "club string, year string, path string, bytes long")
    got = {r["year"]: r for r in rest.download(picked, str(out), before, {"fixtures": str(answers)}).collect()}
    assert {y: (r["bytes"], r["error"]) for y, r in got.items()} == {"2019": (5, None), "2020": (3, None), "2021": (0, rest.NO_LINK), "2022": (7, None), "2023": (0, "document: HTTP 404")}
    assert (out / "c" / "2022.pdf").read_bytes() == b"%PDF-22" and got["2022"]["content_type"] == "application/json"
    assert rest.download(picked.limit(0), str(out), None, {"fixtures": str(answers)}).count() == 0


def test_files_are_listed_wherever_they_are(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / ".gitkeep").write_text("")
    assert not files.has_parsed_filings(spark, f"file://{tmp_path}") and files.club_years(spark, str(tmp_path)) == []
    for y in ("2024", "2023"):
        (tmp_path / "c" / f"{y}.json").write_text("{}")
    assert files.has_parsed_filings(spark, str(tmp_path)) and files.club_years(spark, f"file://{tmp_path}") == [("c", "2023"), ("c", "2024")]
    (tmp_path / "t.csv").write_text("a,b\n1,\n")
    assert files.read_csv(spark, f"file://{tmp_path}/t.csv", ["a", "b"]).count() == 1


def test_split_pages_are_read_again(spark):
    split, whole = "Turnover\nCost of sales\n512,467 481,278\n467,205 386,794\n45,262 94,484", "Turnover 512,467 481,278\nCost 1 2"
    files_ = spark.createDataFrame([("a.pdf", b"x"), ("b.pdf", b"y"), ("bad.pdf", b"")], "path string, content binary")
    said = []
    images = lambda content: [content + b"0", content + b"1"] if content else []
    read = lambda image: split if image == b"x1" else "prose"
    got = {(r["path"], r["page"]): (r["text"], r["repaired"]) for r in files.repaired_pages(files_, images, read, lambda image: whole, tasks=2).collect()}
    assert got == {("a.pdf", 0): ("prose", False), ("a.pdf", 1): (whole, True), ("b.pdf", 0): ("prose", False), ("b.pdf", 1): ("prose", False)} and not said
    cached = spark.createDataFrame([("a.pdf", 1, split)], "path string, page int, text string")
    assert [tuple(r) for r in files.repaired_pages(files_, images, read, lambda image: "worse", cached, tasks=2).collect()] == [("a.pdf", 1, split, False)]
    counts = {r["path"]: r["n_pages"] for r in files.page_counts(files_, lambda c: len(c) if c else 1 // 0).collect()}
    assert counts == {"a.pdf": 1, "b.pdf": 1, "bad.pdf": None}


def test_text_layers_of_filings_without_a_number(spark):
    schema = "club string, company_number string, page int, text string"
    ocr, layer = spark.createDataFrame([("a", None, 0, "o")], schema), spark.createDataFrame([("a", None, 0, "l"), ("b", None, 0, "l")], schema)
    got = files.preferred_text(ocr, layer, ["club", "company_number"]).collect()
    assert sorted((r["club"], r["text_source"]) for r in got) == [("a", "ocr"), ("b", "text_layer")]


def test_csv_keeps_blank_and_nil_apart(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 'say "x", y'), ("b", 0, "")], "club string, value_gbp long, note string")
    files.write_csv(df, str(tmp_path / "t"), ["club", "value_gbp", "note"], ["club"])
    back = files.read_csv(spark, str(tmp_path / "t"), ["club"]).orderBy("club").collect()
    assert [(r["value_gbp"], r["note"]) for r in back] == [(None, 'say "x", y'), ("0", None)]
    assert files.read_csv(spark, str(tmp_path / "none"), ["a", "b"]).columns == ["a", "b"]


def test_json_documents(spark, tmp_path):
    files.write_json({"b": "é", "a": 1}, str(tmp_path / "x" / "a.json"))
    assert (tmp_path / "x" / "a.json").read_text() == '{\n  "a": 1,\n  "b": "é"\n}\n' and files.read_json(str(tmp_path / "x" / "a.json"))["b"] == "é"
    files.write_json({"club": "c", "year": "2024", "pages": ["one", "two"], "dpi": 200, "psm": 3, "method_version": 2}, str(tmp_path / "o" / "a.json"))
    (tmp_path / "o" / "b.json").write_text("{broken")
    assert [(r["page"], r["text"]) for r in files.cached_pages(spark, str(tmp_path / "o" / "a.json")).collect()] == [(0, "one"), (1, "two")]
    state = {r["path"][-6:]: r["unreadable"] for r in files.cache_settings(spark, str(tmp_path / "o")).collect()}
    assert state == {"a.json": False, "b.json": True}
    files.write_json({"club": "c", "year": "1", "company_number": "n", "flags": ["f"], "sections": {"notes": "x"}}, str(tmp_path / "p" / "a.json"))
    assert files.parsed_filings(spark, str(tmp_path / "p")).first()["text"] == "x"


def test_page_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def read(content):
        if content == b"bad":
            raise ValueError
        return content.decode().split("|")

    got = {(r["page"], r["text"], r["source"]) for r in files.pdf_pages(spark, str(tmp_path), read).collect()}
    assert got == {(0, "one", "text_layer"), (1, "two", "text_layer"), (None, None, "unreadable")}
    some = spark.read.format("binaryFile").load(str(tmp_path / "a.pdf"))
    pages = files.scanned_pages(some, lambda c: c.split(b"|"), lambda image: image.decode().upper(), tasks=2)
    assert {(r["page"], r["text"]) for r in pages.collect()} == {(0, "ONE"), (1, "TWO")}
    layer = spark.createDataFrame([("c", 1, "layer"), ("d", 1, "docusign envelope id: 1")], "club string, page int, text string")
    ocr = spark.createDataFrame([("c", 1, "docusign envelope id: 1\nocr")], "club string, page int, text string")
    assert {(r["club"], r["text"], r["text_source"]) for r in files.preferred_text(ocr, layer, ["club"]).collect()} == {("c", "\nocr", "ocr"), ("d", "docusign envelope id: 1", "text_layer")}
    assert files.engine_version("no-such-engine") == "unknown"


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    schema = "page_id long, club string, company_number string, year string, page int, text string, scanned_at timestamp"
    make = lambda rows: spark.createDataFrame(rows, "page_id long, text string").selectExpr("page_id", "'c' club", "'n' company_number", "'1' year", "1 page", "text", "timestamp'2024-01-01' scanned_at")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([(1, "the board"), (1, "the board")], [(2, "x y")]):
        make(rows).write.mode("append").parquet(source)
        incremental.run_available(incremental.quality_stream(incremental.page_stream(spark, source, schema)), out, state).awaitTermination()
    got = {(r["page_id"], r["n_words"], r["common_word_ratio"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 2, 0.5), (2, 2, 0.0)} and spark.read.parquet(out).count() == 2
