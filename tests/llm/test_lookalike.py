import unicodedata

import pytest
from fathom.llm import lookalike as L


@pytest.fixture(scope="module")
def fold():
    return L.default_fold()


@pytest.mark.parametrize(
    "a, b",
    [("ｃｏｓｔ，１２", "cost,12"), ("café", "café"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("ﬁrst ﬂoor oﬃce", "first floor office"), ("рассе", "pacce".replace("pacce", "pacce")), ("оｆ Α", "of A"), ("well‑known", "well-known"), ("ё", "ë"), ("Å", "Å")],
)
def test_alike_texts_meet(fold, a, b):
    if a == "рассе":
        a, b = "расе", "pace"
    assert fold(a) == fold(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("e", "é"), ("m²", "m2"), ("10⁵", "105"), ("a\nb", "a b"), ("½", "1/2"), ("a–b", "a-b"), ("0", "O"), ("1", "l"), ("a  b", "a b")])
def test_visible_differences_stay(fold, a, b):
    assert fold(a) != fold(b)


def test_fold_is_stable_and_leaves_plain_text_alone(fold):
    text = "Plain £5 text, naïve Ørsted 10²\n"
    assert fold(text) is text
    for x in ("ｆﬁ́", "é‍", "​", "", "ﬃ ﬀi fﬁ"):
        assert fold(fold(x)) == fold(x)
    assert fold("ﬃ") == fold("ﬀi") == fold("fﬁ") == "ffi"
    assert fold("é") == unicodedata.normalize("NFC", "é")


def test_classes_are_transitive_and_representatives_follow_counts():
    classes = L.lookalike_classes()
    members = [x for g in classes for x in g]
    assert len(members) == len(set(members))
    group = next(g for g in classes if "o" in g)
    assert {"o", "о", "ο", "ｏ"} <= set(group)
    rep = L.representatives([group], {"о": 5, "o": 2})
    assert rep["o"] == "о" and "о" not in rep


def pairs(rows):
    fold, out = L.default_fold(), set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if x and y and x != y and fold(x) == fold(y):
                out.add((min(a, b), max(a, b)))
    return out


def test_pairs_against_brute_force(spark):
    rows = [(1, "cost"), (2, "ｃost"), (3, "cost"), (4, "сost"), (5, "Cost"), (6, None), (7, ""), (8, "​"), (9, "ｃost"), (10, "x" * 50_000), (11, "x" * 49_999 + "х")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("printed", L.F.lit(1))
    counts = L.code_point_counts(df)
    assert counts["ｃ"] == 2
    for c in (None, counts):
        got = [(r["doc_a"], r["doc_b"]) for r in L.alike_pairs(L.fingerprints(df, counts=c)).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs(rows)
    assert L.alike_pairs(L.fingerprints(df.limit(0))).count() == 0
    canon = {r["doc_id"]: r["canonical"] for r in L.canonical_text(df).collect()}
    assert canon[6] is None and canon[7] == "" and canon[8] == "" and canon[2] == canon[1]


def test_a_foreign_representative_keeps_strings_together():
    counts = {"і": 9, "i": 1, "f": 5}
    fold = L.folder(*L.compile_fold(L.representatives(L.lookalike_classes(), counts)))
    assert fold("ﬁn") == fold("fin") == fold("fіn") == "fіn"


def test_all_of_unicode_is_covered():
    fold = L.default_fold()
    for code in (0xE0020, 0xE0101, 0xE0FFF, 0x200B, 0xFE0F, 0x3164, 0x1D173, 0x180F):
        assert fold(f"a{chr(code)}b") == "ab", hex(code)
    assert fold("\U0001f600") == "\U0001f600" and fold("\U0002f800") == unicodedata.normalize("NFC", "\U0002f800")


def test_strings_are_rewritten_longest_first():
    fold = L.folder("[^ -~]|[ -~]", {"ab": "1", "abc": "2", "bcd": "3", "é": "e"})
    assert fold("abcd") == "2d" and fold("xabab bcd") == "x11 3" and fold("") == ""


def test_classes_against_pairs(spark):
    rows = [(1, "a b"), (2, "a\u00a0b"), (3, "a b"), (4, "other"), (5, None), (6, ""), (7, "A b"), (8, "а b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_alike"], r["n_forms"]) for r in L.alike_classes(L.fingerprints(docs)).collect()}
    assert got == {k: (1, 4, 3) for k in (1, 2, 3, 8)}
    pairs = {(r["doc_a"], r["doc_b"]) for r in L.alike_pairs(L.fingerprints(docs)).collect()}
    assert pairs == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8)}
