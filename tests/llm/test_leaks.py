import random
import re

import pytest

from fathom.llm import leaks as L
from fathom.llm.lookalike import default_fold


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for p in pattern:
        new = [row[0] + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_against_table():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        assert L.myers(a, b) == distance(a, b)
    assert L.myers(list("ab" * 100), list("ab" * 100)) == 0


def brute(docs, items, n=13):
    fold = default_fold()
    words = lambda t: re.findall(L.WORD, fold(t or "").lower())
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    side = [(k, grams(words(t))) for k, t in items]
    return {(d, k) for d, t in docs for k, g in side if grams(words(t)) & g}


def test_found_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 13, 14, 40])))) for i in range(30)] + [(90, None), (91, "")]
    docs = [(1, None), (2, ""), (3, " ".join(vocabulary) * 400)]
    for d in range(4, 60):
        words = items[d % 30][1].split()
        size = rng.choice([11, 12, 13, 14, 25])
        at = rng.randint(0, max(0, len(words) - size))
        docs.append((d, "intro " + ", ".join(words[at : at + size]).replace("o", "о", d % 2).upper() + ". end"))
    ddf = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", L.F.lit(7))
    idf = spark.createDataFrame(items, "item_id long, text string")
    got = L.leaks(ddf, idf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert L.leaks(ddf, idf.limit(0)).count() == 0 and L.leaks(ddf.limit(0), idf).count() == 0


def test_one_damaged_word(spark):
    words = [f"w{i}" for i in range(30)]
    bad = [*words[:10], "x", *words[11:21]]
    docs = spark.createDataFrame([(1, " ".join(bad)), (2, " ".join(["x", *words[3:9], "y", *words[10:13], "z"]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert L.leaks(docs, items).count() == 0
    got = L.leaks(docs, items, errors=1).collect()
    assert [(r["doc_id"], r["least_errors"]) for r in got] == [(1, 1)]
    with pytest.raises(ValueError):
        L.leaks(docs, items, window=3, errors=3)


def test_one_error_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([13, 14, 20, 35])))) for i in range(25)]
    docs = []
    for d in range(150):
        words = items[d % 25][1].split()
        at = rng.randint(0, max(0, len(words) - 14))
        part = words[at : at + rng.choice([12, 13, 14])]
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(part))
            part = rng.choice([part[:k] + part[k + 1 :], part[:k] + ["zz"] + part[k:], part[:k] + ["zz"] + part[k + 1 :]])
        docs.append((d, " ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] + part + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))])))
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["least_errors"] for r in L.leaks(ddf, idf, errors=1).collect()}
    want = {}
    for d, text in docs:
        for k, item in items:
            w = item.split()
            best = min(distance(w[i : i + 13], text.split()) for i in range(len(w) - 12))
            if best <= 1:
                want[d, k] = best
    assert got == want and sum(v == 1 for v in want.values()) > 20
