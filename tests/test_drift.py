import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathom.operators import drift as D
from fathom.operators import ngram, similarity

A = "the club grew its income and the board is pleased with the income of the club".split()
B = "the board sold the stadium and bought players for the next season of the league".split()


def docs(spark, rows):
    return spark.createDataFrame(rows, "club string, company_number string, year string, doc long, tokens array<string>")


def bits(prev, cur, d=0.75):
    """Plain recursive interpolated Kneser-Ney."""
    seq = lambda t: ["<s>", "<s>", *t, "</s>"]
    s = seq(prev)
    raw = {k: Counter(tuple(s[i : i + k]) for i in range(len(s) - k + 1)) for k in (1, 2, 3)}
    num = {3: raw[3], 2: Counter(g[1:] for g in raw[3]), 1: Counter(g[1:] for g in raw[2])}
    den, fol = {k: Counter() for k in num}, {k: Counter() for k in num}
    for k, table in num.items():
        for g, c in table.items():
            den[k][g[:-1]] += c
            fol[k][g[:-1]] += 1
    v = len({*prev, "</s>"}) + 1

    def p(g, k):
        low = 1 / v if k == 1 else p(g[1:], k - 1)
        total = den[k].get(g[:-1], 0)
        return max(num[k].get(g, 0) - d, 0) / total + d * fol[k][g[:-1]] / total * low if total else low

    c = seq(cur)
    said = [-math.log2(max(p(tuple(c[i - 2 : i + 1]), 3), 1 / (64 * v))) for i in range(2, len(c))]
    return sum(said) / len(said)


@pytest.mark.parametrize("prev, cur", [(A, B), (A, A), (B, A), (A, []), ([], A), (["x"], ["x", "x"])])
def test_surprisal_against_recursion(spark, prev, cur):
    df = spark.createDataFrame([("p", prev), ("c", cur)], "doc string, tokens array<string>")
    pairs = spark.createDataFrame([("p", "c")], "doc_prev string, doc string")
    assert ngram.surprisal(pairs, df).first()["bits"] == pytest.approx(bits(prev, cur), abs=1e-9)


def test_same_text_has_no_novelty_and_order_counts(spark):
    rows = D.drift(docs(spark, [("c", None, "2020", 1, A), ("c", None, "2022", 2, A), ("c", None, "2023", 3, B)])).orderBy("year").collect()
    assert [(r["year_prev"], r["year"]) for r in rows] == [("2020", "2022"), ("2022", "2023")] and rows[0]["company_number"] is None
    assert rows[0]["cosine_novelty"] == 0 and rows[0]["jaccard_novelty"] == 0 and rows[1]["cosine_novelty"] > 0.3
    assert rows[0]["surprisal_bits"] < rows[1]["surprisal_bits"]
    again = D.drift(docs(spark, [("c", None, "2023", 3, B), ("c", None, "2020", 1, A), ("c", None, "2022", 2, A)])).orderBy("year").collect()
    assert again == rows


def test_term_weights_against_plain_formula(spark):
    got = {(r["doc"], r["term"]): r["weight"] for r in similarity.tfidf(docs(spark, [("c", None, "1", 1, A), ("c", None, "2", 2, B)]).withColumn("company_number", F.lit("")), ["club", "company_number"]).collect()}
    df = Counter([*set(A), *set(B)])
    for doc, tokens in ((1, A), (2, B)):
        raw = {t: (1 + math.log(n)) * (math.log(3 / (1 + df[t])) + 1) for t, n in Counter(tokens).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        for t, x in raw.items():
            assert got[doc, t] == pytest.approx(x / norm)


def test_exclusions_ranking_and_sanity(spark):
    text = " ".join(A * 30)
    rows = [(1, "c", "n", "2020", "strategic_report", text, "2021"), (2, "c", "n", "2021", "strategic_report", "short", "2022"), (3, "c", "n", "2022", "strategic_report", " ".join(B * 30), "2023"), (4, "c", "n", "2022", "strategic_report", None, None), (3, "c", "n", "2022", "strategic_report", " ".join(B * 30), "2023"), (5, "c", "n", "2023", "strategic_report", "x" * 3000, "2024")]
    sections = spark.createDataFrame(rows, "section_id long, club string, company_number string, year string, section string, text string, parsed_at string")
    reports = D.reports(sections)
    assert {(r["year"], r["reason"]) for r in D.excluded(reports).collect()} == {("2021", "short_strategic_report"), ("2023", "too_few_tokens")}
    scored = D.scored(reports)
    change = D.drift(scored)
    assert change.count() == 1
    rank = D.ranking(change).first()
    assert rank["n_pairs"] == 1 and rank["mean_cosine_novelty"] == rank["max_cosine_novelty"]
    sane = D.sanity(scored).first()
    assert sane["year"] == "2022" and sane["identical_cosine_novelty_near_zero"] and sane["identical_jaccard_novelty_zero"] and sane["shuffled_more_surprising_than_identical"]


def test_empty_and_single(spark):
    assert D.drift(docs(spark, [])).count() == 0
    assert D.drift(docs(spark, [("c", "n", "2020", 1, A)])).count() == 0
    assert D.sanity(docs(spark, [])).count() == 0
