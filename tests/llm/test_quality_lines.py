import re
from collections import defaultdict

import numpy as np
import pytest

from fathom.llm import lines as L
from fathom.llm import quality as Q

TEXTS = [None, "", "  \n ", "The board is pleased with the result of the year.\nIt was good.", "12,345 678\n(9) - 10", "xq zz kk\nwv", "a", "É ü 5", "Contents\nA .......... 1", "word " * 30_000]


def plain(x):
    tokens = x.split()
    words = re.findall("[a-z]+", x.lower())
    solid = [c for c in x if not c.isspace()]
    rows = [y.strip() for y in x.split("\n") if y.strip()]
    mean = sum(map(len, tokens)) / len(tokens)
    return (
        (not words or sum(w in Q.FUNCTION_WORDS for w in words) / len(words) < 0.15)
        + (sum(not (c.isascii() and c.isalpha()) for c in solid) / len(solid) > 0.25)
        + (mean < 3.2 or mean > 8.5)
        + (sum(y[-1] in ".!?" for y in rows) / len(rows) < 0.02)
    )


def test_statistics_against_plain_code(spark):
    rows = [("t", i, x) for i, x in enumerate(TEXTS)] + [("t", 3, TEXTS[3])]
    df = spark.createDataFrame(rows, "tab string, rec_id long, text string").withColumn("n_flags", Q.F.lit(0))
    got = {r["rec_id"]: r["n_flags"] for r in Q.text_statistics(df, ["tab", "rec_id"]).collect()}
    assert got == {i: plain(x) for i, x in enumerate(TEXTS) if x and x.split()}
    assert Q.text_statistics(df.limit(0), ["tab", "rec_id"]).count() == 0


def test_percentiles_and_tails(spark):
    rows = [("en", i, float(i), None, 1.0, 0.5) for i in range(2000)] + [(None, -1, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "lang string, rec_id long, function_share double, symbol_share double, mean_token double, stop_line_share double")
    got = {r["rec_id"]: r for r in Q.tail_report(df, "lang").collect()}
    assert len(got) == 2001 and got[0]["function_share_tail"] == -1 and got[1999]["function_share_tail"] == 1 and got[1000]["function_share_tail"] == 0
    assert got[1000]["function_share_pct"] == pytest.approx(0.5, abs=0.02) and got[5]["symbol_share_pct"] is None and got[5]["symbol_share_tail"] == 0


def test_sketches_against_exact_ranks(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(x), float(x) ** 3) for g, n in (("en", 30_000), ("de", 700)) for i, x in enumerate(rng.gamma(2, 1, n))]
    df = spark.createDataFrame(rows, "lang string, rec_id long, function_share double, symbol_share double").repartition(7)
    got = Q.tail_report(df, "lang", names=("function_share", "symbol_share")).toPandas()
    for g, own in got.groupby("lang"):
        for n in ("function_share", "symbol_share"):
            exact = own[n].rank() / len(own)
            assert (own[f"{n}_pct"] - exact).abs().max() < 0.01
            z = (own[n] - own[n].median()) / ((own[n].quantile(0.75) - own[n].quantile(0.25)) / 1.349)
            assert (own[f"{n}_z"] - z).abs().median() < 0.03


def test_common_words_are_those_of_the_language(spark):
    rows = [("en", 1, "the cat and the dog and the the bird"), ("de", 2, "der Hund und die Katze und der der Vögel"), ("de", 3, None), (None, 4, "xx xx yy"), ("fr", 5, "")]
    df = spark.createDataFrame(rows, "lang string, doc_id long, text string")
    assert Q.common_words(df, "lang", n=2) == {"en": {"the", "and"}, "de": {"der", "und"}, None: {"xx", "yy"}}
    got = {r["doc_id"]: r["function_share"] for r in Q.text_statistics(df, ["doc_id", "lang"], language="lang").collect()}
    assert got == {1: 1.0, 2: 1.0, 4: 1.0} and Q.common_words(df.limit(0), "lang") == {}


def pages(spark, rows):
    return spark.createDataFrame(rows, "club string, page_id long, text string")


def test_repeated_lines_against_counting(spark):
    rows = []
    for i in range(60):
        club = "big" if i % 3 else "small"
        text = f"Notice\n Title  of {club}\nown line {i}\n" + ("Footer\nImprint" if i % 4 == 0 else "rare" if i < 4 else "")
        rows.append((club, i, text))
    rows += [("big", 59, rows[59][2])] * 50 + [("big", 100, None), ("big", 101, ""), (None, 102, "Notice"), ("tiny", 103, "Notice"), ("tiny", 104, "Notice\nNotice\nNotice\nNotice\nNotice")]
    seen, total = defaultdict(set), defaultdict(set)
    for club, key, text in rows:
        if club:
            total[club].add(key)
            for x in L.line_list(text or ""):
                seen[club, x].add(key)
    want = {k for k, v in seen.items() if len(v) >= 5 and 5 * len(v) >= len(total[k[0]])}
    df = pages(spark, rows).withColumn("line", L.F.lit(""))
    got = [(r["club"], r["line"]) for r in L.repeated_lines(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    clean = {r["page_id"]: r for r in L.without_repeated_lines(df).collect()}
    assert clean[1]["text"] == "own line 1\nrare" and clean[100]["text"] is None and clean[102]["text"] == "Notice" and len(clean) == 65
    assert L.repeated_lines(df.limit(0)).count() == 0


def brute_blocks(rows, min_pages=5, min_share=5):
    """Per source, all blocks on enough pages, and those that stand somewhere outside a longer one."""
    seqs, total = defaultdict(list), defaultdict(int)
    for club, key, text in {(c, k): (c, k, t) for c, k, t in rows}.values():
        if club is not None:
            total[club] += 1
            seqs[club].append(L.line_list(text or ""))
    out = set()
    for club, pages_ in seqs.items():
        on = defaultdict(set)
        for k, s in enumerate(pages_):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    on[tuple(s[i:j])].add(k)
        often = {b: len(ks) for b, ks in on.items() if len(ks) >= min_pages and min_share * len(ks) >= total[club]}
        for s in pages_:
            longest = [max((j - i for j in range(i + 1, len(s) + 1) if tuple(s[i:j]) in often), default=0) for i in range(len(s))]
            for i, n in enumerate(longest):
                if n and (i == 0 or longest[i - 1] <= n):
                    out.add((club, tuple(s[i : i + n]), often[tuple(s[i : i + n])]))
    return out


def test_blocks_against_counting(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(6):
        for k in range(30):
            lines = [f"L{x}" for x in rng.integers(0, 3 + c, rng.integers(1, 9))]
            rows.append((f"c{c}", 100 * c + k, "\n \n".join(lines)))
    rows += [("long", 1000 + k, "\n".join([f"a{i}" for i in range(37 - k % 3)] + [f"own {k}", "a5", "a6"] + ["same"] * (k % 4) * 3)) for k in range(12)]
    rows += rows[:40] + [(None, 5000, "L1\nL2"), ("c0", 5001, None), ("c0", 5002, "")]
    want = brute_blocks(rows)
    found = L.Repeats(pages(spark, rows))
    texts = {r["line_id"]: (r["source"], r["line"]) for r in L.block_lines(found, pages(spark, rows)).collect()}
    got = [(texts[r["block"][0]][0], tuple(texts[x][1] for x in r["block"]), r["n_pages"]) for r in found.blocks().collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(len(b) for _, b, _ in want) > 30
    several = {(r["club"], r["lines"], r["n_lines"], r["n_pages"]) for r in L.repeated_blocks(pages(spark, rows)).collect()}
    assert several == {(c, "\n".join(b), len(b), n) for c, b, n in want if len(b) > 1}
    assert {(r["club"], r["line"]) for r in L.repeated_lines(pages(spark, rows)).collect()} == {(c, x) for c, b, _ in want for x in b}


def test_only_blocks_of_enough_lines_are_deleted(spark):
    rows = [("c", k, f"Head\n\nSub\nown {k}\n" + ("Foot" if k % 2 else "x")) for k in range(20)]
    whole = {r["page_id"]: (r["text"], r["n_removed"]) for r in L.without_repeated_lines(pages(spark, rows)).collect()}
    assert whole[3] == ("\nown 3", 3) and whole[4] == ("\nown 4", 3)
    long = {r["page_id"]: (r["text"], r["n_removed"]) for r in L.without_repeated_lines(pages(spark, rows), least=2).collect()}
    assert long[3] == ("\nown 3\nFoot", 2) and long[4] == ("\nown 4\nx", 2)


def test_the_layout_does_not_change_the_blocks(spark):
    kinds = ["Lead\nMore"] * 30 + ["Lead"] * 20 + ["Xtra"] * 80 + ["More"] * 20 + ["own"] * 90
    rows = [(f"c{c}", 1000 * c + i, f"{x} {i}" if x == "own" else x) for c in range(5) for i, x in enumerate(kinds)]
    some = [{(r["club"], r["lines"], r["n_pages"]) for r in L.repeated_blocks(pages(spark, rows).repartition(n), least=1, min_share=9).collect()} for n in (1, 7)]
    assert some[0] == some[1] == {(f"c{c}", x, n) for c in range(5) for x, n in (("Lead\nMore", 30), ("Lead", 50), ("More", 50), ("Xtra", 80))}
