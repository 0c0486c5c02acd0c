import math
import random
import re
from collections import Counter

import pytest

from fathom.llm import components, mixing, spans, terms


def reports(spark, rows):
    return spark.createDataFrame(rows, "section_id long, text string").withColumn("hash", spans.F.lit(1))


def run_length(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else 0)
        row = new
        best = max(best, max(row))
    return best


def test_pairs_and_shares_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(60) for _ in range(3)]
    rows = []
    for i in range(14):
        part = spans.collapse(base[i % 3])
        n = rng.choice([28, 29, 30, 31, 32, 45, 90])
        at = rng.randint(0, len(part) - n)
        rows.append((i, text(rng.randint(0, 12)) + "\n  " + part[at : at + n] + " \t" + text(rng.randint(0, 12))))
    rows += [(50, None), (51, ""), (52, "ab " * 200), (53, "ab " * 150), (54, "x" * 29), (55, "x" * 29), (56, "y" * 30), (57, "y" * 31), rows[0], (58, rows[0][1])]
    flat = {k: spans.collapse(x) for k, x in rows if x}
    want = {(a, b) for a in flat for b in flat if a < b and run_length(flat[a], flat[b]) >= 30}
    df = reports(spark, rows)
    got = [(r["section_a"], r["section_b"]) for r in spans.span_pairs(df, span=30, gram=22).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 5
    shares = {r["section_id"]: r for r in spans.span_shares(df, span=30, gram=22).collect()}
    for k, x in flat.items():
        grams = {y[i : i + 30] for o, y in flat.items() if o != k for i in range(len(y) - 29)}
        covered = {j for i in range(len(x) - 29) if x[i : i + 30] in grams for j in range(i, i + 30)}
        assert (shares[k]["shared_chars"], shares[k]["n_chars"]) == (len(covered), len(x)), k
        assert shares[k]["n_partners"] == sum(k in p for p in want)
    assert spans.span_pairs(df.limit(0)).count() == 0


def test_common_characters():
    rng = random.Random(2)
    for _ in range(300):
        x, y = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(2))
        want = next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert spans.agreed(x, y, False) == want and spans.agreed(x[::-1], y[::-1], True) == want


def test_passages_of_many_texts_join_once(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    part = spans.collapse(text(3000))
    rows = [(i, text(rng.randint(5, 200)) + part[: 3000 - i] + text(rng.randint(5, 200))) for i in range(12)] + [(100 + i, rows_) for i, rows_ in enumerate([part] * 5)]
    df = reports(spark, rows)
    texts = spans.normal_texts(df, "section_id", "text", spans.SPAN)
    prints = spans.cut(spans.fingerprints(texts, spans.SPAN, 250).distinct())
    met = spans.meetings(prints, "before").count()
    grams = prints.count() / 13
    assert met <= 4 * 13 * 12 / 2 and grams > 50
    assert spans.span_pairs(df).count() == 17 * 16 // 2
    links = [tuple(r) for r in spans.span_links(df).collect()]
    assert len(links) == 13 * 12 // 2 + 4
    found = components.connected_components(spans.span_links(df), "u", "v").collect()
    assert len(found) == 17 and {r["component"] for r in found} == {0}


def test_recall_of_sparse_bands(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(120):
        part = text(400)
        rows += [(2 * i, text(rng.randint(50, 300)) + part + text(80)), (2 * i + 1, text(rng.randint(50, 300)) + part + text(80))]
    df = reports(spark, rows)
    exact = {tuple(r) for r in spans.span_pairs(df).collect()}
    assert len(exact) == 120
    found = {k: len(exact & {tuple(r) for r in spans.span_pairs(df, gram=250, bands=k, stride=64).collect()}) / 120 for k in (1, 4)}
    assert found[1] < found[4] and found[4] >= 0.9


def test_kinds_of_links(spark):
    who = [(1, "c", None, "2020"), (2, "c", None, "2022"), (3, "c", None, "2023"), (4, "c", "n", "2022"), (5, "d", None, "2022"), (6, "c", None, "2022")]
    rows = spark.createDataFrame([(*r, "x") for r in who], "section_id long, club string, company_number string, year string, text string")
    drift = spark.createDataFrame([("c", None, "2020", "2022"), ("c", None, "2022", "2023"), ("c", None, "2020", "2022")], "club string, company_number string, year_prev string, year string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 4), (2, 5), (2, 6)], "section_a long, section_b long")
    got = {(r["section_a"], r["section_b"]): r["kind"] for r in spans.link_kinds(pairs, rows, drift).collect()}
    assert got == {(1, 2): "successive", (1, 3): "entity", (2, 3): "successive", (2, 4): "club", (2, 5): "foreign", (2, 6): "edition"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 50), (50, 60), (60, 40), (40, 50), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 50: 40, 60: 40}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_term_scores_against_plain_counts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Club's", "£5,000", "long-term", "rare%d" % i, "b", "a"]) for _ in range(rng.randint(1, 60)))) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "12 345"), rows[0]]
    texts = {k: x for k, x in rows if x}
    counts = {k: Counter(re.findall(terms.TOKEN, re.sub(terms.FIGURE, " ", x.lower()))) for k, x in texts.items()}
    n_all, total = len(counts), sum(c.total() for c in counts.values())
    docs, all_n = Counter(), Counter()
    for c in counts.values():
        docs.update(c.keys())
        all_n.update(c)
    got = {(r["section_id"], r["term"]): r for r in terms.term_scores(reports(spark, rows)).collect()}
    assert set(got) == {(k, t) for k, c in counts.items() for t in c}
    for (k, t), r in got.items():
        a, b = counts[k][t], all_n[t] - counts[k][t]
        c, d = counts[k].total() - a, total - counts[k].total() - b
        cells = [(a, (a + b) * (a + c)), (b, (a + b) * (b + d)), (c, (c + d) * (a + c)), (d, (c + d) * (b + d))]
        g2 = 2 * sum(o * math.log(o * total / e) for o, e in cells if o)
        assert abs(r["g2"]) == pytest.approx(g2, abs=1e-6) and r["weight"] == pytest.approx(a * math.log(n_all / docs[t]))
    best = {r["section_id"]: r["term"] for r in terms.most_distinctive(terms.term_scores(reports(spark, rows)), min_tokens=20).collect()}
    assert best == {k: min((-n * math.log(n_all / docs[t]), t) for t, n in c.items())[1] for k, c in counts.items() if c.total() >= 20}
    assert terms.term_scores(reports(spark, []).limit(0)).count() == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([" A", "a", "B ", "b", "C"]), rng.randint(1, 400)) for i in range(4000)] + [(9000, None, 500), (9001, "other", 3000), (9002, "a", None), (9003, "b", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("rate", mixing.F.lit(1))
    weights = spark.createDataFrame([("A", 0.2, 1), ("b", 0.5, 3), ("c ", 0.25, 1), ("d", 0.05, 5)], "source string, weight double, max_repeat int")
    mix = mixing.Balance(sizes, weights)
    assert mix.total == sum(r[2] or 0 for r in rows)
    got = {r["source"]: r for r in mix.report().collect()}
    have = Counter()
    for _, s, n in rows:
        have[(s or "").strip().lower()] += n or 0
    caps = {"a": 1, "b": 3, "c": 1, "d": 5}
    for s, w in (("a", 0.2), ("b", 0.5), ("c", 0.25), ("d", 0.05)):
        assert got[s]["short"] == (have[s] * caps[s] < w * mix.total) and got[s]["most_copies"] <= caps[s]
        assert got[s]["used"] == have[s] * caps[s] if got[s]["short"] else abs(got[s]["missing"]) < got[s]["largest"] and got[s]["missing"] == pytest.approx(w * mix.total - got[s]["used"])
    assert sum(r["actual_share"] for r in got.values()) == pytest.approx(1)
    even = mixing.Balance(sizes, weights, feasible=True)
    shares = {r["source"]: r for r in even.report().collect()}
    assert even.total == pytest.approx(min(have[s] * caps[s] / (w / 0.95) for s, w in (("a", 0.2), ("b", 0.5), ("c", 0.25))))
    assert all(abs(shares[s]["actual_share"] - w / 0.95) < 2 * 400 / even.total for s, w in (("a", 0.2), ("b", 0.5), ("c", 0.25))) and shares["d"]["used"] == 0
    none = mixing.Balance(sizes.limit(0), weights)
    assert none.total == 0 and none.report().count() == 4


def test_rates_solve_the_dual(spark):
    sizes = spark.createDataFrame([(i, "a", 10 + i % 90) for i in range(500)], "doc_id long, source string, size long")
    for weight, repeat in ((0.3, 1), (1.0, 1), (1.9, 2), (2.5, 4)):
        weights = spark.createDataFrame([("a", weight, repeat)], "source string, weight double, max_repeat int")
        mix = mixing.Balance(sizes, weights)
        reached = mix.copies().selectExpr("sum(size * rate)").first()[0]
        assert reached == pytest.approx(weight * mix.total, rel=1e-5)


def test_copies_follow_the_rates_and_carry_the_error(spark):
    rng = random.Random(6)
    sizes = spark.createDataFrame([(i, "a" if i % 3 else "b", rng.randint(1, 900)) for i in range(3000)] + [(9999, "c", 77)], "doc_id long, source string, size long")
    weights = spark.createDataFrame([("a", 0.5, 3), ("b", 0.49, 3), ("c", 0.00001, 2)], "source string, weight double, max_repeat int")
    mix = mixing.Balance(sizes, weights)
    assert not mix.solved and mix.targets().count() == 3 and not mix.solved
    rows = mix.copies().collect()
    for s in "abc":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - mix.rows[s]["target"]) < max(r["size"] for r in own)
        assert all(math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) for r in own)
        assert [r["copies"] for r in sorted(own, key=lambda r: r["doc_id"])] == [r["copies"] for r in sorted((r for r in mix.copies().collect() if r["source"] == s), key=lambda r: r["doc_id"])]


def test_token_sizes_round_trip(spark):
    got = {r["doc_id"]: r["size"] for r in mixing.token_sizes(spark.createDataFrame([(1, "s", "The club"), (2, "s", None), (3, "s", ""), (4, None, "é" * 5000)], "doc_id long, source string, text string")).collect()}
    assert set(got) == {1, 4} and got[1] == 2
