import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fathom.llm import channel as C
from fathom.llm import scans as S

GOOD = "The directors considered the requirements of the league and the provision of training facilities at Norlanbaison. It was a long-term plan."
TRUE = [("e", "c"), ("l", "1"), ("i", "!"), ("m", "rn"), ("d", "cl")]


def vocabulary(rng, n=400):
    """Words of made-up syllables, most frequent first."""
    parts = ["ter", "lin", "mo", "dis", "per", "gal", "fen", "ti", "ro", "sed", "cla", "vun", "den", "hal", "mis", "ou", "ble", "ked", "pra", "sto"]
    out = list(dict.fromkeys("".join(rng.choice(parts) for _ in range(rng.choice((2, 3, 3, 4)))) for _ in range(3 * n)))
    return out[:n]


def damaged(words, rng, rate, tokens=60_000):
    """(lines of text, true misreads per line): words by a Zipf law, some with one confusion."""
    weights = [1 / (i + 3) for i in range(len(words))]
    lines, truth = [], []
    stream = rng.choices(words, weights, k=tokens)
    for i in range(0, tokens, 12):
        out, true = [], []
        for w in stream[i : i + 12]:
            hits = [(r, x) for r, x in TRUE if r in w]
            if hits and rng.random() < rate:
                r, x = rng.choice(hits)
                places = [m.start() for m in re.finditer(r, w)]
                at = rng.choice(places)
                bad = w[:at] + x + w[at + len(r) :]
                true.append((bad, w))
                w = bad
            out.append(w)
        lines.append(" ".join(out))
        truth.append(true)
    return lines, truth


def frames(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, page int, text string")
    return pages, pages.select(S.F.lit("ocr_pages").alias("tab"), S.F.col("page_id").alias("rec_id"), "page", "text", S.F.lit("x").alias("word"))


@pytest.fixture(scope="module")
def scan(spark):
    rng = random.Random(5)
    words = vocabulary(rng)
    lines, truth = damaged(words, rng, 0.01)
    rows = [(i, 1, line) for i, line in enumerate(lines)]
    pages, records = frames(spark, rows)
    return words, lines, truth, pages, records, S.Decoder(pages)


def test_confusions_are_learnt(scan):
    learnt = scan[5].channel
    assert set(TRUE) <= set(learnt.rates) and len(learnt.rates) <= len(TRUE) + 2
    assert all(1e-4 < learnt.rates[x] <= C.MOST_RATE for x in TRUE)


def test_misreads_against_the_truth_also_of_rare_words(scan):
    words, lines, truth, pages, records, decoder = scan
    clean = Counter(w for line, true in zip(lines, truth) for w in line.split() if w not in {b for b, _ in true})
    want = {(i, b, w) for i, true in enumerate(truth) for b, w in true if b not in clean}
    got = {(r["rec_id"], r["wrong"], r["word"]) for r in S.damage(records, pages, decoder).collect() if r["kind"] == "misread"}
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)
    rare = {x for x in want if 0 < clean[x[2]] < 30}
    assert not rare or len(got & rare) >= 0.9 * len(rare)


def test_two_confusions_in_a_word(scan):
    model = scan[5].channel
    assert {"address"} <= set(model.undone("acldrcss", 2)) and "address" not in model.undone("acldrcss")
    assert model.undone("x7y", 2) == {} and all(x.isalpha() for x in model.undone("c1a!rn", 2))


def test_likelihoods():
    assert C._lgamma(np.array([0.01, 0.5, 1.0, 3.0, 20.5])) == pytest.approx([math.lgamma(x) for x in (0.01, 0.5, 1.0, 3.0, 20.5)], abs=1e-9)
    k = np.arange(0, 4000.0)
    for mean in (0.01, 1.0, 30.0):
        p = C.likely(k, np.full(len(k), mean))
        assert p.sum() == pytest.approx(1, abs=1e-6) and (p * k).sum() == pytest.approx(mean, rel=1e-6)


def test_letter_model_leaves_a_form_out_of_its_own_estimate():
    forms = ["norlit", "norket", "kesdit", "kesliv", "morlit"]
    full = C.Letters.fit(forms)
    for f in forms:
        assert full.logs([f])[0] == pytest.approx(C.Letters.fit([x for x in forms if x != f], frozenset([f]), n_forms=5).logs([f])[0], abs=0.05)  # letters of one form alone count once
    assert full.logs(["zzzqqq"])[0] < full.logs(["kesdit"])[0] <= 0 and len(full.logs([])) == 0


def test_lines_of_text_and_rubbish():
    known, other, constant = C.text_lines([(9, 1, 500), (8, 0, 300), (0, 6, 100), (1, 7, 80)])
    says = lambda s, o: s * known + o * other + constant >= 0
    assert says(9, 1) and says(5, 2) and not says(0, 6) and not says(1, 7) and says(4000, 900) and not says(300, 2000)
    assert C.text_lines([])[0] > 0


def test_joints():
    joints, rest = S.line_joints("the accu-\nmulated result and long-\nterm, com- \nmunity Big-\nName end")
    assert joints == [("accu", "mulated"), ("long", "term,"), ("com", "munity")]
    assert "mulated" not in rest and "Big-\nName" in rest and S.line_joints("") == ([], "")


def test_damage_is_found(spark, scan):
    words, lines, _, pages, records, decoder = scan
    long, other = max((w for w in words[:60]), key=len), next(w for w in words[60:] if len(w) > 6)
    misread = next(w for w in words[5:60] if "m" in w)
    text = f"Page 7\n{words[0]} {misread.replace('m', 'rn', 1)} {words[1]} {long[:4]}-\n{long[4:]} {words[2]} {other[:3]}¬ \n{other[3:]}, {words[3]} {words[0]}-\n{words[1]} end."
    broken = next(w for w in words[:80] if "d" in w[3:] and len(w) > 6)
    spoilt = broken[:3] + broken[3:].replace("d", "cl", 1)
    rows = [(90_000, 7, text), (90_001, 12, f"{words[0]} {spoilt[:4]}\xad\n{spoilt[4:]} {words[2]}\n— 12 —"), (90_002, 3, None), (90_003, 3, ""), (90_004, 5, "Turnover 5 6,000\n15"), (90_000, 7, text)]
    _, some = frames(spark, rows)
    got = {(r["rec_id"], r["kind"], r["word"]) for r in S.damage(some, pages, decoder).collect()}
    assert got == {(90_000, "page_no", "Page 7"), (90_000, "split", long), (90_000, "split", other), (90_000, "misread", misread), (90_001, "split", broken), (90_001, "page_no", "— 12 —")}
    fixed = {r["rec_id"]: r["text"] for r in S.repaired(some, S.damage(some, pages, decoder), decoder=decoder).collect()}
    assert fixed[90_002] is None and fixed[90_003] == "" and broken in fixed[90_001] and spoilt not in fixed[90_001]
    assert long in fixed[90_000] and misread in fixed[90_000] and "Page 7" not in fixed[90_000]


def test_nothing_to_learn_from(spark):
    pages, records = frames(spark, [])
    assert S.damage(records, pages).count() == 0 and S.repaired(records, S.damage(records, pages)).count() == 0
    pages, records = frames(spark, [(1, 1, GOOD + " word" * 40_000 + " " + "e1" * 30_000), (2, 1, "e1")])
    assert S.damage(records, pages).count() == 0


def test_rubbish_lines_are_left(spark, scan):
    words, _, _, pages, _, decoder = scan
    bad = next(w for w in words[5:60] if "e" in w).replace("e", "c", 1)
    _, some = frames(spark, [(1, 2, f"wx tbq poas {bad} bh ax qz zx lbk"), (2, 2, " ".join([*words[:8], bad]))])
    lines = spark.createDataFrame([(i, 1, "wx qj zzk poas bh ax") for i in range(10, 60)], "page_id long, page int, text string")
    _, rest = frames(spark, [(100 + i, 1, " ".join([*words[:8], bad])) for i in range(60)])
    got = {r["rec_id"] for r in S.damage(some.unionByName(rest), pages, decoder).collect() if r["rec_id"] < 10}
    assert got == {2} and lines.count() == 50


def test_blanks_that_were_lost_or_added(spark, scan):
    words, *_, decoder = scan
    stream = S.Stream(decoder.frequent, decoder.channel)
    a, b = words[0], words[1]
    long = max(words[:60], key=len)
    cut = next(i for i in range(3, len(long)) if long[:i] not in decoder.frequent)
    assert stream.decode(f"{a} {long[:cut]} {long[cut:]} {b}") == f"{a} {long} {b}"
    joined = next((x + y for x in words[:20] for y in words[:20] if x + y not in decoder.frequent and len(x) > 5 < len(y)), None)
    assert joined is None or stream.decode(f"{a} {joined} {b}").replace(" ", "") == f"{a}{joined}{b}"
    assert stream.decode(f"{a} {b}") == f"{a} {b}" and stream.decode("") == ""


def test_paragraphs():
    lines = ["Strategic Report", "The board is pleased with the result of the year and", "continues to invest in the stadium of the club.", "", "Turnover 468,712 442,364", "Costs 441,208 409,552", "", "A new paragraph begins here and it also goes on to a", "second line."]
    got = S.paragraphs(lines)
    assert got[1] == lines[1] + " " + lines[2] and lines[4] in got and got[-1] == lines[7] + " " + lines[8]
    assert S.paragraphs([]) == [] and S.paragraphs(["", " "]) == []
    assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", "".join(lines))


def test_names_are_judged_alike_at_every_size(spark):
    """A ground misread in its running line, and a name of its own that is near to a more frequent one."""

    def found(times):
        rng = random.Random(3)
        model = {}
        for i in range(200 * times):
            w = "".join(rng.choice(["nor", "tor", "lin", "tin", "bai", "son", "ken", "vel", "ost"]) for _ in range(4))
            model[w] = model.get(w, 0) + 3
        model |= {"norlinbaison": 4, "nortinbaison": 62, "ingosbaane": 69 * times, "ingosbaanc": 7}
        forms = spark.createDataFrame([(w, n, w.isalpha()) for w, n in model.items()], "form string, n long, word boolean")
        letters = C.Letters.fit(list(model), frozenset(["ingosbaanc"]))
        channel = C.Channel({("e", "c"): 8e-4, ("t", "l"): 8e-5}, letters, sum(model.values()), 10)
        return {(r["form"], r["word"]) for r in C.decoded_forms(forms, channel, forms.filter("word")).collect()}

    assert found(1) == found(5) == {("ingosbaanc", "ingosbaane")}


def test_page_number_lines():
    body = ["one two three"] * 6
    assert S.page_number_lines(["3.", *body, "- 4 -", *body, "Page 5", "p. 6 of 9", "(7)", *body]) == {0, 7, 14, 15}
    assert S.page_number_lines([*body, "4.", *body, "", "5.", *body, "£6", "12", *body]) == {6, 14}
    assert S.page_number_lines([*body, "4", "5", "6", *body]) == S.page_number_lines([]) == set()


def test_rows_of_figures_do_not_run():
    assert S.line_key("Wages and salaries 149,123 220,710") is S.line_key("Total costs 12 15") is S.line_key("£'000 £'000") is None
    assert S.line_key("Year ended 31 May 2016") == S.line_key(" YEAR  ended 31 May 2016") != S.line_key("Year ended 31 May 2017")


def test_running_lines_are_dropped(spark):
    rows, schema = [], "page_id long, club string, company_number string, year string, page int, text string"
    for i in range(60):
        year, page = str(2000 + i // 6), i % 6
        head = "Strategic Report" if page == 1 else f"ACLUB TOWN {year}"
        rows.append((i, "a", None, year, page, f"{head}\nThe board of {year} looks back on page {i}.\nPrinted by  Some Press\n{page}"))
    rows += [(99, "a", None, "2011", 4, "Own words here.\nPrintcd by Some Press\n4"), (100, "b", None, "2011", 4, "Own words here.\nPrinted by Some Press"), (101, None, None, "2011", 4, "Printed by Some Press")]
    pages = spark.createDataFrame(rows, schema)
    sections = spark.createDataFrame([(7, "a", "strategic_report", "Strategic Report\nIt was a good\nprinted by Some Press\n- 4 -\nyear for us.")], "section_id long, club string, section string, text string")
    records = S.page_records(pages, sections, "club")
    got = {(r["tab"], r["rec_id"]): r["text"] for r in S.repaired(records, S.damage(records, pages), S.running_lines(pages)).collect()}
    assert got["ocr_pages", 99] == "Own words here.\n\nPrintcd by Some Press"  # nothing is learnt from one misread
    fix = spark.createDataFrame([("ocr_pages", 99, "misread", "printcd", "printed")], "tab string, rec_id long, kind string, wrong string, word string")
    got |= {(r["tab"], r["rec_id"]): r["text"] for r in S.repaired(records.filter("rec_id = 99"), fix.unionByName(S.damage(records.filter("rec_id = 99"), pages)), S.running_lines(pages)).collect()}
    assert len(got) == 64 and not any("Press" in x or "ACLUB" in x for (_, k), x in got.items() if k < 100)
    assert sum("Strategic Report" in x for x in got.values()) == 11 and got["ocr_pages", 99] == "Own words here."
    assert "Printed by Some Press" in got["ocr_pages", 100] and got["ocr_pages", 101] == "Printed by Some Press"
    assert "It was a good year for us." in got["sections", 7] and "4" not in got["sections", 7]


def counted(spark, scan, times=1, more=()):
    rows = scan[5].forms.collect()
    return spark.createDataFrame([(r["form"], r["n"] * times, r["word"]) for r in rows] + [(w, 1, True) for w in more], "form string, n long, word boolean")


def test_the_channel_is_fitted_on_all_forms(spark, scan):
    """Rates of a lexicon that also holds 150,000 words which are misreads of none are the same."""
    rng = random.Random(8)
    names = {"".join(rng.choices("aou", k=9)) + "x" * (i % 3) for i in range(400_000)}
    more = sorted(names)[:150_000] if len(names) > 150_000 else [f"{x}{y}" for x in sorted(names)[:1000] for y in sorted(names)[-150:]]
    few, many = C.learn(counted(spark, scan)).rates, C.learn(counted(spark, scan, more=more)).rates
    assert set(TRUE) <= set(many)
    for x in TRUE:
        assert many[x] == pytest.approx(few[x], rel=0.1)


def test_letter_model_of_a_table(spark):
    rng = random.Random(4)
    words = list(dict.fromkeys("".join(rng.choices("abdeginorst", k=rng.randint(1, 9))) for _ in range(3000)))
    out = frozenset(words[::40])
    plain = C.Letters.fit(words, out, n_forms=5000)
    table = C.LetterTable(spark.createDataFrame([(w,) for w in words if w not in out], "form string"), 5000)
    asked = [*words[:500], "7up", "𝔸!x"]
    assert table.logs(asked) == pytest.approx(plain.logs(asked), abs=1e-6) and len(table.logs([])) == 0
    assert table.logs(["zzqq"])[0] == pytest.approx(C.Letters.fit(words, out | {"zzqq"}, n_forms=5000).logs(["zzqq"])[0], abs=1e-6)


def test_misreads_are_found_alike_in_a_larger_collection(spark, scan):
    """Thirty times as many pages of the same words: rates of the same size and the same misreads."""

    def read(times):
        forms = counted(spark, scan, times)
        channel = C.learn(forms)
        return channel.rates, {(r["form"], r["word"]) for r in C.decoded_forms(forms, channel, forms.filter("word")).collect()}

    (few, found), (many, again) = read(1), read(30)
    assert set(TRUE) <= set(many) and found <= again
    assert all(0.3 * few[x] < many[x] < 3 * few[x] for x in TRUE)
