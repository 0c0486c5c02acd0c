"""Repair of text from scanned pages.

The text is a stream of characters that a noisy channel has spoilt: characters are read as others,
words are broken at line ends with a mark or at a blank, or run together. Decoding finds the cheapest
path through a lattice of words; a path's cost is the negative log of its words' frequencies in
the collection's pages and of the rates of the confusions, breaks and marks it assumes. Rates of
confusions are learnt (``channel``). Words that are frequent and no misread of others stand as they
are, so the lattice falls into short spots between them: a token, a line end with a mark, or the
neighbours of an unknown word. Readings that need the lexicon meet it in joins by key; only its most
frequent part, at most ``1 / FREQUENT`` words by definition, is given to the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut
from .channel import FREQUENT, Channel, decoded_forms, learn, text_lines
from .lines import MIN_PAGES, MIN_SHARE

# How often a line ends in a mark that belongs to no word, and a blank is lost or added inside a line.
STRAY, LOST, ADDED = 1e-3, 1e-5, 1e-5
# Marks that a scan leaves at the end of a broken line.
MARKS = "-‐¬\xad"
# Running lines of all clubs are sent to the executors up to so many (8 bytes each); beyond that they are
# joined, and the adaptive join splits large clubs.
BROADCAST_KEYS = 4_000_000
# On so many different pages of a filing a line is a running one, if it is among the first or last lines.
RUNNING_PAGES, EDGE = 3, 3
PAGE_NUMBER = r"[^\w\n]*(?:(?:page|pg|p)\b[^\w\n]*)?0*{}(?:\s*(?:of|/)\s*\d+)?[^\w\n]*"


def line_joints(text: str) -> tuple[list[tuple[str, str]], str]:
    """The pieces around each marked line end, and the text without them."""
    joints, rest, done = [], [], 0
    for m in re.finditer("[" + MARKS + r"][ \t]*\n[ \t]*(?=[^\W\d_A-Z])", text):
        low = max(text.rfind(" ", done, m.start()), text.rfind("\n", done, m.start()), done - 1) + 1
        high = m.end()
        while high < len(text) and not text[high].isspace():
            high += 1
        if low < m.start():
            joints.append((text[low : m.start()], text[m.end() : high]))
            rest.append(text[done:low])
            done = high
    rest.append(text[done:])
    return joints, " ".join(rest) if joints else text


def bare(token: str) -> str:
    """Lower case without outer punctuation."""
    outer = ".,;:()[]\"'’?" + MARKS + "–—*"
    return token.rstrip(outer + "!").lstrip(outer).lower()


def is_word(w: str) -> bool:
    return w.isalpha() or (w.replace("-", "").replace("'", "").replace("’", "").isalpha() and not w.isalpha())


def form_of(token: str) -> str | None:
    """What a token is counted as: a word, a form with letters and other signs, or NULL."""
    w, edge = bare(token), token.strip(".,;:()[]\"'’?").lower()
    if w and is_word(w) and edge.strip("!") == edge:
        return w
    return edge if len(edge) > 1 and any(map(str.isalpha, edge)) else None  # a final or first ! may be a letter


def lexicon(pages: DataFrame, text: str = "text") -> DataFrame:
    """(form, n, word): what stands in all pages. ``word`` is true for letters with inner hyphens or
    apostrophes, false for forms with other signs among their letters.

    Counted inside each batch first, so what is shuffled grows with the vocabulary, not the text.
    Pieces of words broken at line ends are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: Counter[str] = Counter()
            for x in batch.column(0).to_pylist():
                if x:
                    raw.update(line_joints(x)[1].split())
            forms: Counter[str] = Counter()
            for token, n in raw.items():
                f = form_of(token)
                if f is not None:
                    forms[f] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(forms), pa.string()), pa.array(list(forms.values()), pa.int64()), pa.array([is_word(f) for f in forms], pa.bool_())], names=["form", "n", "word"])

    rows = pages.select(text).mapInArrow(count, "form string, n long, word boolean")
    return rows.groupBy("form", "word").agg(F.sum("n").alias("n")).select("form", "n", "word")


FOUND = "tab string, rec_id long, kind string, wrong string, word string, known int, other int"


def suspects(records: DataFrame, frequent: list[str], channel: Channel) -> DataFrame:
    """(tab, rec_id, kind, wrong, word, known, other): all spots that the lexicon has to judge.

    ``records``: (tab, rec_id, page, text). Kind split: the pieces around a marked line end; form: a
    token that is no ``frequent`` word and holds what a learnt confusion reads, with the number of
    frequent words of its line and of its other words; page_no: the page's own number.
    """
    shared = records.sparkSession.sparkContext.broadcast((frozenset(frequent), sorted({b for _, b in channel.rates})))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, reads = shared.value
        signs = re.escape("".join({c for b in reads for c in b if not c.isalpha()}) or "\0")
        possible = re.compile(rf"(?:[^\W\d_]|[{signs}])+")
        state: dict[str, tuple[int, str]] = {}  # 0 frequent, 1 no word, 2 other word, 3 perhaps misread

        def judge(token: str) -> tuple[int, str]:
            f = form_of(token)
            if f is None:
                return 1, ""
            if f in words or f.strip("!") in words:
                return 0, f.strip("!")
            return (3 if possible.fullmatch(f) and any(b in f for b in reads) else 2), f

        for batch in batches:
            out: list[tuple] = []
            for tab, rec, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                joints, rest = line_joints(text)
                for a, b in joints:
                    x, y = bare(a), bare(b)
                    if x and y:
                        out.append((tab, rec, "split", f"{x}-{y}", x + y, 0, 0))
                for line in rest.split("\n"):
                    found, known, other = [], 0, 0
                    for token in line.split():
                        s = state.get(token)
                        if s is None:
                            if len(state) > 500_000:
                                state.clear()
                            s = state[token] = judge(token)
                        if s[0] == 0:
                            known += 1
                        elif s[0] > 1:
                            other += 1
                            if s[0] == 3:
                                found.append(s[1])
                    out += [(tab, rec, "form", f, f, known, other - 1) for f in found]
                if page is not None:
                    number = re.compile(PAGE_NUMBER.format(page), re.IGNORECASE)
                    lines = [y for x in text.split("\n") if (y := x.strip())]
                    for line in {lines[0], lines[-1]} if lines else ():
                        if number.fullmatch(line):
                            out.append((tab, rec, "page_no", line, line, 0, 0))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tab", "rec_id", "kind", "wrong", "word", "known", "other"])

    return records.select("tab", F.col("rec_id").cast("long"), "page", "text").mapInArrow(find, FOUND)


def joined(spots: DataFrame, words: DataFrame, channel: Channel) -> DataFrame:
    """(wrong, word): of distinct (wrong, word) spots around marked line ends those that are one word.

    The lattice of a spot: the pieces as one word, as it stands or with one misread undone; as a word
    that has a hyphen; as two words and a stray mark; or as a word that nobody has seen. A path's cost
    is that of its words and of what happened to them; the cheapest path decides.
    """
    shared = spots.sparkSession.sparkContext.broadcast(channel.state())
    edge = "wrong string, role string, item string, rate double"

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Channel.of(shared.value)
        for batch in batches:
            out: list[tuple] = []
            new = math.log(max(model.hapaxes, 1) / max(model.tokens, 1)) - math.log(max(model.letters.n_forms, 2))
            for wrong, whole, own in zip(*(c.to_pylist() for c in batch.columns)):
                if not whole.isalpha() or len(whole) > 2 * 64:
                    continue
                x = next(wrong[:i] for i in range(len(wrong)) if wrong[i] == "-" and wrong[:i] + wrong[i + 1 :] == whole)
                out += [(wrong, "one", whole, 0.0), (wrong, "hyphen", wrong, 0.0), (wrong, "left", x, 0.0), (wrong, "right", whole[len(x) :], math.log(STRAY)), (wrong, "new", "", new + own)]
                out += [(wrong, "one", r, rate) for r, rate in model.undone(whole).items()]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64()))], names=["wrong", "role", "item", "rate"])

    def cheapest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = math.log(max(Channel.of(shared.value).tokens, 1))
        for batch in batches:
            out = []
            for wrong, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cost = {(e["role"], e["item"]): -e["rate"] - (math.log(e["n"]) - total if e["role"] != "new" else 0.0) for e in found}
                paths = [(c, role, item) for (role, item), c in cost.items() if role in ("one", "hyphen", "new")]
                sides = [min((c for (role, _), c in cost.items() if role == side), default=math.inf) for side in ("left", "right")]
                best = min([*paths, (sum(sides), "two", "")])
                if best[1] == "one":
                    out.append((wrong, best[2]))
            columns = list(zip(*out)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["wrong", "word"])

    own = channel.letters.of(spots.select(F.col("word").alias("form")).distinct()).withColumnRenamed("form", "word")
    some = spots.join(own, "word").select("wrong", "word", "own").mapInArrow(edges, edge)
    counts = words.select(F.col("form").alias("item"), "n")
    met = some.join(counts, "item", "left").filter("n is not null or role = 'new'")
    lattices = met.groupBy("wrong").agg(F.collect_list(F.struct("role", "item", "rate", "n")).alias("edges"))
    return lattices.mapInArrow(cheapest, "wrong string, word string")


class Decoder:
    """What ``damage`` and ``repaired`` share: the lexicon, the channel and the decoded forms."""

    def __init__(self, pages: DataFrame):
        self.forms = cut(lexicon(pages))
        self.channel = learn(self.forms)
        self.words = self.forms.filter("word").select("form", "n")
        self.wrong = cut(decoded_forms(self.forms, self.channel, self.words))
        self.right = self.words.join(self.wrong.select("form"), "form", "left_anti")
        sure = self.right.filter(F.col("n") >= max(2.0, FREQUENT * self.channel.tokens))
        self.frequent = {r[0]: r[1] for r in sure.select("form", "n").toLocalIterator()}


def damage(records: DataFrame, pages: DataFrame, decoder: Decoder | None = None) -> DataFrame:
    """(tab, rec_id, kind, wrong, word): what is damaged in each record and what it should be.

    ``kind`` is split, misread or page_no. ``records``: (tab, rec_id, page, text), ``page`` NULL where
    the record is no page; ``pages`` gives the lexicon. Repeated records give their rows once. NULL
    and empty texts give none. A form is read alike wherever it stands; a line that is more likely
    rubbish than text, by its known and its other words, is not decoded.
    """
    d = decoder or Decoder(pages)
    found = cut(suspects(records, list(d.frequent), d.channel).distinct())
    forms = found.filter("kind = 'form'")
    counts = forms.groupBy(F.least("known", F.lit(63)).alias("s"), F.least("other", F.lit(63)).alias("o")).agg(F.count("*").alias("w")).collect()
    known, other, constant = text_lines([tuple(r) for r in counts])
    text = F.col("known") * known + F.col("other") * other + constant >= 0
    # forms that stand in no page are decoded by their own count
    rest = forms.groupBy(F.col("wrong").alias("form")).agg(F.count("*").alias("n")).join(d.forms.select("form"), "form", "left_anti")
    wrong = d.wrong.unionByName(decoded_forms(rest, d.channel, d.words))
    misread = forms.filter(text).join(wrong.select(F.col("form").alias("wrong"), F.col("word").alias("right")), "wrong")
    misread = misread.select("tab", "rec_id", F.lit("misread").alias("kind"), "wrong", F.col("right").alias("word")).distinct()
    spots = found.filter("kind = 'split'")
    whole = joined(spots.select("wrong", "word").distinct(), d.right, d.channel)
    split = spots.drop("word").join(whole, "wrong")
    names = ["tab", "rec_id", "kind", "wrong", "word"]
    return split.select(*names).unionByName(misread.select(*names)).unionByName(found.filter("kind = 'page_no'").select(*names))


def page_records(pages: DataFrame, sections: DataFrame, *more: str) -> DataFrame:
    """(tab, rec_id, page, text) of all pages and all strategic reports, and ``more`` columns."""
    a = pages.select(F.lit("ocr_pages").alias("tab"), F.col("page_id").alias("rec_id"), "page", "text", *more)
    b = sections.filter("section = 'strategic_report'").select(F.lit("sections").alias("tab"), F.col("section_id").alias("rec_id"), F.lit(None).cast("int").alias("page"), "text", *more)
    return a.unionByName(b)


_letters, _figure = re.compile(r"[^\W\d_]{3,}"), re.compile(r"\d")
_row = re.compile(r"\d[,.]?\d{3},?\d|\d[,.]\d|\d\W* \W*\d")
_no_figures = str.maketrans("", "", "0123456789")


def line_hash(line: str) -> int:
    """64-bit hash of a line without case and white-space runs."""
    import xxhash

    return xxhash.xxh3_64_intdigest(" ".join(line.lower().split())) - (1 << 63)


def line_key(line: str) -> int | None:
    """``line_hash``; NULL unless the line holds two words, and for rows of figures."""
    first = _letters.search(line)
    if first is None or _letters.search(line, first.end()) is None:
        return None
    if _figure.search(line) and _row.search(" ".join(line.split())):
        return None
    return line_hash(line)


def running_lines(pages: DataFrame) -> DataFrame:
    """(club, running): the ``line_key`` of every running line of a club.

    A line runs if it stands on as many pages of the club as problem 4 asks, or on several pages of a
    filing (a heading stands on one), mostly among their first or last ``EDGE`` lines. Pages scanned
    again count once in a filing.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, edges = [], []
            for text in batch.column(5).to_pylist():
                rows = [line_key(x) for x in (text or "").split("\n") if x.strip()]
                out.append(list({k for k in rows if k is not None}))
                edges.append(list({k for k in rows[:EDGE] + rows[-EDGE:] if k is not None}))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (out, edges)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *lists], names=["page_id", "club", "company_number", "year", "page", "keys", "edges"])

    rows = pages.filter("club is not null").select(F.col("page_id").cast("long"), "club", "company_number", "year", F.col("page").cast("int"), "text")
    listed = cut(rows.mapInArrow(keys, "page_id long, club string, company_number string, year string, page int, keys array<long>, edges array<long>").dropDuplicates(["page_id"]))
    totals = listed.groupBy("club").agg(F.count("*").alias("pages"))
    each = listed.select("club", "company_number", "year", "page", "edges", F.explode("keys").alias("k")).withColumn("edge", F.array_contains("edges", F.col("k")).cast("int"))
    of_page = each.groupBy("club", "company_number", "year", "k", "page").agg(F.count("*").alias("n"), F.sum("edge").alias("edge"))
    of_filing = of_page.groupBy("club", "company_number", "year", "k").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"), F.count("page").alias("in_filing"))
    of_club = of_filing.groupBy("club", "k").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"), F.max("in_filing").alias("most"), F.avg("in_filing").alias("mean"))
    often = (F.col("n") >= MIN_PAGES) & (F.col("n") * MIN_SHARE >= F.col("pages"))
    head = (F.col("most") >= RUNNING_PAGES) & (F.col("mean") >= 2) & (F.col("edge") * 2 > F.col("n"))
    found = of_club.join(totals, "club").filter(often | head)
    return found.groupBy("club").agg(F.collect_list("k").alias("running"))


def paragraphs(lines: list[str]) -> list[str]:
    """Lines into paragraphs: the cheapest path over line ends, by dynamic programming.

    Each line is prose or layout (heading, table row). Prose continues over a line end unless a blank
    line, a full stop at a short line or a change of kind makes a break cheaper; layout lines
    stand alone.
    """
    rows = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
    if not rows:
        return []
    width = max(len(x) for _, x in rows)

    def layout(x: str) -> float:
        figures = 1 - len(x.translate(_no_figures)) / len(x) if _figure.search(x) else 0.0
        return 2.0 * (figures > 0.25) + 1.0 * (len(x) < 0.5 * width and x[-1] not in ".!?,;") - 0.5 - 1.0 * (len(x) > 0.7 * width)

    own_cost = [layout(x) for _, x in rows]
    prose, apart = own_cost[0], -own_cost[0]
    back: list[tuple[tuple[str, bool], str]] = []
    for (i, a), (j, b), cost in zip(rows, rows[1:], own_cost[1:]):
        gap = j - i > 1
        ends = a[-1] in ".!?:" and (len(a) < 0.75 * width or gap)
        fresh = prose + (0.0 if ends else 0.6 if gap else 1.2)
        goes_on = prose + (1.5 if ends else 0.9 if gap and b[:1].isupper() else 0.0)
        low, how = (apart, ("layout", True)) if apart <= fresh and apart <= goes_on else (goes_on, ("prose", False)) if goes_on <= fresh else (fresh, ("prose", True))
        back.append((how, "layout" if apart <= prose else "prose"))
        prose, apart = low + cost, min(apart, prose) - cost
    state, breaks = "prose" if prose <= apart else "layout", []
    for how, before in reversed(back):
        state, fresh = how if state == "prose" else (before, True)
        breaks.append(fresh)
    out = [rows[0][1]]
    for (_, x), fresh in zip(rows[1:], reversed(breaks)):
        if fresh:
            out.append(x)
        else:
            out[-1] += " " + x
    return out


def page_number_lines(lines: list[str]) -> set[int]:
    """Places of the page numbers in a text of several pages.

    A number dressed with a word or with marks on both sides is one. A plain number is one at the
    edge of the text, or if it goes on rising by small steps with text between.
    """
    dress = re.compile(r"([^\w\n]*)((?:page|pg|p)\b[^\w\n]*)?(\d{1,4})(?:\s*(?:of|/)\s*\d+)?([^\w\n]*)", re.IGNORECASE)
    full = [i for i, x in enumerate(lines) if x.strip()]
    out: set[int] = set()
    plain: dict[str, list[tuple[int, int]]] = {}
    for at, i in enumerate(full):
        m = dress.fullmatch(lines[i].strip())
        if m is None or set(m[1] + m[4]) & set("£$€%()"):
            continue
        if m[2] or (m[1] and m[4]) or at in (0, len(full) - 1):
            out.add(i)
        plain.setdefault(m[1] + "#" + m[4], []).append((at, int(m[3])))
    for found in plain.values():
        for (a, m), (b, n) in zip(found, found[1:]):
            if b - a > 4 and 0 < n - m <= 3:
                out |= {full[a], full[b]}
    return out


class Stream:
    """Decodes the words of a de-lined paragraph: blanks that were lost or added beside unknown words.

    Viterbi over the tokens: a token stands as it is, falls into two frequent words, or joins the
    next one to a frequent word. Unknown tokens pay what the letter model asks for a new word.
    ``logs``: what it says of words, at least of all that ``open_words`` names in the text; for any
    other word the price is the same on every path. Without it the channel's model is asked.
    """

    def __init__(self, counts: dict[str, int], channel: Channel, logs: dict[str, float] | None = None):
        self.counts, self.channel, self.logs = counts, channel, logs
        self.total = math.log(max(channel.tokens, 2))
        self.new = math.log(max(channel.hapaxes, 1)) - self.total - math.log(max(channel.letters.n_forms, 2))
        self.memo: dict[str, tuple[float, str | None]] = {}
        self.seen: dict[str, bool] = {}

    def cost(self, w: str) -> float:
        n = self.counts.get(w)
        return self.total - math.log(n) if n else math.inf

    def learn(self, texts: list[str | None]) -> None:
        """Judges all unknown words of a batch of texts at once."""
        new = {w for x in texts if x for t in set(x.split()) if t.isalpha() and (w := t.lower()) not in self.counts and w not in self.memo}
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.judge(list(new))

    def judge(self, words: list[str]) -> None:
        counts = self.counts
        logs = self.channel.letters.logs(words).tolist() if self.logs is None else [self.logs.get(w, 0.0) for w in words]
        for w, log in zip(words, logs):
            best, parts = -self.new - log, None
            for i in range(2, len(w) - 1) if len(w) <= 64 else ():
                if w[:i] in counts and w[i:] in counts:
                    c = self.cost(w[:i]) + self.cost(w[i:]) - math.log(LOST)
                    if c < best:
                        best, parts = c, f"{w[:i]} {w[i:]}"
            self.memo[w] = best, parts

    def decode(self, paragraph: str) -> str:
        """The least-cost path through each spot: unknown words in a row and their neighbours."""
        tokens, seen = paragraph.split(" "), self.seen
        unknown = []
        for i, t in enumerate(tokens):
            new = seen.get(t)
            if new is None:
                if len(seen) > 500_000:
                    seen.clear()
                new = seen[t] = t.isalpha() and t.lower() not in self.counts
            if new:
                unknown.append(i)
        if not unknown:
            return paragraph
        out, done, at = [], 0, 0
        while at < len(unknown):
            first = last = unknown[at]
            while at + 1 < len(unknown) and unknown[at + 1] <= last + 1:
                at += 1
                last = unknown[at]
            at += 1
            low, high = max(first - 1, done), min(last + 2, len(tokens))
            out += tokens[done:low]
            out += self.path(tokens[low:high])
            done = high
        return " ".join(out + tokens[done:])

    def path(self, tokens: list[str]) -> list[str]:
        plain = [t.lower() if t.isalpha() else None for t in tokens]
        best: list[tuple[float, int, str]] = [(0.0, 0, "")]
        for i, (t, b) in enumerate(zip(tokens, plain)):
            if b is None or b in self.counts:
                choice = (best[i][0] + (self.cost(b) if b else 0.0), i, t)
            else:
                if b not in self.memo:
                    self.judge([b])
                c, parts = self.memo[b]
                k = parts.index(" ") if parts else 0
                choice = (best[i][0] + c, i, f"{t[:k]} {t[k:]}" if parts else t)
            before = plain[i - 1] if i else None
            if b is not None and before is not None and (before + b) in self.counts and not (b in self.counts and before in self.counts):
                choice = min(choice, (best[i - 1][0] + self.cost(before + b) - math.log(ADDED), i - 1, tokens[i - 1] + t))
            best.append(choice)
        out, i = [], len(tokens)
        while i:
            out.append(best[i][2])
            i = best[i][1]
        return out[::-1]


def open_words(records: DataFrame, frequent: list[str]) -> DataFrame:
    """(form): the words of the records' texts that are not frequent, but two frequent ones or the start or
    the end of one: only at these a ``Stream`` has a choice."""
    shared = records.sparkSession.sparkContext.broadcast(sorted(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        heads = shared.value
        words, tails = frozenset(heads), sorted(w[::-1] for w in heads)

        def begins(w: str, rows: list[str]) -> bool:
            at = bisect_right(rows, w)
            return at < len(rows) and rows[at].startswith(w)

        seen: set[str] = set()
        for batch in batches:
            if len(seen) > 500_000:
                seen.clear()
            new = {t.lower() for t in set().union(*(x.split() for x in batch.column(0).to_pylist() if x)) if t.isalpha()} - seen - words
            seen |= new
            out = [w for w in new if begins(w, heads) or begins(w[::-1], tails) or (len(w) <= 64 and any(w[:i] in words and w[i:] in words for i in range(2, len(w) - 1)))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["form"])

    return records.select("text").mapInArrow(run, "form string").distinct()


_token = re.compile(r"\S+")
_line_end = re.compile("[" + MARKS + r"][ \t]*\n[ \t]*(?=[^\W\d_A-Z])")


def repair(text: str, fixes: dict[str, str], drop: set[str], running: frozenset[int] | set[int] = frozenset(), report: bool = False, stream: Stream | None = None) -> str:
    """One text: broken words joined, misread words put right in their case, furniture dropped.

    ``running``: keys of lines to drop, as they stand or after their words are put right. ``report``:
    the text has several pages and their numbers.
    """

    def cased(old: str, new: str) -> str:
        letters = [c for c in old if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            return new.upper()
        return new[:1].upper() + new[1:] if old[:1].isupper() else new

    def whole(a: str, b: str) -> str:
        x, y = bare(a), bare(b)
        word = fixes.get(f"{x}-{y}") if x and y else None
        if word is None:
            return f"{a}-{b}\n"
        head, tail = a.lower().find(x), b.lower().find(y) + len(y)
        return a[:head] + cased(a[head:], word) + b[tail:] + "\n"

    def token(m: re.Match[str]) -> str:
        old = m[0]
        for core in (old.strip(".,;:()[]\"'’?").lower(), bare(old)):
            if core and core in fixes and old.lower().find(core) >= 0:
                at = old.lower().find(core)
                return old[:at] + cased(old[at : at + len(core)], fixes[core]) + old[at + len(core) :]
        return old

    def mended(x: str) -> str:
        """A line with its words put right; most lines hold none of them."""
        low = x.lower() if fixes else ""
        return _token.sub(token, x) if any(k in low for k in fixes) else x

    def runs(x: str) -> bool:
        # only keys of lines that can run are in the set: a line's own hash tells
        return bool(running) and (line_hash(x) in running or (y := mended(x)) is not x and line_hash(y) in running)

    rows = text.split("\n")
    numbers = page_number_lines(rows) if report else set()
    kept = "\n".join(x for i, x in enumerate(rows) if i not in numbers and x.strip() not in drop and (not x.strip() or any(map(str.isalnum, x))) and not runs(x))
    parts, done = [], 0
    for m in _line_end.finditer(kept):
        low = max(kept.rfind(" ", done, m.start()), kept.rfind("\n", done, m.start()), kept.rfind("\t", done, m.start()), done - 1) + 1
        if low >= m.start():
            continue
        high = m.end()
        while high < len(kept) and not kept[high].isspace():
            high += 1
        parts += [kept[done:low], whole(kept[low : m.start()], kept[m.end() : high])]
        while high < len(kept) and kept[high] in " \t":
            high += 1
        done = high + (kept[high : high + 1] == "\n")
    kept = "".join([*parts, kept[done:]])
    whole_text = paragraphs([mended(x) for x in kept.split("\n")])
    return "\n\n".join(stream.decode(x) if stream else x for x in whole_text)


def repaired(records: DataFrame, found: DataFrame, running: DataFrame | None = None, decoder: Decoder | None = None) -> DataFrame:
    """(tab, rec_id, text, n_fixes): each record once, as continuous paragraphs.

    ``found`` is the result of ``damage``; ``running`` that of ``running_lines``, for records with a
    club; ``decoder`` lets blanks that were lost or added be decoded, too. Records without a page have the page numbers inside dropped. A text is shuffled once to meet
    its own few fixes. NULL texts stay NULL, empty ones ''.
    """
    fixes = found.groupBy("tab", "rec_id").agg(
        F.map_from_entries(F.collect_set(F.when(F.col("kind") != "page_no", F.struct("wrong", "word")))).alias("fixes"),
        F.collect_set(F.when(F.col("kind") == "page_no", F.col("word"))).alias("drop"),
        F.count("*").cast("int").alias("n"),
    )

    plain = None
    if decoder:
        logs = {r[0]: r[1] for r in decoder.channel.letters.of(cut(open_words(records, list(decoder.frequent)))).toLocalIterator()}
        plain = decoder.frequent, decoder.channel.state(), logs
    shared = records.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(shared.value[0], Channel.of(shared.value[1]), shared.value[2]) if shared.value else None
        for batch in batches:
            texts = []
            sets: dict[str, set[int]] = {}
            if stream:
                stream.learn(batch.column(2).to_pylist())
            for text, fix, drop, page, club, keys in zip(*(c.to_pylist() for c in [*batch.columns[2:5], *batch.columns[6:8]]), batch.column(8)):
                if club not in sets:
                    sets[club] = set(keys.as_py() or ())
                texts.append(repair(text, dict(fix or ()), set(drop or ()), sets[club], page is None, stream) if text else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(5)], names=["tab", "rec_id", "text", "n_fixes"])

    rows = records.dropDuplicates(["tab", "rec_id"]).join(fixes, ["tab", "rec_id"], "left")
    if running is None:
        rows = rows.withColumns({"club": F.lit(None).cast("string"), "running": F.lit(None).cast("array<long>")})
    else:
        running = cut(running)
        keys = running.agg(F.sum(F.size("running"))).first()[0] or 0
        rows = rows.join(F.broadcast(running) if keys <= BROADCAST_KEYS else running, "club", "left")
    rows = rows.select("tab", F.col("rec_id").cast("long"), "text", "fixes", "drop", F.coalesce("n", F.lit(0)).alias("n"), "page", "club", "running")
    return rows.mapInArrow(run, "tab string, rec_id long, text string, n_fixes int")
