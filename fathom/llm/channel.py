"""The noisy channel of a scan, learnt from the collection's own words.

A scan reads one or two characters of a word as others, always in the same few ways. Each form that is
seen is either a word of its own or a misread of a more frequent word; which of the two, and through
which confusion, is latent, and expectation-maximisation over pairs of forms finds the rates of the
confusions that explain most. Two models meet in every decision:

- misread: the right word's count times the rate of the confusion gives how often the form should be
  seen; single misreads follow a Poisson law, a page that is repeated repeats its misread, so a part
  of them comes in clusters (a negative binomial law of the same mean), and words differ in their
  rates, so another part spreads in proportion to the mean (geometric laws), however large it is;
- own word: a letter model of the forms (orders 0 to 5, each form left out of its own estimate) says
  how likely such a word is among all, or as often letters at random do (rubbish, whose short words
  come near to frequent ones the more the larger a collection is); a word's count falls with its
  square (Zipf).

Nothing here depends on absolute counts: a form that is seen once is judged by the same odds as one
that is seen a thousand times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut

# The channel is fitted on all forms against the words that are at least a FREQUENT share of all, which
# are at most 1 / FREQUENT.
FREQUENT = 2e-6
ORDER, ALPHABET = 5, 64
# How a misread is expected before anything is learnt, and at most; the share and mean size of clusters.
START_RATE, MOST_RATE, CLUSTERED, CLUSTER = 1e-4, 2e-3, 0.2, 20.0
# The rates of single words differ from their confusion's: the share of misreads for which they do, and by
# what factors, with the part of each (the mean factor is 1). Counts of a large collection show it, whatever its size.
VARIED, FACTORS = 0.2, ((8.0, 0.06), (1.0, 0.46), (0.125, 0.48))
# A line that a source repeats everywhere repeats its misread without bound: the share of misreads whose
# counts fall like those of words. Not while the confusions are learnt, where it would let names pass.
REPEATED = 0.2
# A confusion must explain the forms better than without it by its own description in nats, and no
# single form may speak for it with more than five.
DESCRIPTION, ONE_FORM = 4 * math.log(40), 5.0
ROUNDS, STEPS = 3, 8
# A second confusion in a word is tried where the form is less likely than this as a word of its own.
SECOND = -10.0
# How often a word in a line of rubbish is a known one.
CHANCE = 0.1
# No word is longer: a longer token stays as it stands.
LONGEST = 64


def likely(k: np.ndarray, mean: np.ndarray, repeated: float = 0.0) -> np.ndarray:
    """Probability of seeing a form ``k`` times as a misread that is expected ``mean`` times."""
    mean = np.maximum(mean, 1e-300)
    r = mean / CLUSTER
    single = np.exp(-mean + k * np.log(mean) - _lgamma(k + 1))
    cluster = np.exp(_lgamma(k + r) - _lgamma(k + 1) - _lgamma(r) + k * math.log(CLUSTER / (CLUSTER + 1)) - r * math.log(CLUSTER + 1))
    varied = sum(part * np.exp(k * np.log(f * mean / (1 + f * mean)) - np.log1p(f * mean)) for f, part in FACTORS)
    once = (1 - CLUSTERED - VARIED) * single + CLUSTERED * cluster + VARIED * varied
    return (1 - repeated) * once + repeated * -np.expm1(-mean) / (np.maximum(k, 1) * (k + 1)) if repeated else once


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted up for small arguments."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    small = x < 8
    y = np.where(small, x + 8, x)
    for i in range(8):
        shift = shift + np.where(small, np.log(np.maximum(x + i, 1e-300)), 0.0)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 for a key that is not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


@dataclass
class Letters:
    """Witten-Bell letter model: counts of grams, and of what follows each context, under sorted hashes.

    A model in memory, of a list of forms. ``LetterTable`` is the same of a table.
    """

    grams_: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    left_out: frozenset[str]
    n_forms: int

    @staticmethod
    def places(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all forms in a row with their edge signs, the form of each, and its place in it."""
        codes = np.frombuffer("".join(f"^{f}$" for f in forms).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.fromiter((len(f) + 2 for f in forms), np.int64, len(forms))
        owner = np.repeat(np.arange(len(forms)), sizes)
        return codes, owner, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    @staticmethod
    def grams(codes: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: where it fits, and hashes of the gram and of the letters before its last."""
        at = np.flatnonzero(place > 0)
        before = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
        for order in range(ORDER + 1):
            if order:
                fits = place[at] >= order
                at, before = at[fits], before[fits]
                before = (before ^ codes[at - order]) * np.uint64(0xD6E8FEB86659FD93)
                before ^= before >> np.uint64(29)
            gram = (before ^ (codes[at] + np.uint64(0x51ED27))) * np.uint64(0xA0761D6478BD642F)
            yield order, at, gram ^ gram >> np.uint64(32), before

    @classmethod
    def fit(cls, forms: list[str], left_out: frozenset[str] = frozenset(), n_forms: int | None = None) -> Letters:
        used = [f for f in forms if f not in left_out]
        codes, _, place = cls.places(used)
        parts = []
        for _, _, gram, before in cls.grams(codes, place) if used else ():
            grams, first, counts = np.unique(gram, return_index=True, return_counts=True)
            contexts, totals = np.unique(before, return_counts=True)
            kinds = np.bincount(np.searchsorted(contexts, before[first]), minlength=len(contexts))
            parts.append((grams, counts.astype(np.int32), contexts, totals.astype(np.int32), kinds.astype(np.int32)))
        parts = parts or [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) * 2 + (np.zeros(0, np.int32),)]
        grams, counts, contexts, totals, kinds = (np.concatenate(x) for x in zip(*parts))
        a, b = np.argsort(grams), np.argsort(contexts)
        return cls(grams[a], counts[a], contexts[b], totals[b], kinds[b], left_out, n_forms or len(forms))

    def logs(self, forms: list[str]) -> np.ndarray:
        """Log of how many such forms all the collection's forms should hold, at most 0."""
        if not forms:
            return np.zeros(0)
        codes, owner, place = self.places(forms)
        own = np.fromiter((f not in self.left_out and all(c.isalpha() or c in "-'’" for c in f) for f in forms), np.int64, len(forms))
        p = np.full(len(codes), 1.0 / ALPHABET)
        sizes = np.fromiter((len(f) + 1 for f in forms), np.int64, len(forms))
        for order, at, gram, before in self.grams(codes, place):
            mine = own[owner[at]]
            n = look_up(self.grams_, self.counts, gram) - mine
            total = look_up(self.contexts, self.totals, before) - mine * (1 if order else sizes[owner[at]])
            kinds = look_up(self.contexts, self.kinds, before) - mine * (n == 0)
            some = (total > 0) & (kinds > 0)
            p[at] = np.where(some, (np.maximum(n, 0) + kinds * p[at]) / np.maximum(total + kinds, 1), p[at])
            single = p.copy() if order == 0 else single
        logs, plain = np.zeros(len(forms)), np.zeros(len(forms))
        np.add.at(logs, owner[place > 0], np.log(p[place > 0]))
        np.add.at(plain, owner[place > 0], np.log(single[place > 0]))
        return np.minimum(np.logaddexp(logs, plain) + math.log(max(self.n_forms, 2) / 2), 0.0)

    def of(self, asked: DataFrame) -> DataFrame:
        """(form, own): the ``logs`` of distinct forms."""
        names = ("grams_", "counts", "contexts", "totals", "kinds", "left_out", "n_forms")
        shared = asked.sparkSession.sparkContext.broadcast(tuple(getattr(self, x) for x in names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Letters(*shared.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.logs(batch.column(0).to_pylist()), pa.float64())], names=["form", "own"])

        return asked.select("form").mapInArrow(run, "form string, own double")


# Letters of a gram are packed three to a number; each is its code point plus one, 0 for none.
BITS = 21
# Places of letters that one task of the letter model holds, about.
TASK_PLACES = 250_000
# Logs are added as whole numbers of this part, so a sum does not depend on its order.
PART = 1e-9


class LetterTable:
    """``Letters`` of all words of a table: no part of the model but its pairs of letters is in one place.

    Each place of a letter is one row, with up to ``ORDER`` letters before it. Grams of two and more letters
    before the last are counted where all places with the same two letters before meet; the counts of
    single letters and pairs, at most the square of the alphabet, are sent along.
    """

    def __init__(self, known: DataFrame, n_forms: int):
        """``known``: (form), the distinct words the model is made of; ``n_forms``: of the collection."""
        self.known, self.n_forms = known.select("form"), n_forms
        self.pairs: tuple[np.ndarray, np.ndarray] | None = None

    def of(self, asked: DataFrame) -> DataFrame:
        """(form, own): the log of how many such forms all the collection's forms should hold, at most
        0, for distinct forms; a form of the model is left out of its own estimate."""
        if self.pairs is None:
            two = _places(self.known.select("form", F.lit(1).alias("n"), F.lit(False).alias("asked"))).groupBy(F.col("b").bitwiseAND((1 << 2 * BITS) - 1).alias("two")).agg(F.sum("n").alias("n")).orderBy("two").toArrow()
            self.pairs = two.column("two").to_numpy(), two.column("n").to_numpy()
        shared = asked.sparkSession.sparkContext.broadcast(self.pairs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = pa.Table.from_batches(batches) if (batches := [x for x in batches if x.num_rows]) else None
            if got is None:
                return
            a, b, n, size = (got.column(c).to_numpy() for c in ("a", "b", "n", "size"))
            here = np.flatnonzero(got.column("form").is_valid().to_numpy())
            plain, full = (pa.array(np.rint(np.log(p) / PART).astype(np.int64)) for p in _chances(a, b, n, size, here, *shared.value))
            for part in got.select(["form"]).take(pa.array(here)).add_column(1, "log", full).add_column(2, "plain", plain).to_batches():
                yield part

        both = self.known.select("form", F.lit(1).alias("n"), F.lit(False).alias("asked")).unionByName(asked.select("form", F.lit(0).alias("n"), F.lit(True).alias("asked")))
        rows = _places(both.groupBy("form").agg(F.max("n").alias("n"), F.max("asked").alias("asked")))
        tasks = max(1, math.ceil(10 * self.n_forms / TASK_PLACES))
        logs = rows.repartition(tasks, F.shiftright("b", BITS)).mapInArrow(run, "form string, log long, plain long")
        sums = logs.groupBy("form").agg((F.sum("log") * F.lit(PART)).alias("log"), (F.sum("plain") * F.lit(PART)).alias("plain"))
        both = F.greatest("log", "plain") + F.log1p(F.exp(-F.abs(F.col("log") - F.col("plain"))))
        return sums.select("form", F.least(both + F.lit(math.log(max(self.n_forms, 2) / 2)), F.lit(0.0)).alias("own"))

    def logs(self, forms: list[str]) -> np.ndarray:
        """The same of a few forms."""
        if not forms:
            return np.zeros(0)
        asked = self.known.sparkSession.createDataFrame([(f,) for f in set(forms)], "form string")
        found = {r[0]: r[1] for r in self.of(asked).collect()}
        return np.array([found[f] for f in forms])


def _places(rows: DataFrame) -> DataFrame:
    """(a, b, form, n, size) of (form, n, asked): a letter with the two before it in ``b`` and three more in
    ``a``. ``n``: how often the model has it there; ``form`` NULL unless asked for, alike places added up
    then; ``size``: places of the form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            forms = batch.column(0)
            codes, owner, place = Letters.places(forms.to_pylist())
            at = np.flatnonzero(place > 0)
            owner, place = owner[at], place[at]
            codes = codes.astype(np.int64) + 1
            x = [np.where(place >= j, codes[at - j], 0) for j in range(ORDER + 1)]
            a, b = x[5] << 2 * BITS | x[4] << BITS | x[3], x[2] << 2 * BITS | x[1] << BITS | x[0]
            n = batch.column(1).to_numpy().astype(np.int64)[owner]
            asked = batch.column(2).to_numpy(zero_copy_only=False)[owner]
            size = np.bincount(owner, minlength=batch.num_rows)[owner]
            rest = np.flatnonzero(~asked)
            both = np.empty(len(rest), [("a", np.int64), ("b", np.int64)])
            both["a"], both["b"] = a[rest], b[rest]
            kinds, times = np.unique(both, return_counts=True)
            some = np.flatnonzero(asked)
            columns = [np.concatenate(c) for c in ((a[some], kinds["a"]), (b[some], kinds["b"]), (n[some], times), (size[some], np.zeros(len(kinds), np.int64)))]
            names = pa.concat_arrays([forms.take(pa.array(owner[some])).cast(pa.string()), pa.nulls(len(kinds), pa.string())])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:2]), names, *map(pa.array, columns[2:])], names=["a", "b", "form", "n", "size"])

    return rows.select("form", "n", "asked").mapInArrow(run, "a long, b long, form string, n long, size long")


def _chances(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: np.ndarray, here: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the letters in the rows ``here``, alone and after those before them; all rows with
    the same two letters before are given."""
    mask = (1 << BITS) - 1
    last, mine = b[here] & mask, n[here]
    letters, no = np.unique(pairs & mask, return_inverse=True)
    one = np.bincount(no, times, len(letters)).astype(np.int64)
    firsts, no = np.unique(pairs >> BITS, return_inverse=True)
    totals, kinds_ = np.bincount(no, times, len(firsts)).astype(np.int64), np.bincount(no, minlength=len(firsts))

    def mixed(p: np.ndarray, seen: np.ndarray, total: np.ndarray, kinds: np.ndarray, out: int | np.ndarray = 1) -> np.ndarray:
        seen, total = seen - mine, total - mine * out
        kinds = kinds - mine * (seen == 0)
        some = (total > 0) & (kinds > 0)
        return np.where(some, (np.maximum(seen, 0) + kinds * p) / np.maximum(total + kinds, 1), p)

    p = np.full(len(here), 1.0 / ALPHABET)
    p = mixed(p, look_up(letters, one, last), np.full(len(here), one.sum()), np.full(len(here), len(letters)), size[here])
    single = p
    two = b & ((1 << 2 * BITS) - 1)
    p = mixed(p, look_up(pairs, times, two[here]), look_up(firsts, totals, two[here] >> BITS), look_up(firsts, kinds_, two[here] >> BITS))
    before = np.full(len(b), 0x9E3779B97F4A7C15, np.uint64)
    for order in range(2, ORDER + 1):
        letter = b >> BITS if order == 2 else (a >> (order - 3) * BITS) & mask
        fits = letter >> (BITS if order == 2 else 0) > 0
        before = (before ^ letter.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        before ^= before >> np.uint64(29)
        gram = (before ^ ((b & mask).astype(np.uint64) + np.uint64(0x51ED27))) * np.uint64(0xA0761D6478BD642F)
        gram ^= gram >> np.uint64(32)
        at = np.flatnonzero(fits)
        _, first, gram_no = np.unique(gram[at], return_index=True, return_inverse=True)
        _, context_no = np.unique(before[at], return_inverse=True)
        seen = np.bincount(gram_no, n[at], len(first)).astype(np.int64)
        total = np.bincount(context_no, n[at]).astype(np.int64)
        kinds = np.bincount(context_no[first], seen > 0, len(total)).astype(np.int64)
        full = np.zeros((3, len(b)), np.int64)
        full[:, at] = seen[gram_no], total[context_no], kinds[context_no]
        p = np.where(fits[here], mixed(p, *full[:, here]), p)
    return single, p


def own_chance(k: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.exp(own) / (k * (k + 1.0)) + 1e-300


@dataclass
class Channel:
    """What was learnt: ``rates`` of (right, read), the letter model, and sums over all words."""

    rates: dict[tuple[str, str], float]
    letters: Letters | LetterTable
    tokens: int
    hapaxes: int
    evidence: list[tuple[str, str, float, float]] = field(default_factory=list)  # right, read, rate, forms

    def state(self) -> tuple:
        """Plain values for a broadcast: workers have no copy of this module to unpickle objects by, and
        no letter model but its number of forms."""
        return self.rates, self.letters.n_forms, self.tokens, self.hapaxes

    @classmethod
    def of(cls, state: tuple) -> Channel:
        rates, n_forms, tokens, hapaxes = state
        return cls(rates, Letters.fit([], n_forms=n_forms), tokens, hapaxes)

    def undone(self, form: str, edits: int = 1) -> dict[str, float]:
        """Readings of ``form`` with up to ``edits`` confusions undone, each with the log of its rate.

        A reading is made of letters, so the figures and signs in a form must all go.
        """
        out: dict[str, float] = {}
        todo = {form: 0.0}
        for _ in range(edits):
            more: dict[str, float] = {}
            for x, log in todo.items():
                for (right, read), rate in self.rates.items():
                    at = x.find(read)
                    while at >= 0:
                        y, z = x[:at] + right + x[at + len(read) :], log + math.log(rate)
                        if z > more.get(y, -math.inf):
                            more[y] = z
                        at = x.find(read, at + 1)
            for y, z in more.items():
                if y.isalpha() and y != form and z > out.get(y, -math.inf):
                    out[y] = z
            todo = more
        return out


def hole_keys(rows: DataFrame) -> DataFrame:
    """(key, form, k, part) of (form, k): the form with one or two characters taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, forms, counts, parts = [], [], [], []
            for f, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for width in (1, 2):
                    if not width + 2 <= len(f) <= LONGEST:
                        continue
                    for i in range(len(f) - width + 1):
                        keys.append(xxhash.xxh3_64_intdigest(f"{f[:i]}\0{f[i + width :]}") - (1 << 63))
                        parts.append(f[i : i + width])
                        forms.append(f)
                        counts.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(forms, pa.string()), pa.array(counts, pa.int64()), pa.array(parts, pa.string())], names=["key", "form", "k", "part"])

    return rows.select("form", "n").mapInArrow(run, "key long, form string, k long, part string")


def learn(forms: DataFrame) -> Channel:
    """The channel of a lexicon (form, n, word): ``word`` tells forms that are made of letters.

    Pairs of any form and a frequent word that differ in one place of one or two characters are found by
    a join; a key with a hole has at most as many partners as there are pairs of characters. Every
    step of the fit is one pass over the forms that have such pairs, whose sums by confusion
    come to the driver. A confusion of too few forms to outweigh its description is none.
    """
    total, n_forms, hapaxes = forms.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1)).first()
    total, n_forms = total or 0, n_forms or 0
    frequent = forms.filter(F.col("word") & (F.col("n") >= FREQUENT * total) & F.col("form").rlike(r"^\p{L}+$"))
    right = cut(hole_keys(frequent).select("key", F.col("k").alias("n"), F.col("part").alias("a")))
    differ = (F.col("n") > F.col("k")) & (F.left("a", F.lit(1)) != F.left("part", F.lit(1))) & (F.right("a", F.lit(1)) != F.right("part", F.lit(1)))
    met = hole_keys(forms.filter(F.length("form") > 2)).join(right, "key").filter(differ).select("form", "k", "n", F.concat_ws("\t", "a", "part").alias("pair"))
    met = cut(met.groupBy("form", "k").agg(F.collect_list("pair").alias("pairs"), F.collect_list("n").alias("n")))
    least = math.ceil(DESCRIPTION / ONE_FORM)
    enough = met.select(F.explode(F.array_distinct("pairs")).alias("pair")).groupBy("pair").count().filter(F.col("count") >= least)
    pairs = sorted(r[0] for r in enough.select("pair").toLocalIterator())
    met = cut(_numbered(met, pairs))
    segments = _segments(frequent)
    exposure = np.array([max(segments.get(p.split("\t")[0], 1), 1) for p in pairs], np.float64)
    known = forms.filter("word").select("form")
    letters = LetterTable(known, n_forms)
    rate, alive, seen = np.zeros(len(pairs)), np.zeros(len(pairs), bool), np.zeros(len(pairs))
    for _ in range(ROUNDS if pairs else 0):
        judged = cut(met.join(letters.of(met.select("form")), "form"))
        rate, alive = np.full(len(pairs), START_RATE), np.ones(len(pairs), bool)
        for step in range(STEPS):
            before = rate, alive
            events, seen, gain = _sums(judged, rate, alive)
            rate = np.clip(events / exposure, 1e-12, MOST_RATE)
            if step >= 2:
                alive = gain >= DESCRIPTION
        letters = LetterTable(cut(known.join(_misread(judged, *before), "form", "left_anti")), n_forms)
    table = {tuple(p.split("\t")): float(r) for p, r, a in zip(pairs, rate, alive) if a}
    evidence = sorted(((*p.split("\t"), float(r), float(s)) for p, r, s, a in zip(pairs, rate, seen, alive) if a), key=lambda x: -x[3])
    return Channel(table, letters, total, hapaxes or 0, evidence)


def _numbered(met: DataFrame, pairs: list[str]) -> DataFrame:
    """(form, k, pairs, n): the pairs by their numbers, without those that have none."""
    shared = met.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {p: i for i, p in enumerate(shared.value)}
        for batch in batches:
            out = []
            for form, k, names, counts in zip(*(c.to_pylist() for c in batch.columns)):
                some = [(number[p], n) for p, n in zip(names, counts) if p in number]
                if some:
                    out.append((form, k, [i for i, _ in some], [n for _, n in some]))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["form", "k", "pairs", "n"])

    return met.select("form", "k", "pairs", "n").mapInArrow(run, "form string, k long, pairs array<int>, n array<long>")


def _shares(batch: pa.RecordBatch, rate: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a batch (form, k, pairs, n, own): the number, k, mean and chance of each of its pairs, the
    form of each, and of the forms all chances together and that of a word of its own."""
    lists = batch.column(2)
    owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    no, n = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.float64)
    count = batch.column(1).to_numpy().astype(np.float64)
    own = own_chance(count, batch.column(4).to_numpy())
    k, mean = count[owner], n * rate[no]
    chance = np.zeros(len(no))
    on = alive[no]
    chance[on] = likely(k[on], mean[on])
    return no, k, mean, chance, owner, own + np.bincount(owner, chance, batch.num_rows), own


def _sums(judged: DataFrame, rate: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By pair: the misreads that it explains, the forms, and the nats gained."""
    shared = judged.sparkSession.sparkContext.broadcast((rate, alive))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate, alive = shared.value
        out = np.zeros((3, len(rate)))
        for batch in batches:
            if batch.num_rows:
                no, k, mean, chance, owner, sums, _ = _shares(batch, rate, alive)
                part = chance / sums[owner]
                most = np.maximum(2 * mean + 2, mean / rate[no] * MOST_RATE)  # a share of the word's count, or it falls behind in a large collection
                gain = np.minimum(ONE_FORM, -np.log(np.maximum(1 - part, 1e-300)))
                out += [np.bincount(no, x, len(rate)) for x in (part * np.minimum(k, most), part, gain)]
        some = np.flatnonzero(out[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in out)], names=["no", "events", "seen", "gain"])

    rows = judged.select("form", "k", "pairs", "n", "own").mapInArrow(run, "no long, events double, seen double, gain double").groupBy("no").agg(*(F.sum(c).alias(c) for c in ("events", "seen", "gain"))).toArrow()
    full = np.zeros((3, len(rate)))
    for x, c in zip(full, ("events", "seen", "gain")):
        x[rows.column("no").to_numpy()] = [float(f"{v:.12g}") for v in rows.column(c).to_numpy()]  # whatever the order of the sum
    return full[0], full[1], full[2]


def _misread(judged: DataFrame, rate: np.ndarray, alive: np.ndarray) -> DataFrame:
    """(form): those that are rather misreads."""
    shared = judged.sparkSession.sparkContext.broadcast((rate, alive))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums, own = _shares(batch, *shared.value)[-2:]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(sums > 2 * own))], names=["form"])

    return judged.select("form", "k", "pairs", "n", "own").mapInArrow(run, "form string")


def _segments(words: DataFrame) -> dict[str, int]:
    """Occurrences of each group of one or two letters: at most the square of the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for width in (1, 2):
                    for i in range(len(w) - width + 1):
                        s = w[i : i + width]
                        total[s] = total.get(s, 0) + n
        yield pa.RecordBatch.from_pydict({"s": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    rows = words.select("form", "n").mapInArrow(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in rows.collect()}


TRIED = "form string, k long, own double, word string, rate double"


def decoded_forms(forms: DataFrame, channel: Channel, words: DataFrame) -> DataFrame:
    """(form, word, odds): every form (form, n) that is more likely a misread of one of ``words`` (form,
    n) than a word of its own.

    Readings are made by undoing learnt confusions and meet the lexicon in a join; ``odds`` is the log
    of all readings against the form as it stands. A second confusion is undone only in forms that
    are very unlikely as they stand.
    """
    shared = forms.sparkSession.sparkContext.broadcast(channel.state())

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads = {b for _, b in shared.value[0]}
        for batch in batches:
            yield batch.filter(pa.array([1 < len(f) <= LONGEST and any(b in f for b in reads) for f in batch.column(0).to_pylist()], pa.bool_()))

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Channel.of(shared.value)
        for batch in batches:
            out: list[tuple] = []
            for f, k, own in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(f, k, own, w, r) for w, r in model.undone(f, 2 if own < SECOND else 1).items() if len(w) > 1]
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["form", "k", "own", "word", "rate"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, own, rate, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2, 4, 5))
            chance = likely(k, n * np.exp(rate), REPEATED)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(chance), pa.array(own_chance(k, own))], names=["form", "word", "chance", "own"])

    some = cut(forms.select("form", "n").mapInArrow(possible, "form string, n long"))
    tried = some.join(channel.letters.of(some), "form").select("form", "n", "own").mapInArrow(undo, TRIED)
    right = words.select(F.col("form").alias("word"), F.col("n").alias("n_right"))
    met = tried.join(right, "word").filter(F.col("n_right") > F.col("k") * F.col("form").rlike(r"^\p{L}+$").cast("int")).select("form", "k", "own", "word", "rate", "n_right").mapInArrow(judge, "form string, word string, chance double, own double")
    best = met.groupBy("form").agg(F.max_by("word", F.struct("chance", "word")).alias("word"), F.sum("chance").alias("chance"), F.max("own").alias("own"))
    return best.withColumn("odds", F.ln("chance") - F.ln("own")).filter("odds > 0").select("form", "word", "odds")


def text_lines(counts: list[tuple[int, int, int]]) -> tuple[float, float, float]:
    """(per known word, per unknown word, constant) of the log odds that a line is text, not rubbish.

    ``counts``: (known words, other words, lines). Two kinds of lines: in rubbish a word is known by
    chance only, at the fixed rate ``CHANCE``; the rate in text and the share of text are fitted by
    expectation-maximisation. (With both rates free the kinds become lines with few and with many
    names.) Weak prior counts stand for lines where there are few.
    """
    s, o, w = (np.array(x, np.float64) for x in (zip(*counts) if counts else ((), (), ())))
    good, bad, share = 0.9, CHANCE, 0.8
    for _ in range(50):
        odds = math.log(share / (1 - share)) + s * math.log(good / bad) + o * math.log((1 - good) / (1 - bad))
        t = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        good = float((90 + (w * t * s).sum()) / (100 + (w * t * (s + o)).sum()))
        share = float((80 + (w * t).sum()) / (100 + w.sum()))
        good = min(max(good, bad + 1e-3), 1 - 1e-6)
    return math.log(good / bad), math.log((1 - good) / (1 - bad)), math.log(share / (1 - share))

