"""Evaluation texts inside a training corpus: pigeonhole pieces, exact hits, Myers distance.

Both sides are brought to one printed form (``lookalike``) and to words: maximal runs of letters and
digits in lower case. A passage of ``window`` words with at most ``errors`` damaged words falls into
``errors + 1`` undamaged pieces, the longest of which has at least ``(window - errors) / (errors + 1)``
words, so every passage holds an undamaged piece of that length. The pieces at all places of all items
are kept as hashes over word numbers; each document is walked once, its pieces meet them by hash, and
every hit is verified by its words: the exact common run around it, and the bit-parallel edit distance
of the windows through it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import compile_fold, folder, lookalike_classes, representatives

WORD = r"[^\W_]+"
# Test items per pass. A larger set runs as several passes over the corpus, so what is sent to the
# executors is bounded by this many items.
ITEMS_A_PASS = 20_000


def piece_words(window: int, errors: int) -> int:
    """The length of the longest piece that a damaged window holds undamaged in any case."""
    n = -(-(window - errors) // (errors + 1))
    if n < 1:
        raise ValueError("more errors than a window of this length can be searched for")
    return n


def myers(pattern: list, text: list) -> int:
    """Least edit distance, in words, between ``pattern`` and any passage of ``text``.

    Myers' bit-vector recurrence; Python's integers hold patterns of any length.
    """
    if not pattern:
        return 0
    at: dict = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, score = full, 0, len(pattern)
    best = score
    for w in text:
        eq = at.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & full, up & zero
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(zero | plus) & full, plus & zero
        best = min(best, score)
    return best


SCHEMA = "doc_id long, item_id long, longest_run int, words_leaked int, item_words int, least_errors int, score double"


def leaks(docs: DataFrame, items: DataFrame, window: int = 13, errors: int = 0) -> DataFrame:
    """One row per document and item with a verified passage in common.

    ``longest_run``: consecutive equal words; ``words_leaked``: item words inside runs of at least
    ``window`` equal words; ``least_errors``: edit distance in words between the best window of the
    item around a hit and the document; ``score``: leaked share of the item. A row needs a run of
    ``window`` words, or a window within ``errors`` edits. NULL and empty texts give no rows; items
    shorter than the window give none. The items are a query set: they are read to the driver in
    passes of about ``ITEMS_A_PASS`` by a hash; the documents never leave the executors.
    """
    size = piece_words(window, errors)
    pattern, mapping = compile_fold(representatives(lookalike_classes()))
    fold, words_of = folder(pattern, mapping), re.compile(WORD).findall
    rows = items.select(F.col("item_id").cast("long"), "text").filter("text is not null and item_id is not null")
    passes = max(1, -(-rows.count() // ITEMS_A_PASS))
    out = None
    for k in range(passes):
        some = rows.filter(F.pmod(F.xxhash64("item_id", F.lit("pass")), F.lit(passes)) == k).toLocalIterator()
        index = Index.of([(r[0], words_of(fold(r[1]).lower())) for r in some], window, size)
        found = search(docs, index, window, errors, size, pattern, mapping)
        out = found if out is None else out.unionByName(found)
    return out


class Index:
    """Pieces of a bounded set of items: their hashes in order, with item and place."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, vocabulary: dict[str, int], items: list[tuple[int, list[int]]], hashes: np.ndarray, numbers: np.ndarray, places: np.ndarray):
        self.vocabulary, self.items, self.hashes, self.numbers, self.places = vocabulary, items, hashes, numbers, places

    @classmethod
    def of(cls, items: list[tuple[int, list[str]]], window: int, size: int) -> Index:
        vocabulary: dict[str, int] = {}
        kept = [(k, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64)) for k, words in items if len(words) >= window]
        parts = [cls.pieces(ids, size) for _, ids in kept]
        kept = [(k, ids.tolist()) for k, ids in kept]
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        numbers = np.repeat(np.arange(len(kept)), [len(p) for p in parts])
        places = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        return cls(vocabulary, kept, hashes[order], numbers[order], places[order])

    @classmethod
    def pieces(cls, ids: np.ndarray, size: int) -> np.ndarray:
        """Hash of the piece at each place. Words that no item has are 0."""
        n = max(len(ids) - size + 1, 0)
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h = (h + ids[j : j + n].astype(np.uint64)) * np.uint64(cls.BASE)
            h ^= h >> np.uint64(31)
        return h

    def runs(self, ids: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(item, place in the document, place in the item, length) of the maximal runs of equal pieces.

        Neighbouring hits of one item at one shift are one run, so a run is seen once, whatever its length.
        """
        if len(ids) < size or not len(self.hashes):
            return
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(known[size:] - known[:-size] == size)
        h = self.pieces(ids, size)[at]
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        n = high - low
        if not n.any():
            return
        a = np.repeat(at, n)
        k = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        item, place = self.numbers[k], self.places[k]
        order = np.lexsort((a, a - place, item))
        a, item, place = a[order], item[order], place[order]
        fresh = np.flatnonzero((np.diff(a, prepend=-9) != 1) | (np.diff(place, prepend=-9) != 1) | (np.diff(item, prepend=-9) != 0))
        lengths = np.diff(fresh, append=len(a)) + size - 1
        yield from zip(item[fresh].tolist(), a[fresh].tolist(), place[fresh].tolist(), lengths.tolist())


def search(docs: DataFrame, index: Index, window: int, errors: int, size: int, pattern: str, mapping: dict[str, str]) -> DataFrame:
    """One pass over the documents for a bounded set of items, whose index every worker unpacks once."""
    shared = docs.sparkSession.sparkContext.broadcast((index.vocabulary, index.items, index.hashes, index.numbers, index.places))

    def goes_on(words: list[int], other: list[int], a: int, b: int, n: int) -> bool:
        """Whether one edit at an end of a maximal run lets the next word match: a window with one error
        and fewer words in the run needs that on one side."""
        i, j = a + n, b + n
        if j < len(other) and i < len(words):
            after, beyond = words[i + 1] if i + 1 < len(words) else 0, other[j + 1] if j + 1 < len(other) else -1
            if after == beyond or after == other[j] or words[i] == beyond:
                return True
        if a and b:
            before, beyond = words[a - 2] if a > 1 else 0, other[b - 2] if b > 1 else -1
            return before == beyond or before == other[b - 1] or words[a - 1] == beyond
        return False

    def check(ids: np.ndarray, found: Index) -> dict[int, list]:
        """Per item: longest run, the item's leaked words, least distance of a window."""
        best: dict[int, list] = {}
        words = ids.tolist()
        for item, a, b, n in found.runs(ids, size):
            other, j = found.items[item][1], b + n
            if words[a : a + n] != other[b:j]:
                continue  # equal hashes of different words
            kept = best.setdefault(item, [0, set(), window])
            kept[0] = max(kept[0], j - b)
            if j - b >= window:
                kept[1].update(range(b, j))
                kept[2] = 0
            elif errors and kept[2]:
                first, last = max(0, b + size - window), min(j - size, len(other) - window)
                if last < first or errors == 1 and n < window - 1 and not goes_on(words, other, a, b, n):
                    continue
                # a word of a window that is nowhere near costs an edit: count them along all windows of the run
                around = set(words[max(0, a + first - b - errors) : a + last - b + window + errors])
                missing = list(accumulate((w not in around for w in other[first : last + window]), initial=0))
                for low in range(first, last + 1):
                    if missing[low - first + window] - missing[low - first] <= min(errors, kept[2]):
                        start = a + low - b
                        kept[2] = min(kept[2], myers(other[low : low + window], words[max(0, start - errors) : start + window + errors]))
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(*shared.value)
        fold, words_of, number = folder(pattern, mapping), re.compile(WORD).findall, found.vocabulary.get
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or not found.items:
                    continue
                words = words_of(fold(text).lower())
                ids = np.fromiter((number(w, 0) for w in words), np.int64, len(words))
                for item, (longest, leaked, least) in check(ids, found).items():
                    if longest >= window or least <= errors:
                        k, own = found.items[item]
                        rows.append((key, k, longest, len(leaked), len(own), least, len(leaked) / len(own)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "longest_run", "words_leaked", "item_words", "least_errors", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
