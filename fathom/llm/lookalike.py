"""One stored form for text that prints alike.

Look-alike relations between code points and short strings are merged into classes by union-find,
each class gets one representative (the member seen most often in the corpus, if counts are given),
and text is rewritten greedily, longest match first, with one multi-pattern automaton.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import cut

# Letters of other scripts that print like a Latin letter.
LOOKALIKE_LETTERS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "օ": "o", "ѵ": "v", "Ѵ": "V", "ɡ": "g", "ı": "ı",
}
# Marks that print alike.
LOOKALIKE_MARKS = {"‐": "-", "‑": "-", "­": "", "ʼ": "’", ";": ";", "·": "·", "·": "·", "∶": ":", "․": ".", "‚": "‚"}
# Ranges of characters that print nothing and are not of the category "format".
INVISIBLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xE0000, 0xE0FFF)]
ALL = range(0x80, sys.maxunicode + 1)


class UnionFind:
    """Disjoint sets of strings; the empty string is the member 'prints nothing'."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return [sorted(g) for g in groups.values() if len(g) > 1]


def relations() -> Iterator[tuple[str, str]]:
    """Pairs that print alike, from the character database and the fixed letters.

    Width variants, kinds of space, no-break forms, ligatures and presentation forms, invisible
    characters. Raised and lowered figures, fractions, circled and styled letters stay apart: a
    reader sees the difference.
    """
    for low, high in INVISIBLE:
        yield from ((chr(code), "") for code in range(low, high + 1))
    for code in ALL:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cf":
            yield ch, ""
            continue
        if kind == "Zs":
            yield ch, " "
            continue
        said = unicodedata.decomposition(ch)
        if not said.startswith("<"):
            continue
        tag, _, rest = said.partition(" ")
        plain = "".join(chr(int(x, 16)) for x in rest.split())
        letters = all(unicodedata.category(x)[0] == "L" for x in plain)
        if tag in ("<wide>", "<narrow>", "<noBreak>") or tag == "<compat>" and letters and kind[0] in "LN":
            yield ch, plain
    yield from LOOKALIKE_LETTERS.items()
    yield from LOOKALIKE_MARKS.items()


@functools.cache
def lookalike_classes() -> list[list[str]]:
    """Transitive classes over code points and strings.

    A string member is first spelt with the plainest member of each of its characters' classes,
    so ``ﬃ``, ``ffi`` and ``ﬀi`` meet in one class.
    """
    sets = UnionFind()
    pairs = [(unicodedata.normalize("NFD", a), unicodedata.normalize("NFD", b)) for a, b in relations()]
    for a, b in pairs:
        if len(a) <= 1 and len(b) <= 1:
            sets.union(a, b)
    singles = {x: best for g in sets.classes() for best in [plainest(g)] for x in g}
    spell = lambda s: "".join(singles.get(x, x) for x in s) if len(s) > 1 else s
    for a, b in pairs:
        if len(a) > 1 or len(b) > 1:
            sets.union(spell(a), spell(b))
    return sets.classes()


def plainest(members: Iterable[str]) -> str:
    """The member that prints nothing, else the one with the lowest code points (ASCII first)."""
    return min(members, key=lambda x: (x != "", [ord(c) for c in x]))


def representatives(classes: list[list[str]], counts: dict[str, int] | None = None) -> dict[str, str]:
    """Member to representative. With counts, the single character seen most often in the corpus
    represents its class; classes with a string or nothing as a member keep the plainest, as a
    representative must not need rewriting itself."""
    out: dict[str, str] = {}
    for group in classes:
        best = plainest(group)
        if counts and all(len(x) == 1 for x in group):
            best = max(group, key=lambda x: (counts.get(x, 0), x == best))
        out.update({x: best for x in group if x != best})
    # strings meet text whose single characters are already rewritten
    spell = lambda s: "".join(out.get(c, c) for c in s) if len(s) > 1 else s
    return {spell(k): spell(v) for k, v in out.items()}


def compile_fold(mapping: dict[str, str]) -> tuple[str, dict[str, str]]:
    """The pattern of everything that a fold may have to touch, and the rewriting table."""
    singles = {x for x in mapping if len(x) == 1}
    marks, built, unstable = [], [], []
    for c in map(chr, ALL):
        if unicodedata.combining(c):
            marks.append(c)
        said = unicodedata.decomposition(c)
        if said and not said.startswith("<") and c not in singles and unicodedata.normalize("NFD", c)[0] in singles:
            built.append(c)  # a precomposed letter whose base is rewritten, such as a Cyrillic one with diaeresis
        if not unicodedata.is_normalized("NFC", c):
            unstable.append(c)
    heads = {x[0] for x in mapping if len(x) > 1}
    touch = {ord(x) for x in [*singles, *marks, *built, *unstable, *heads]}
    # negated, over the basic plane: re then tests a character by one table look-up
    safe, spans, i = [c for c in range(0x10000) if c not in touch], [], 0
    while i < len(safe):
        j = i
        while j + 1 < len(safe) and safe[j + 1] == safe[j] + 1:
            j += 1
        spans.append(f"\\u{safe[i]:04x}-\\u{safe[j]:04x}")
        i = j + 1
    return "[^" + "".join(spans) + "]", mapping


def folder(pattern: str, mapping: dict[str, str]) -> Callable[[str], str]:
    """The rewriting function. Text without any touched character is returned as it is.

    Runs of plain text are skipped by one scan; only where a touched character stands, the text is
    decomposed, rewritten and composed again: single characters by a table, then strings by one
    Aho-Corasick automaton.
    """
    import ahocorasick

    suspect = re.compile(pattern)
    ascii_stays = all(not k.isascii() for k in mapping)
    table = str.maketrans({k: v for k, v in mapping.items() if len(k) == 1})
    automaton = ahocorasick.Automaton()
    for k, v in mapping.items():
        if len(k) > 1:
            automaton.add_word(k, (len(k), v))
    if len(automaton):
        automaton.make_automaton()

    def rewrite(text: str) -> str:
        """Strings of several characters, leftmost and longest first."""
        parts, done = [], 0
        for last, (size, new) in automaton.iter_long(text):
            parts += [text[done : last + 1 - size], new]
            done = last + 1
        return "".join([*parts, text[done:]]) if parts else text

    def fold(text: str) -> str:
        if ascii_stays and text.isascii() or suspect.search(text) is None:
            return text
        text = unicodedata.normalize("NFD", text).translate(table)
        return unicodedata.normalize("NFC", rewrite(text) if len(automaton) else text)

    return fold


def default_fold() -> Callable[[str], str]:
    """The fold with the plainest member of each class as its representative."""
    return folder(*compile_fold(representatives(lookalike_classes())))


def code_point_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Occurrences of each code point over all documents. At most as many as Unicode has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            joined = "".join(x for x in batch.column(0).to_pylist() if x)
            if joined.isascii():
                seen = np.bincount(np.frombuffer(joined.encode("ascii"), dtype=np.uint8))
            else:
                seen = np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
            total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select(text).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {chr(r["code"]): r["n"] for r in rows.collect()}


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: dict[str, int] | None = None) -> DataFrame:
    """(key, stored, printed): 128-bit hashes of each non-empty text as stored and in its one form.

    NULL and empty texts give no row. A row whose text has nothing visible gets the hash of ''.
    """
    pattern, mapping = compile_fold(representatives(lookalike_classes(), counts))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        fold = folder(pattern, mapping)
        for batch in batches:
            keys, stored, printed = [], [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x:
                    y = fold(x)
                    a = xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))
                    keys.append(k)
                    stored.append(a)
                    printed.append(a if y is x or y == x else xxhash.xxh3_128_digest(y.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "stored": pa.array(stored, pa.binary()), "printed": pa.array(printed, pa.binary())})

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(hashes, "key long, stored binary, printed binary").withColumnRenamed("key", key)


def canonical_text(docs: DataFrame, text: str = "text", out: str = "canonical", counts: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with the one form of ``text`` in ``out``; NULL stays NULL, '' stays ''."""
    pattern, mapping = compile_fold(representatives(lookalike_classes(), counts))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = folder(pattern, mapping)
        for batch in batches:
            texts = [x if x is None else fold(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    return docs.mapInArrow(rewrite, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def alike_pairs(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: printed alike, stored differently.

    Exact copies are grouped first: only the distinct stored forms of a printed form are paired, and
    each pair of forms is then expanded into its members, so the work is that of the result.
    """
    prints = cut(prints)
    forms = prints.groupBy("printed", "stored").agg(F.count("*").alias("n"))
    several = forms.groupBy("printed").agg(F.count("*").alias("forms")).filter("forms > 1").select("printed")
    members = prints.join(several, "printed", "left_semi")
    forms = forms.join(several, "printed", "left_semi")
    a, b = forms.select("printed", F.col("stored").alias("sa")), forms.select("printed", F.col("stored").alias("sb"))
    pairs = a.join(b, "printed").filter("sa < sb").select("sa", "sb")
    left = members.select(F.col("stored").alias("sa"), F.col(key).alias("ka"))
    right = members.select(F.col("stored").alias("sb"), F.col(key).alias("kb"))
    return pairs.join(left, "sa").join(right, "sb").select(F.least("ka", "kb").alias("doc_a"), F.greatest("ka", "kb").alias("doc_b"))


def alike_classes(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, class_id, n_alike, n_forms): each document that prints like another one, with the smallest
    key of its class, the number of its documents and of the forms they are stored in.

    One row per document, never a pair: a class of any size costs its members.
    """
    prints = cut(prints)
    stored = prints.groupBy("printed", "stored").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    classes = stored.groupBy("printed").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_alike"), F.count("*").alias("n_forms")).filter("n_alike > 1")
    return prints.join(classes, "printed").select(key, "class_id", "n_alike", "n_forms")
