"""Spelling variants: words that are one edit apart, found with positional q-grams.

One inserted, deleted or replaced character changes at most Q of a word's positional q-grams, shifts the others by one place at most, and the
length by one at most. So two such words have all but Q of the longer one's q-grams in common, at places that differ by one at most: the words of an
inverted index are heap-merged under these limits, those above the bound are verified.

To spread the index, words are dealt by what an edit leaves alone. The edit's place lies in one of two halves of the shorter word, and all
outside that half is equal: a word goes to a group for each half, as the shorter and as the longer of a pair. Each group
has an index of its own over the halves. In a group of over `crowd` words the half is cut in two again, so that more of the word must be equal, down to one
character; then a group has at most one word for each letter, and for each pair of letters in the longer ones, and all its words of equal length are near each other.
A pair is counted only in the group in whose part its first differing character lies, so in one group alone.

Groups put out one row for each word: how many near words, and the most frequent of them. No pair is shuffled.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import own_key, scratch_table

LETTERS = "A-Za-zÀ-ÿ"
Q = 2
#: Different words that a worker counts before it puts them out.
HELD = 300_000
#: What stands before and behind a word in its q-grams.
HEAD, TAIL = "\x01", "\x02"


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, damage: int | None = None) -> DataFrame:
    """(word, n): how often each run of letters stands in all texts, only A-Z lower-cased, if it has so many characters. A null text has none.

    damage: if the CRC-32 of `<id>:<run>` is a multiple of this, the run loses the character at that CRC modulo its length (a null id is empty there); so typing errors are made for tests.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in chain(batches, (None,)):
            if batch is not None:
                for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = Counter(runs.findall((text.as_py() or "").encode().lower().decode()))
                    if damage is None:
                        held.update(found)
                        continue
                    prefix = zlib.crc32(f"{'' if own is None else own}:".encode())
                    for run, n in found.items():
                        h = zlib.crc32(run.encode(), prefix)
                        if h % damage == 0:
                            run = run[: h % len(run)] + run[h % len(run) + 1 :]
                            if len(run) < least_chars:
                                continue
                        held[run] += n
            if held and (batch is None or len(held) > HELD):
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                held.clear()

    return df.select(id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def grams(text: str) -> list[str]:
    whole = HEAD + text + TAIL
    return [whole[i : i + Q] for i in range(len(whole) - Q + 1)]


def one_edit(short: str, long: str) -> int | None:
    """Where the words differ first, if they are one edit apart and `long` is as long or one longer; else None."""
    i = next((k for k, (a, b) in enumerate(zip(short, long, strict=False)) if a != b), len(short))
    same = len(short) == len(long)
    return i if (not same or i < len(short)) and short[i + same :] == long[i + 1 :] else None


def children(m: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """A part of a word cut in two; one character stays."""
    middle = (lo + hi) // 2
    return [(lo, middle), (middle, hi)] if hi - lo > 1 else [(lo, hi)]


def key_of(word: str, m: int, lo: int, hi: int) -> str:
    """What is equal in all words of a group: those of m characters without [lo, hi), those of m + 1 without [lo, hi + 1)."""
    return f"{m}.{lo}.{hi}.{word[:lo]}.{word[len(word) - (m - hi) :]}"


class Best:
    """Near words of each word of a group: how many, and the most frequent (of equals the least)."""

    def __init__(self):
        self.found: dict[str, list] = {}

    def add(self, word: str, other: str, n: int, near: int = 1) -> None:
        row = self.found.setdefault(word, [0, 0, ""])
        row[0] += near
        if n > row[1] or n == row[1] and other < row[2]:
            row[1:] = n, other


def near_in_group(counts: dict[str, int], m: int, lo: int, hi: int) -> Best:
    """counts: words of m and of m + 1 characters that are equal outside the part."""
    best, words = Best(), sorted(counts, key=lambda w: (len(w), w))
    part = {w: w[lo : len(w) - (m - hi)] for w in words}
    shorter = [w for w in words if len(w) == m]
    here = lambda i: lo <= i < hi or i == m == hi

    def meet(a: str, b: str) -> None:
        i = one_edit(a, b)
        if i is not None and here(i):
            best.add(a, b, counts[b])
            best.add(b, a, counts[a])

    if hi - lo == 1:
        # One character: all of equal length are near, and a longer word's part is one of these with a letter before or behind.
        top = heapq.nsmallest(2, shorter, key=lambda w: (-counts[w], w))
        for w in shorter if len(shorter) > 1 else ():
            other = top[1] if w == top[0] else top[0]
            best.add(w, other, counts[other], len(shorter) - 1)
        known = {part[w]: w for w in shorter}
        for b in words[len(shorter) :]:
            for letter in set(part[b]):
                if letter in known:
                    meet(known[letter], b)
        return best
    postings: dict[tuple[str, int], list[int]] = defaultdict(list)
    for k, b in enumerate(words):
        own = grams(part[b])
        bound = len(part[b]) + 1 - Q * 1
        lists = [p for at, g in enumerate(own) for shift in (-1, 0, 1) if (p := postings.get((g, at + shift)))]
        for j, hits in groupby(heapq.merge(*lists)):
            if sum(1 for _ in hits) >= bound:
                meet(words[j], b)
        if k < len(shorter):
            for at, g in enumerate(own):
                postings[g, at].append(k)
    return best


def near_words(words: DataFrame, least_chars: int = 5, crowd: int = 128) -> DataFrame:
    """(word, n_near, best, best_n) of each word of (word, n) that has another at one edit: how many such, the most frequent of them (of equals the least in code-point order) and its n. words: distinct, no nulls."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, word in enumerate(batch.column(0).to_pylist()):
                for m in (len(word), len(word) - 1):
                    if m >= max(1, least_chars):
                        own = [key_of(word, m, lo, hi) for lo, hi in children(m, 0, m)]
                        keys += own
                        rows += [k] * len(own)
            taken = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), taken.column(0), taken.column(1)], names=["key", "word", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])
        out: list[tuple] = []
        key, counts, split, m, lo, hi = None, {}, False, 0, 0, 0

        def refine(word: str, n: int) -> None:
            for part in children(m, lo, hi):
                out.append((key_of(word, m, *part), word, n, None, None, None))

        def close() -> None:
            if not split and len(counts) > 1:
                out.extend((None, word, None, *row[:1], row[2], row[1]) for word, row in near_in_group(counts, m, lo, hi).found.items())

        for batch in chain(batches, (None,)):
            for own, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else ():
                if own != key:
                    close()
                    key, counts, split = own, {}, False
                    m, lo, hi = (int(x) for x in own.split(".", 3)[:3])
                if split:
                    refine(word, n)
                    continue
                counts[word] = n
                if len(counts) > crowd and hi - lo > 1:
                    split = True
                    for w, c in counts.items():
                        refine(w, c)
                    counts = {}
            if batch is None:
                close()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []

    dealt, found = words.select("word", "n").mapInArrow(deal, "key string, word string, n long"), None
    while True:
        level = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "key string, word string, n long, near long, best string, best_n long")
        level = scratch_table(level, "spelling")
        rows = level.filter("key IS NULL").select("word", "near", "best", "best_n")
        found = rows if found is None else found.unionByName(rows)
        dealt = level.filter("key IS NOT NULL").select("key", "word", "n")
        if dealt.isEmpty():  # after as many rounds as a word can be halved
            break
    top = F.min(F.struct((-F.col("best_n")).alias("rank"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("top")).select("word", "n_near", F.col("top.word").alias("best"), (-F.col("top.rank")).alias("best_n"))


def variants(words: DataFrame, times: int = 2, least_chars: int = 5, crowd: int = 128) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n): form is its most frequent near word if that is at least `times` as frequent, root the end of the chain of forms.

    words: distinct, without nulls, none shorter than least_chars. Of near words with equal n the least in code-point order counts. An empty table gives an empty result.
    """
    words = scratch_table(words.select("word", "n"), "spelling-words")
    near = near_words(words, least_chars, crowd).withColumnRenamed("word", "near_word")
    joined = words.join(near, words.word == near.near_word, "left")
    is_form = F.col("best_n") >= F.col("n") * times
    rows = joined.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = scratch_table(rows, "spelling-forms")
    return rows.join(roots(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last. Each round doubles the steps of all chains, and a form is at least twice as frequent as its word, so that some six rounds do for any corpus."""
    now = scratch_table(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("at")), "spelling-chain")
    while True:
        step = now.select(own_key("word").alias("key"), F.col("at").alias("next"))
        moved = now.select("word", "at", own_key("at").alias("key")).join(step, "key", "left")
        moved = scratch_table(moved.select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")), "spelling-chain")
        if moved.filter("moved").isEmpty():
            break
        now = moved.select("word", "at")
    return now.select("word", F.col("at").alias("root")).unionByName(forms.filter("form IS NULL").select("word", F.col("word").alias("root")))
