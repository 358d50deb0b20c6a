"""Packing documents into fixed-length sequences by first-fit decreasing.

1. Tokenise (once; the result is kept): a document's ids end with an end id. It is
   cut into whole sequences and a rest; of the rest the length, the CRC-32 and the
   CRC-32 of its power-of-two parts (the binary digits of its length, largest first) are
   kept, so that packing never needs the ids again.
2. Deal documents to random groups by a hash of id, content and place in the input (copies go to all groups), a bounded expected number to each, and pack each group alone:
   first-fit decreasing of the rests over a tournament tree of bin capacities.
3. The emptiest bins of a group are dissolved until their tokens can fill the
   gaps of all others; their documents are cut into their power-of-two parts, which go through the
   same first-fit decreasing. What is left over stays in sequences of a power of two, which need no padding.

The tokenizer drops white space before anything else and never joins across it, so
a text's ids are those of its words one after another. Words and their ids are
remembered in tables of bounded size.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import process_memo, scratch_table

#: Characters that str.split() takes for white space and the tokenizer doesn't.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
PIECES = "chunk_start long, chunk_length long, ids_crc32 long, parts_crc32 array<long>, doc_tokens long, deal long, place long"
#: How the tokenizer splits a lower-cased word; words with other characters than these go to it whole.
_SIMPLE = re.compile("[!-~\u00a1-\u012f\u0132-\u017f]+")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others by rank from U+0100 on; as a table from code points below 0x180 to the letters of their UTF-8 bytes."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x180)}


class Generations(dict):
    """A table of bounded size that forgets what it hasn't been asked for since it was last full."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds:
    """Ids of texts, as little-endian uint32 bytes, put together from remembered words.

    A word is looked up as it stands, then by its parts (as the tokenizer splits it), and only an unseen part is
    encoded. Words with characters beyond Latin letters, digits and ASCII signs, and those that hold one of the tokenizer's own special
    strings (which hold no white space), go to the tokenizer whole.
    """

    def __init__(self, tokenizer, most: int):
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.parts = Generations(self.encode_part, most)
        self.words = Generations(self.encode_word, most)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_part(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_word(self, word: str) -> bytes:
        if not _SIMPLE.fullmatch(word) or any(x in word for x in self.special):
            return self.encode(word)
        low = word.lower()
        return self.parts[low] if low.isalpha() else b"".join(map(self.parts.__getitem__, _SPLIT.findall(low)))

    def text(self, text: str) -> bytes:
        if any(c in text for c in _ODD_SPACE):
            return self.encode(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def load_word_ids(path: str, most: int) -> WordIds:
    """The process's table for a tokenizer; loaded once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    memo = process_memo("packing")
    if (key := f"word_ids {path} {most}") not in memo:
        memo[key] = WordIds(Tokenizer.from_file(path), most)
    return memo[key]


def binary_parts(n: int) -> list[int]:
    """n as descending powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def tokenise(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, length: int, cache_words: int) -> DataFrame:
    """A row for each chunk of a document: whole sequences first, then the rest (with the CRC-32 of its binary parts)."""
    id_type = df.schema[id_col].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load_word_ids(tokenizer, cache_words)
        # The row's place in the input, so that neither copies nor repeated rows share a group. It is written with the chunks and stays.
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            column = batch.column(1)
            for k, text in enumerate(column):
                ids = words.text(text.as_py() or "") + end
                n = len(ids) // 4
                deal = zlib.crc32(ids) | n % 0x7FFF << 32
                for start in range(0, n, length):
                    chunk = ids[4 * start : 4 * (start + length)]
                    size, parts, at = len(chunk) // 4, [], 0
                    if size < length:
                        for part in binary_parts(size):
                            parts.append(zlib.crc32(chunk[at : at + 4 * part]))
                            at += 4 * part
                    for column_out, x in zip(out, (k, start, size, zlib.crc32(chunk), parts, n, deal, place), strict=True):
                        column_out.append(x)
                place += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array(out[4], pa.list_(pa.int64())), *(pa.array(x, pa.int64()) for x in out[5:])],
                names=[id_col, "chunk_start", "chunk_length", "ids_crc32", "parts_crc32", "doc_tokens", "deal", "place"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, {PIECES}")


class TournamentTree:
    """Free space of bins; the leftmost bin with room for an item in O(log bins)."""

    def __init__(self, capacities: list[int]):
        self.leaves = 1 << max(0, (len(capacities) - 1).bit_length())
        self.best = [0] * self.leaves + list(capacities) + [0] * (self.leaves - len(capacities))
        for i in range(self.leaves - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def take(self, need: int) -> int:
        """The first bin with so much room, which it loses; -1 if none has it."""
        best = self.best
        if best[1] < need:
            return -1
        i = 1
        while i < self.leaves:
            i *= 2
            if best[i] < need:
                i += 1
        best[i] -= need
        found = i - self.leaves
        while i > 1:
            i //= 2
            top = max(best[2 * i], best[2 * i + 1])
            if best[i] == top:
                break
            best[i] = top
        return found


def first_fit_decreasing(sizes: list[int], capacities: list[int]) -> list[int]:
    """A bin for each item, -1 for those that fit nowhere; equal sizes go in the order given."""
    tree = TournamentTree(capacities)
    bins = [-1] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        bins[k] = tree.take(sizes[k])
    return bins


def pack_group(lengths: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (chunk, start in it, length). Chunks are kept whole but for those of the emptiest bins."""
    full = [[(k, 0, n)] for k, n in enumerate(lengths) if n == length]
    rests = [k for k, n in enumerate(lengths) if n < length]
    bins: dict[int, list[int]] = {}
    for k, b in zip(rests, first_fit_decreasing([lengths[k] for k in rests], [length] * len(rests)), strict=True):
        bins.setdefault(b, []).append(k)
    by_fill = sorted(bins.values(), key=lambda ks: sum(lengths[k] for k in ks))
    gaps = sum(length - sum(lengths[k] for k in ks) for ks in by_fill)
    given, dissolved = 0, 0
    while dissolved < len(by_fill) and given < gaps:
        used = sum(lengths[k] for k in by_fill[dissolved])
        if used == length:
            break
        given, gaps, dissolved = given + used, gaps - (length - used), dissolved + 1
    kept = [[(k, 0, lengths[k]) for k in ks] for ks in by_fill[dissolved:]]
    parts = []
    for ks in by_fill[:dissolved]:
        for k in ks:
            at = 0
            for part in binary_parts(lengths[k]):
                parts.append((k, at, part))
                at += part
    left = []
    room = [length - sum(n for _, _, n in seq) for seq in kept]
    for part, b in zip(parts, first_fit_decreasing([n for _, _, n in parts], room), strict=True):
        (kept[b] if b >= 0 else left).append(part)
    # Powers of two in falling order fill sequences without a gap; the last, unfilled one is cut at powers of two.
    tail: list[tuple[int, int, int]] = []
    for part in sorted(left, key=lambda p: -p[2]):
        tail.append(part)
        if sum(n for _, _, n in tail) == length:
            kept.append(tail)
            tail = []
    while tail:
        total = sum(n for _, _, n in tail)
        goal, seq = 1 << (total.bit_length() - 1), []
        while sum(n for _, _, n in seq) < goal:
            seq.append(tail.pop(0))
        kept.append(seq)
    return full + kept


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    length: int = 4096,
    docs_per_group: int = 2048,
    cache_words: int = 400_000,
) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty and gives the end id alone. Rows that repeat an id are
    documents of their own. A document of any length is packed whole. An empty input gives an empty
    result. Only the id and the text are read. `tokenizer` is the path of a tokenizers file that drops white space
    (default: the public word_bpe_49k). The group count follows the number of documents, so a group stays small.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    id_type = df.schema[id_col].dataType.simpleString()
    chunks = scratch_table(tokenise(df, id_col, text_col, tokenizer, end_id, length, cache_words), "packing")
    groups = max(1, -(-chunks.filter("chunk_start = 0").count() // docs_per_group))

    def run(key, group):
        group = group.sort_values(["deal", "place", "chunk_start"], kind="stable")
        ids, starts, totals = group[id_col].tolist(), group["chunk_start"].tolist(), group["doc_tokens"].tolist()
        lengths, whole, parts = group["chunk_length"].tolist(), group["ids_crc32"].tolist(), group["parts_crc32"].tolist()
        part_crc = [dict(zip(np.cumsum([0, *binary_parts(n)[:-1]]).tolist(), p, strict=True)) if n < length else {} for n, p in zip(lengths, parts, strict=True)]
        out = []
        for s, seq in enumerate(pack_group(lengths, length)):
            at = 0
            for k, start, n in seq:
                out.append((ids[k], starts[k] + start, n, whole[k] if n == lengths[k] else part_crc[k][start], totals[k], (int(key[0]) << 32) + s, at))
                at += n
        return pd.DataFrame(out, columns=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({id_col: group[id_col].dtype})

    dealt = chunks.withColumn("pack_group", F.pmod(F.xxhash64(id_col, "deal", "place"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
