"""Near-duplicate documents by SimHash, found with anchor points of a covering code.

The code is the product of two binary Golay codes over the low 46 bits of a
fingerprint. A Golay code of 23 bits is perfect with covering radius 3: each word is
within 3 bits of exactly one codeword. The 2**24 pairs of codewords are the anchors.
A fingerprint is at home at its nearest anchor. If x and y differ in at most t bits, y is in each
block within 3 + d of x's anchor, with the d of both blocks summing to t at most. So every
fingerprint is replicated to all anchors within covering radius plus threshold in that
sense (61 on average for t = 2), and comparing, at each anchor, the fingerprints at
home with the replicas finds every pair. Anchors of a word come from a
table of error patterns by syndrome, so replication is table look-ups.

Equal fingerprints are collapsed first. An anchor at which more than `crowd`
different fingerprints are at home isn't compared by pairs: all that were replicated to it go to the anchors of a finer
code, the code of all words with covering radius 0. Two fingerprints within 2 bits have a word within 1 bit of both, and
a word has at most 65 fingerprints within 1 bit, so that nothing is crowded there and a star at each word links
what pairs would link. No link is lost, none is emitted for all pairs of a group.

Links are between different fingerprints; components come from alternating large-star and
small-star rounds over them, checkpointed, with one number a round going to the driver.

`representatives` links by shingle similarity instead of a few bits. At a Jaccard similarity of 0.8 some 15 % of the bits
differ, and anchors within covering radius plus so many bits would be most of all anchors. So fingerprints are
wide (256 bits over distinct shingles: fewer are too blurred to tell 0.8 from 0.6), there are many codes, each the product of a
Golay code over 23 chosen bits and the code of all words over a few more, and the threshold in each code is 0: a fingerprint
goes to one anchor of each code, and two that are alike meet at one of them at least (the chance is in `meeting`). At an
anchor all are compared in full. An anchor with more than `crowd` fingerprints deals them to finer anchors, those of two codes together, then of three
and of four; so work stays linear in a large group of near copies, whose members have so many chances to be linked that the group holds.
At each anchor a forest of its closest pairs stands for all its links. Links so close that the similarity is beyond doubt are taken as they are; others
that would join two groups are checked by LONG further bits of both texts and then by their shingles, so that texts below the similarity aren't chained together.
Where a link of a forest is refused, all pairs of that anchor that still are in two groups are checked in the same way, so that none is lost with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut, own_key, process_memo, scratch_table

SHINGLE, SEED, BITS, MAX_DISTANCE = 3, 42, 64, 2
#: Wide fingerprints: their bits, the number of codes and the chosen bits of a code beyond the Golay block for up to 2**20 fingerprints, and how many codes an anchor may join.
WIDE, CODES, RAW, DEPTH = 256, 80, 6, 4
#: Further bits that decide where WIDE ones leave doubt, before the shingles themselves do.
LONG = 1024
#: Forests of links that an anchor gives. More would only spare some anchors from being looked at again (`unjoined`).
FORESTS = 1
#: Generator polynomial of the binary Golay code, and its length, redundancy and covering radius.
_G, _N, _R, _RADIUS = 0b110001110101, 23, 11, 3
_LOW = 12


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash: bit set where over half of the shingles' XXH64 have it set; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashed, seed = xxhash.xxh64_digest, SEED
    if len(words) <= shingle:
        digests = [hashed(b" ".join(words), seed)]
    else:
        digests = [hashed(b" ".join(words[i : i + shingle]), seed) for i in range(len(words) - shingle + 1)]
    # Votes are counted 255 digests at a time in bytes, each bit of the digests a column.
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    votes = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(digests)).tobytes(), "big")


def signed(n: int) -> int:
    return n - (n >> 63 << 64)


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memo("simhash")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signed(fingerprint(t.as_py(), shingle)) for t in b.column(1)], pa.int64())], names=[id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp long")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Words modulo the generator polynomial: their syndromes."""
    out = words.copy()
    for bit in range(_N - 1, _R - 1, -1):
        out ^= np.where(out >> bit & 1, _G << bit - _R, 0)
    return out


def golay_tables() -> dict:
    """low, high: syndromes of the 12 low and 11 high bits of a word (a word's is their exclusive or). first, count: by excess over the covering radius and syndrome, where in `patterns` the error patterns stand that lead to a codeword."""
    memo = process_memo("simhash")
    if "golay" not in memo:
        low = _remainders(np.arange(1 << _LOW, dtype=np.int32)).astype(np.int64)
        high = _remainders(np.arange(1 << _N - _LOW, dtype=np.int32) << _LOW).astype(np.int64)
        patterns, first, count = [], [], []
        for excess in range(MAX_DISTANCE + 1):
            weights = range(_RADIUS + 1) if excess == 0 else [_RADIUS + excess]
            words = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(_N), w)], np.int32)
            own = low[words & (1 << _LOW) - 1] ^ high[words >> _LOW]
            words = words[np.argsort(own, kind="stable")]
            n = np.bincount(own, minlength=1 << _R)
            first.append(sum(map(len, patterns)) + np.cumsum(n) - n)
            count.append(n)
            patterns.append(words)
        memo["golay"] = {"low": low, "high": high, "patterns": np.concatenate(patterns), "first": np.array(first), "count": np.array(count)}
    return memo["golay"]


def syndromes(words: np.ndarray) -> np.ndarray:
    t = golay_tables()
    return t["low"][words & (1 << _LOW) - 1] ^ t["high"][words >> _LOW]


def anchors_of(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of fingerprint, anchor) for all anchors within covering radius plus distance. distance 0: the home anchors."""
    t = golay_tables()
    blocks = [(fps >> shift & (1 << _N) - 1).astype(np.int64) for shift in (0, _N)]
    own = [syndromes(b) for b in blocks]
    rows, anchors = [], []
    for d1 in range(distance + 1):
        for d2 in range(distance + 1 - d1):
            n1, n2 = t["count"][d1][own[0]], t["count"][d2][own[1]]
            n = n1 * n2
            row = np.repeat(np.arange(len(fps)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            e1 = t["patterns"][t["first"][d1][own[0]][row] + k // n2[row]]
            e2 = t["patterns"][t["first"][d2][own[1]][row] + k % n2[row]]
            # A codeword's high 12 bits tell which it is.
            rows.append(row)
            anchors.append((blocks[0][row] ^ e1) >> _R << _N - _R | (blocks[1][row] ^ e2) >> _R)
    return np.concatenate(rows), np.concatenate(anchors)


def at_anchors(fps: DataFrame, distance: int) -> DataFrame:
    """(anchor, fp) for all anchors within covering radius plus distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 4096):
                own = b.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False)
                row, anchor = anchors_of(own, distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(own[row])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor int, fp long")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_DISTANCE


def links(fps: DataFrame, crowd: int = 16) -> DataFrame:
    """(a, b): links between different fingerprints whose components are those of all pairs within two bits. fps: distinct fp."""
    homes = at_anchors(fps, 0)
    crowded = homes.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor")
    crowded = scratch_table(crowded, "simhash-crowded")
    replicas = at_anchors(fps, MAX_DISTANCE)
    # Of a pair, the smaller is looked for at home: if its anchor is crowded, both go to the finer code.
    some = not crowded.isEmpty()
    home = (homes.join(crowded, "anchor", "left_anti") if some else homes).select("anchor", F.col("fp").alias("a"))
    # Spark takes mapInArrow to return as many rows as it gets: without the hint it would broadcast replicas, which are 61 times as many.
    compared = home.join(replicas.withColumnRenamed("fp", "b").hint("merge"), "anchor").filter((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"))).select("a", "b")
    if not some:
        return compared.distinct()
    fine = replicas.join(crowded, "anchor", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << k)).cast("long") for k in range(BITS)))
    at_words = fine.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("word"), "fp")
    # At most 65 fingerprints are within one bit of a word.
    stars = at_words.groupBy("word").agg(F.collect_list("fp").alias("near")).filter(F.size("near") > 1)
    stars = stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    return compared.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Alternating star rounds: in a large-star round each node links its larger neighbours to its
    smallest, in a small-star round its smaller ones and itself. A round is an
    aggregate, added up before the shuffle, and a join on the node. They end when no edge changes.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct())  # v links to the smaller u
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    before = state(now)
    while before[0]:
        both = now.select(F.col("v").alias("n"), F.col("u").alias("m")).unionByName(now.select(F.col("u").alias("n"), F.col("v").alias("m")))
        smallest = both.groupBy("n").agg(F.min("m").alias("m")).select(own_key("n").alias("key"), F.least("m", "n").alias("low"))
        large = both.filter("m > n").select(own_key("n").alias("key"), "m").join(smallest, "key").select(F.col("m").alias("v"), F.col("low").alias("u")).filter("v <> u").distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("low"))
        near = large.join(lowest, "v")
        small = near.select(F.col("u").alias("v"), F.col("low").alias("u")).unionByName(lowest.select("v", F.col("low").alias("u"))).filter("v <> u").distinct()
        now = cut(small, before[0])
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("root"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, crowd: int = 16) -> DataFrame:
    """One row per document: the id, fingerprint (16 hex digits), component_id: the smallest id that links of two or fewer differing bits reach, its own included.

    Null text is empty; a text without words has fingerprint zero and is linked
    like any other. Texts of fewer words than a shingle are one shingle. Rows that share an
    id are fingerprinted each. Null ids sort above others: a component has a null id only if all its rows do.
    An empty input gives an empty result. Only the id and the text are read.
    """
    rows = scratch_table(fingerprints(df, id_col, text_col, shingle), "simhash")
    of = _component_minimum(rows, F.min(id_col), lambda fps: links(fps, crowd)).withColumnRenamed("least", "component_id")
    return rows.join(of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _component_minimum(rows: DataFrame, least: Column, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, least): the smallest of an aggregate of rows over each fingerprint's component."""
    fps = scratch_table(rows.groupBy("fp").agg(least.alias("first")), "simhash-fps")
    roots = components(link(fps.select("fp")))
    placed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("least")).select(own_key("root").alias("key"), "least")
    return placed.select("fp", own_key("root").alias("key")).join(lowest, "key").select("fp", "least")


def wide_fingerprint(text: str | None, shingle: int = 5, bits: int = WIDE, first_word: int = 0) -> bytes:
    """The SimHash of so many bits over the distinct shingles: a bit set where over half of their hashes have it set; zeros without words. Other first words give other bits."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(bits // 8)
    hashed, seed = xxhash.xxh64_digest, SEED
    digests = list({hashed(b" ".join(words[i : i + shingle]), seed) for i in range(max(1, len(words) - shingle + 1))})
    votes = np.zeros(bits, np.int64)
    for lo in range(0, len(digests), 1 << 12):
        part = digests[lo : lo + (1 << 12)]
        first = np.frombuffer(b"".join(part), "<u8")
        # Further words of a hash are made of the first by a multiplicative mix.
        wide = np.empty((len(part), bits // 64), np.uint64)
        for k in range(bits // 64):
            x = (first + np.uint64(first_word + k)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            wide[:, k] = x ^ x >> np.uint64(32)
        each = np.unpackbits(wide.view(np.uint8), axis=1)
        votes += np.add.reduceat(each, np.arange(0, len(each), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(digests)).tobytes()


def shingle_set(text: str | None, shingle: int = 5) -> bytes:
    """The distinct hashes of a text's shingles, 64 bits each."""
    words = (text or "").encode().lower().split()
    if not words:
        return b""
    return b"".join({xxhash.xxh64_digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))})


def wide_distance(similarity: float, bits: int = WIDE, deviations: float = 0.0) -> int:
    """Differing bits that are expected of two sets of shingles of that Jaccard similarity (and of equal size), and so many standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def code_sizes(fingerprints: int) -> tuple[int, int]:
    """(codes, raw): a code's further bits grow with the logarithm of the input, so that anchors stay small, and the number of codes so that the chance of meeting stays (for the share of bits that differs at a similarity of 0.8)."""
    raw = max(RAW, math.ceil(math.log2(max(1, fingerprints))) - 14)
    return min(1000, math.ceil(CODES * 0.85 ** (RAW - raw))), raw


def _chosen(codes: int, raw: int) -> np.ndarray:
    """A column for each code: the powers of two by which its chosen bits make a word."""
    memo = process_memo("simhash")
    if memo.get("chosen", ((0, 0), None))[0] != (codes, raw):
        rng = np.random.default_rng(SEED)
        columns = np.zeros((WIDE, codes))
        for t in range(codes):
            columns[rng.permutation(WIDE)[: _N + raw], t] = 2.0 ** np.arange(_N + raw)
        memo["chosen"] = ((codes, raw), columns)
    return memo["chosen"][1]


def homes(fps: np.ndarray, codes: int = CODES, raw: int = RAW) -> np.ndarray:
    """The home anchor in each code, a column for each, of fingerprints (rows of bytes)."""
    t = golay_tables()
    words = (np.unpackbits(fps, axis=1).astype(float) @ _chosen(codes, raw)).astype(np.int64)
    block = words & (1 << _N) - 1
    error = t["patterns"][t["first"][0][syndromes(block)]]
    return words >> _N << _N - _R | (block ^ error) >> _R


def _keys(anchors: np.ndarray, code: np.ndarray, depth: int) -> np.ndarray:
    """Of each row one key: the code it is of (in the high 10 bits), and a hash of its anchors in that and the next depth - 1 codes."""
    key = np.zeros(len(anchors), np.uint64)
    rows = np.arange(len(anchors))
    for k in range(depth):
        key = (key ^ anchors[rows, (code + k) % anchors.shape[1]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return (key >> np.uint64(10) | code.astype(np.uint64) << np.uint64(54)).view(np.int64)


def meeting(share: float, fingerprints: int = 2000, seed: int = 1) -> float:
    """The chance, by simulation, that fingerprints of which a share of the bits differs have an anchor in common."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (fingerprints, WIDE // 8), np.uint8)
    b = a ^ np.packbits(rng.random((fingerprints, WIDE)) < share, axis=1)
    return float((homes(a) == homes(b)).any(axis=1).mean())


def _bytes_of(column: pa.Array) -> np.ndarray:
    """A column of binary fingerprints as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDE // 8)


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links taken, labels after): of links in order of distance, a forest of the closest that connects what those `among` them connect of the labels."""
    taken, open_, label = [], among[label[a[among]] != label[b[among]]], label.copy()
    while len(open_):
        # Each component takes the first, so the closest, link that leaves it.
        best = np.full(len(label), len(a))
        np.minimum.at(best, label[a[open_]], open_)
        np.minimum.at(best, label[b[open_]], open_)
        chosen = np.unique(best[best < len(a)])
        taken.append(chosen)
        while True:
            low = np.minimum(label[a[chosen]], label[b[chosen]])
            before = label.copy()
            np.minimum.at(label, label[a[chosen]], low)
            np.minimum.at(label, label[b[chosen]], low)
            label = label[label]
            if (label == before).all():
                break
        open_ = open_[label[a[open_]] != label[b[open_]]]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64), label


def _run_links(keys: np.ndarray, fps: np.ndarray, most: int, sure: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of rows of fps, sorted by key: of each key's links a forest of the closest that connects what they all connect, and FORESTS - 1 further ones of links above `sure` between what links up to it connect."""
    edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    end = np.repeat(np.append(edges[1:], len(keys)), np.diff(np.append(edges, len(keys))))
    rows = np.arange(len(keys))
    n = end - rows - 1
    words = fps.view(np.uint64)
    # Some 2**18 pairs at a time.
    cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + (1 << 18), 1 << 18))
    found = []
    for lo, hi in zip(cuts, [*cuts[1:], len(n)], strict=True):
        m = n[lo:hi]
        a = np.repeat(rows[lo:hi], m)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
        d = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
        near = d <= most
        found.append((a[near], b[near], d[near]))
    a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(d, kind="stable")
    a, b, d = a[order], b[order], d[order]
    closest, _ = _forest(a, b, rows, np.arange(len(a)))
    taken, (_, group) = [closest], _forest(a, b, rows, np.flatnonzero(d <= sure))
    left = np.setdiff1d(np.flatnonzero(d > sure), closest)
    for _ in range(FORESTS - 1):
        more, _ = _forest(a, b, group, left)
        taken.append(more)
        left = np.setdiff1d(left, more)
    taken = np.concatenate(taken)
    return a[taken], b[taken], d[taken]


def wide_links(fps: DataFrame, most: int, crowd: int = 128, sure: int = -1) -> DataFrame:
    """(a, b, distance): links between different wide fingerprints of at most so many differing bits that meet at an anchor, as far as they are needed to connect what all of them connect. fps: distinct fp (binary)."""
    return _closest(meetings(fps, most, crowd, sure)[0], most)


def _closest(found: DataFrame, most: int) -> DataFrame:
    return found.filter(F.col("distance") <= most).groupBy("a", "b").agg(F.min("distance").alias("distance"))


def meetings(fps: DataFrame, most: int, crowd: int = 128, sure: int = -1) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, distance, key) as of `wide_links`, with the anchor at which each was found, and the places (key, fp) at which fingerprints have met.

    In a crowd at the finest anchors members are compared with pivots: the first member, and each later one that is near no pivot before it. That there is such a one is told by a row of more than `most` bits."""
    codes, raw = code_sizes(fps.count())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memo("simhash")
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                column = batch.column(0).slice(lo, 1024)
                anchors = np.repeat(homes(_bytes_of(column), codes, raw), codes, axis=0)
                keys = _keys(anchors, np.tile(np.arange(codes), len(column)), 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys), column.take(pa.array(np.repeat(np.arange(len(column)), codes)))], names=["key", "fp"])

    def compare(depth: int):
        """Rows sorted by (key, fp) to (a, b, distance) for links and (null, fp, finer key) for those of crowds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            process_memo("simhash")
            held, crowded, pivots = None, None, None  # rows of the last key so far; that key, if it is a crowd; its pivots

            def out(a: np.ndarray | None, b: np.ndarray, value: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
                wrap = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                return pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.binary()) if a is None else wrap(a), wrap(b), pa.array(value, pa.int64()), pa.array(at, pa.int64())], names=["a", "b", "value", "at"])

            def overflow(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
                if depth < DEPTH:
                    return out(None, fps, _keys(homes(fps, codes, raw), (keys.view(np.uint64) >> np.uint64(54)).astype(np.int64), depth + 1), keys)
                nonlocal pivots
                left, right, distance = [], [], []
                rest, begin = np.arange(len(fps)), 0
                while True:
                    # All that are left against the pivots that are new; what is near one is linked to it.
                    near_any = np.zeros(len(rest), bool)
                    for p in pivots[begin:]:
                        d = np.bitwise_count(fps[rest].view(np.uint64) ^ p.view(np.uint64)).sum(axis=1, dtype=np.int64)
                        near = d <= most
                        near_any |= near
                        near &= d > 0
                        left.append(np.repeat(p[None], near.sum(), axis=0))
                        right.append(fps[rest[near]])
                        distance.append(d[near])
                    begin, rest = len(pivots), rest[~near_any]
                    if not len(rest):
                        break
                    left.append(pivots[:1])
                    right.append(fps[rest[:1]])
                    distance.append(np.bitwise_count(pivots[:1].view(np.uint64) ^ right[-1].view(np.uint64)).sum(axis=1, dtype=np.int64))
                    pivots = np.concatenate([pivots, right[-1]])
                left = np.concatenate(left)
                return out(left, np.concatenate(right), np.concatenate(distance), np.full(len(left), keys[0]))

            for batch in chain(batches, (None,)):
                if batch is None:
                    keys, fps, last = (*held, True) if held else (np.zeros(0, np.int64), np.zeros((0, WIDE // 8), np.uint8), True)
                    held = None
                else:
                    keys, fps, last = batch.column(0).to_numpy(), _bytes_of(batch.column(1)), False
                    if held:
                        keys, fps = np.concatenate([held[0], keys]), np.concatenate([held[1], fps])
                        held = None
                if not len(keys):
                    continue
                if crowded is not None:
                    n = int(np.searchsorted(keys != crowded, True)) if keys[0] == crowded else 0
                    if n:
                        yield overflow(keys[:n], fps[:n])
                        keys, fps = keys[n:], fps[n:]
                    if not len(keys):
                        continue
                    crowded = None
                first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
                size = np.diff(np.append(first, len(keys)))
                if not last and size[-1] <= crowd:  # may go on in the next batch
                    held = keys[first[-1] :], fps[first[-1] :]
                    keys, fps, first, size = keys[: first[-1]], fps[: first[-1]], first[:-1], size[:-1]
                for lo, n in zip(first[size > crowd].tolist(), size[size > crowd].tolist(), strict=True):
                    pivots = fps[lo : lo + 1]
                    yield overflow(keys[lo : lo + n], fps[lo : lo + n])
                    if lo + n == len(keys) and not last:
                        crowded = int(keys[lo])
                fit = np.repeat((size > 1) & (size <= crowd), size)
                if fit.any():
                    keys, fps = keys[fit], fps[fit]
                    a, b, distance = _run_links(keys, np.ascontiguousarray(fps), most, sure)
                    if len(b):
                        yield out(fps[a], fps[b], distance, keys[a])

        return run

    rows, found, places = fps.select("fp").mapInArrow(spread, "key long, fp binary"), None, None
    for depth in range(1, DEPTH + 1):
        places = rows if places is None else places.unionByName(rows)
        sorted_rows = rows.repartition("key").sortWithinPartitions("key", "fp")
        level = scratch_table(sorted_rows.mapInArrow(compare(depth), "a binary, b binary, value long, at long"), f"simhash-links-{depth}")
        own = level.filter("a IS NOT NULL").select("a", "b", F.col("value").alias("distance"), F.col("at").alias("key"))
        found = own if found is None else found.unionByName(own)
        rows = level.filter("a IS NULL").select(F.col("value").alias("key"), F.col("b").alias("fp"))
        if rows.isEmpty():
            break
    return found, places


def unjoined(places: DataFrame, keys: DataFrame, roots: DataFrame, most: int, further: Callable[[DataFrame], DataFrame], most_further: int) -> DataFrame:
    """(a, b, apart), distinct: all pairs of at most so many differing bits, and of at most so many of the LONG further ones (apart), that meet at one of the anchors (keys) and are in two groups.

    roots: (node, root); what isn't there is a group of its own. further: from (fp), distinct, to (fp, bits), the further bits as longs. They are compared in the join itself: in a large group of texts below the similarity nearly all pairs that WIDE bits leave
    in doubt are refused by these, and none of them is made a row."""
    own = places.join(keys, "key", "left_semi").distinct()
    own = scratch_table(own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "simhash-again")
    words = [F.conv(F.hex(F.substring("fp", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"w{k}") for k in range(WIDE // 64)]
    more = [F.get("bits", F.lit(k)).alias(f"x{k}") for k in range(LONG // 64)]
    own = own.join(further(own.select("fp").distinct()), "fp").select("key", "fp", "root", *words, *more)
    a, b = (own.select("key", *(F.col(c).alias(f"{side}_{c}") for c in own.columns[1:])) for side in "ab")
    apart = lambda name, n: sum((F.bit_count(F.col(f"a_{name}{k}").bitwiseXOR(F.col(f"b_{name}{k}"))) for k in range(n)), F.lit(0))
    near = (apart("w", len(words)) <= most) & (apart("x", len(more)) <= most_further)
    met = a.hint("merge").join(b, (a["key"] == b["key"]) & (F.col("a_fp") < F.col("b_fp")) & (F.col("a_root") != F.col("b_root")) & near)
    return met.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"), apart("x", len(more)).alias("apart")).distinct()


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, crowd: int = 128, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of df that stay: of each group of near copies the one with the smallest id (of those with that id, the first in the input), all columns as they were.

    Near copies are texts whose distinct shingles have a Jaccard similarity of `similarity` or more. Wide fingerprints tell where it is beyond doubt: a link has at most as many differing bits as
    are expected of that similarity and two standard deviations, and is taken as it is if it has three less than expected. Between, links that join two groups are told by LONG
    further bits in the same way, and what these leave in doubt by the shingles of both texts. Groups are the links' components. Empty and null texts, and others without words, have fingerprint zero and are one group, of which one row stays. Null ids
    come last, so that a row with an id stays if there is one. Rows that repeat an id are rows of their own. An empty input gives an empty
    result. Columns may have any names. The input must be read in the same order each time, as from files.

    Only places of rows are joined with the input: broadcast up to `broadcast_rows` of them (8 bytes each), shuffled beyond.
    """
    mark = "simhash_place"
    while mark in df.columns:
        mark += "_"
    placed = df.withColumn(mark, F.monotonically_increasing_id())
    here = lambda places: F.broadcast(places) if places.count() <= broadcast_rows else places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memo("simhash")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([wide_fingerprint(t.as_py(), shingle) for t in b.column(2)], pa.binary())], names=["id", "place", "fp"])

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memo("simhash")
        for b in batches:
            bits = [np.frombuffer(wide_fingerprint(t.as_py(), shingle, LONG, WIDE // 64), np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["place", "bits"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memo("simhash")
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), shingle) for t in part.column(1)], pa.binary())], names=["place", "shingles"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = placed.select(F.col(id_col).alias("id"), F.col(mark).alias("place"), F.col(text_col).alias("text")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, place long, fp binary")
    rows = scratch_table(rows, "simhash")

    def of(asked: DataFrame, run, schema: str, value: str) -> DataFrame:
        """(fp, value) of one text of each fingerprint asked (fp), distinct."""
        places = scratch_table(rows.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("place").alias("place")), "simhash-asked")
        texts = placed.select(F.col(mark).alias("place"), F.col(text_col).alias("text")).join(here(places.select("place")), "place", "left_semi")
        return scratch_table(texts.mapInArrow(run, schema).join(places, "place").select("fp", value), f"simhash-{value}")

    ends = lambda pairs: pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    both = lambda pairs, values, c: pairs.join(values.select(F.col("fp").alias("a"), F.col(c).alias("x")), "a").join(values.select(F.col("fp").alias("b"), F.col(c).alias("y")), "b")
    long_bits = lambda asked: of(asked, further, "place long, bits array<long>", "bits")
    most_long = wide_distance(similarity, LONG, 2)

    def alike(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose texts are near copies."""
        apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
        told = both(pairs, long_bits(ends(pairs)), "bits").select("a", "b", apart.alias("apart"))
        return settled(scratch_table(told.filter(F.col("apart") <= most_long), "simhash-told"))

    def settled(told: DataFrame) -> DataFrame:
        """Of pairs (a, b, apart) that LONG bits don't refuse those whose texts are near copies."""
        clear = F.col("apart") <= wide_distance(similarity, LONG, -3)
        # What even these bits leave in doubt is settled by the shingles of both texts.
        open_, sure = scratch_table(told.filter(~clear).select("a", "b"), "simhash-open"), told.filter(clear).select("a", "b")
        if open_.isEmpty():
            return sure
        exact = both(open_, of(ends(open_), sets, "place long, shingles binary", "shingles"), "shingles").select("a", "b", "x", "y").mapInArrow(similar, "a binary, b binary")
        return sure.unionByName(scratch_table(exact, "simhash-exact"))

    def link(fps: DataFrame) -> DataFrame:
        sure_bits, most = wide_distance(similarity, WIDE, -3), wide_distance(similarity, WIDE, 2)
        met, places = meetings(fps, most, crowd, sure_bits)
        found = scratch_table(_closest(met, most), "simhash-found")
        doubt = F.col("distance") > sure_bits
        sure = found.filter(~doubt).select("a", "b")
        roots = components(sure)
        # A text in the middle of a large group has very many links: up to a fifth of broadcast_rows roots (64 bytes each) go to the links instead.
        few = roots.count() <= broadcast_rows // 5
        root_of = lambda c: (F.broadcast if few else lambda x: x)(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")))
        joins = found.filter(doubt).join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
        joins = scratch_table(joins.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b").distinct(), "simhash-doubt")
        if not joins.isEmpty():
            told = scratch_table(alike(joins), "simhash-alike")
            sure = sure.unionByName(told)
            # A refused link, or a member that was compared with some pivots alone, may stand for others.
            met = met.join(joins.join(told, ["a", "b"], "left_anti").withColumn("refused", F.lit(True)), ["a", "b"], "left").filter((F.col("distance") > most) | F.col("refused"))
        else:
            met = met.filter(F.col("distance") > most)
        keys = scratch_table(met.select("key").distinct(), "simhash-keys")
        if keys.isEmpty():
            return sure
        rest = scratch_table(unjoined(places, keys, components(sure), most, long_bits, most_long).join(joins, ["a", "b"], "left_anti"), "simhash-rest")
        return sure if rest.isEmpty() else sure.unionByName(settled(rest))

    # Null ids last, so that a row with an id stays if there is one.
    whole = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("place")))
    first = _component_minimum(rows, whole, link)
    goes = scratch_table(rows.join(first, "fp").filter("place <> least.place").select(F.col("place").alias(mark)), "simhash-goes")
    return placed.join(here(goes), mark, "left_anti").select(*df.columns)
