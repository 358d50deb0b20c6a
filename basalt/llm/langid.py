"""Language identification by interpolated Kneser-Ney character models.

Training counts, over all labelled documents, the character 5-grams of each language's words
(runs of letters, lower-cased, padded so that each letter has four before it). Executors count each Arrow
batch's distinct words once and send distinct 5-grams with counts; Spark adds them up. Lower
orders need only the distinct 5-grams (continuation counts). Spark computes the model over all of them. The tables are sorted
arrays of 64-bit hashes with a row of log-probabilities, one for each language; they hold every n-gram. Up to `broadcast_bytes` they
are broadcast, and a worker scores texts by look-up. A larger model stays in its tables: each distinct 5-gram of the texts is scored once by joins,
and scores are added up by word and by document, with the same results.

A text gets, for each language, the mean negative log-probability of its letters; the lowest wins.
Rejection is calibrated on the training counts of each language: a text is rejected if it has no letter, or if its
cross-entropy lies both beyond `reject_at` of the way from the language's own to that of guessing evenly among the language's own letters, and more than
`reject_sigmas` standard errors above the language's own. Without a model only texts without a letter are rejected.

Words are scored once and remembered in a table of bounded size.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import own_key, process_memo, scratch_table

ORDER = 5
PAD = " "
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(token: str) -> list[str]:
    """Runs of letters; such as have only signs like ½ are none."""
    return [w for w in _LETTERS.findall(token.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position of an array of code points."""
    size = len(points) - n + 1
    out = np.zeros(max(0, size), np.uint64)
    for k in range(n if size > 0 else 0):
        out = (out ^ points[k : k + size]) * _PRIME
        out ^= out >> np.uint64(29)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, str]:
    """The words behind one another, each with ORDER - 1 pads before and one after it; where the n-gram of each letter and end starts; the text."""
    text = "".join(f"{PAD * (ORDER - 1)}{w}{PAD}" for w in words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    starts = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    return starts, lengths, text


def count_grams(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): 5-grams of each language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memo("langid")
        for b in (part for whole in batches for part in (whole.slice(lo, 4096) for lo in range(0, len(whole), 4096))):
            by_lang: dict[str, Counter] = {}
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update((text.as_py() or "").split())
            for lang, tokens in by_lang.items():
                words: Counter = Counter()
                for token, n in tokens.items():
                    for w in words_of(token):
                        words[w] += n
                if not words:
                    continue
                starts, lengths, text = _padded(list(words))
                hashes = gram_hashes(_points(text), ORDER)[starts]
                weights = np.repeat(np.fromiter(words.values(), np.int64, len(words)), lengths)
                _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                n = np.bincount(inverse, weights).astype(np.int64)
                grams = [text[s : s + ORDER] for s in starts[first].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n)], names=["lang", "gram", "n"])

    return df.select(text_col, lang_col).mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray]  # by order - 1: sorted hashes
    logs: list[np.ndarray]  # log-probabilities, a column for each language, backed off where it hasn't seen the n-gram
    contexts: list[np.ndarray]  # by order - 2: sorted hashes of contexts
    backoffs: list[np.ndarray]  # log back-off weights, 0 where unseen
    unseen: np.ndarray  # log-probability of a character that no language has
    entropy: np.ndarray
    sigma: np.ndarray
    even: np.ndarray  # cross-entropy of guessing evenly among a language's own letters

    def word_logs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities (a column for each language) and number of predicted characters of each word."""
        starts, lengths, text = _padded(words)
        logs = self._letters(_points(text), starts)
        return np.add.reduceat(logs, np.cumsum(lengths) - lengths, axis=0), lengths

    def _letters(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-probabilities of the character that ends each 5-gram: most are found whole, the rest back off order by order."""
        out = np.zeros((len(starts), len(self.langs)))
        open_, rest = np.arange(len(starts)), np.zeros((len(starts), len(self.langs)))
        for n in range(ORDER, 0, -1):
            first = starts[open_] + ORDER - n
            rows, found = _look_up(self.grams[n - 1], _hashes_at(points, first, n))
            out[open_[found]] = rest[found] + self.logs[n - 1][rows[found]]
            open_, rest, first = open_[~found], rest[~found], first[~found]
            if not len(open_):
                break
            if n > 1:
                rows, found = _look_up(self.contexts[n - 2], _hashes_at(points, first, n - 1))
                rest = rest + np.where(found[:, None], self.backoffs[n - 2][rows], 0)
            else:
                out[open_] = rest + self.unseen
        return out


def _hashes_at(points: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    return _row_hashes(points[first[:, None] + np.arange(n)])


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return rows, keys[rows] == wanted


def _kneser_ney(points: np.ndarray, counts: np.ndarray, letters: int) -> tuple[list, list]:
    """Of one language: by order, (hashes, log-probabilities) of n-grams and (hashes, log back-off weights) of contexts. points: a row for each distinct 5-gram."""
    grams, contexts, at = [], [], []
    for n in range(ORDER, 0, -1):
        tail = points[:, ORDER - n :]
        keys = _row_hashes(tail)
        # Of the highest order the count itself, of the others the number of distinct characters before.
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if n == ORDER:
            c = np.bincount(inverse, counts)
        else:
            longer = np.unique(np.stack([inverse.astype(np.uint64), points[:, ORDER - n - 1]]), axis=1)[0].astype(np.int64)
            c = np.bincount(longer, minlength=len(keys)).astype(float)
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = _row_hashes(tail[first][:, :-1]) if n > 1 else np.zeros(len(keys), np.uint64)
        context_keys, own = np.unique(context, return_inverse=True)
        total, types = np.bincount(own, c), np.bincount(own)
        backoff = discount * types / total
        grams.append((keys, np.maximum(c - discount, 0) / total[own], own, _row_hashes(tail[first][:, 1:]) if n > 1 else None))
        contexts.append((context_keys, backoff))
        at.append(first)
    grams, contexts, at = grams[::-1], contexts[::-1], at[::-1]
    out_grams, lower = [], None
    for n, (keys, p, own, suffix) in enumerate(grams, 1):
        below = 1 / letters if n == 1 else lower[1][np.searchsorted(lower[0], suffix)]
        lower = (keys, p + contexts[n - 1][1][own] * below)
        out_grams.append((keys, np.log(lower[1]), points[:, ORDER - n :][at[n - 1]]))
    return out_grams, [(k, np.log(b)) for k, b in contexts]


def _row_hashes(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        out = (out ^ points[:, k]) * _PRIME
        out ^= out >> np.uint64(29)
    return out


def build_model(by_lang: dict[str, tuple[str, np.ndarray]]) -> Model | None:
    """From each language's 5-grams, behind one another, and their counts; None without any."""
    langs = sorted(by_lang)
    if not langs:
        return None
    own_points = [(_points(by_lang[lang][0]).reshape(-1, ORDER), by_lang[lang][1].astype(float)) for lang in langs]
    letters = len(np.unique(np.concatenate([p[:, -1] for p, _ in own_points]))) + 1
    tables = [_kneser_ney(points, counts, letters) for points, counts in own_points]

    def joint(parts: list[tuple[np.ndarray, np.ndarray]], empty: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in parts]))
        values = np.full((len(keys), len(parts)), empty, np.float32)
        for j, (k, v) in enumerate(parts):
            values[np.searchsorted(keys, k), j] = v
        return keys, values

    contexts = [joint([t[1][n] for t in tables], 0) for n in range(1, ORDER)]
    unseen = np.array([t[1][0][1][0] - np.log(letters) for t in tables], np.float32)
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(ORDER):
        parts = [t[0][n] for t in tables]
        keys, values = joint([p[:2] for p in parts], np.nan)
        _, one = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        own = np.concatenate([p[2] for p in parts])[one]
        below = np.broadcast_to(unseen, values.shape)
        if n:
            rows, found = _look_up(contexts[n - 1][0], _row_hashes(own[:, :-1]))
            below = np.where(found[:, None], contexts[n - 1][1][rows], 0) + grams[n - 1][1][_look_up(grams[n - 1][0], _row_hashes(own[:, 1:]))[0]]
        grams.append((keys, np.where(np.isnan(values), below, values).astype(np.float32)))
    model = Model(langs, [g[0] for g in grams], [g[1] for g in grams], [c[0] for c in contexts], [c[1] for c in contexts], unseen, np.zeros(len(langs)), np.zeros(len(langs)), np.log([len(t[0][0][0]) + 1 for t in tables]))
    for j, (points, counts) in enumerate(own_points):
        logs = model._letters(points.ravel(), np.arange(len(points)) * ORDER)[:, j].astype(float)
        model.entropy[j] = -np.average(logs, weights=counts)
        model.sigma[j] = np.sqrt(np.average((logs + model.entropy[j]) ** 2, weights=counts))
    return model


def _hashed(df: DataFrame, n: int, values: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the n-grams in column `gram`, and a row of the columns v0, v1, ... for each."""
    names = [f"v{j}" for j in range(values)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _row_hashes(_points("".join(b.column(0).to_pylist())).reshape(-1, n))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(b.column(k + 1) for k in range(values))], names=["key", *names])

    found = df.select("gram", *names).mapInArrow(run, ", ".join(["key long", *(f"{v} float" for v in names)])).toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    out = np.empty((len(keys), values), np.float32)
    for j, v in enumerate(names):
        out[:, j] = found[v].to_numpy()[order]
    return keys[order], out


@dataclass
class Tables:
    """A model that is too large to be broadcast."""

    langs: list[str]
    grams: list[DataFrame]  # by order - 1: (gram, v0, v1, ...), log-probabilities by language
    contexts: list[DataFrame]  # by order - 2: (gram, v0, v1, ...), log back-off weights
    unseen: np.ndarray
    entropy: np.ndarray
    sigma: np.ndarray
    even: np.ndarray


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", broadcast_bytes: int = 128 << 20) -> Model | Tables | None:
    """A model of the languages of the rows of df that have text and language; None without any.

    Counts, discounts, back-off weights and probabilities are those of all 5-grams and are computed in Spark: a row for each
    n-gram, a column for each language. The driver gets hashes and log-probabilities if they take `broadcast_bytes` at most.
    """
    counted = scratch_table(count_grams(df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()), text_col, lang_col), "langid-grams")
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not langs:
        return None
    each = range(len(langs))
    wide = counted.groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"c{j}") for j, lang in enumerate(langs)))
    most = counted.count()  # of all levels
    levels = [scratch_table(wide, "langid-5", rows=most)]
    for n in range(ORDER - 1, 0, -1):
        # Of the lower orders the number of distinct characters before.
        levels.append(scratch_table(levels[-1].groupBy(F.expr("substr(gram, 2)").alias("gram")).agg(*(F.count_if(F.col(f"c{j}") > 0).alias(f"c{j}") for j in each)), f"langid-{n}", rows=most))
    levels.reverse()
    letters = levels[0].count() + 1
    own_letters = levels[0].agg(*(F.count_if(F.col(f"c{j}") > 0) for j in each)).first()
    grams, contexts, below, unseen = [], [], None, np.zeros(len(langs), np.float32)
    for n, level in enumerate(levels, 1):
        few = level.agg(*(F.count_if(F.col(f"c{j}") == k) for j in each for k in (1, 2))).first()
        discounts = [ones / (ones + 2 * twos) if ones and twos else 0.5 for ones, twos in zip(few[::2], few[1::2], strict=True)]
        own = level.withColumn("context", F.expr(f"substr(gram, 1, {n - 1})"))
        sums = own.groupBy("context").agg(*(F.sum(f"c{j}").alias(f"t{j}") for j in each), *(F.count_if(F.col(f"c{j}") > 0).alias(f"y{j}") for j in each))
        # A language that hasn't seen the context leaves all to the order below.
        weights = scratch_table(sums.select("context", *(f"t{j}" for j in each), *(F.when(F.col(f"t{j}") > 0, discounts[j] * F.col(f"y{j}") / F.col(f"t{j}")).otherwise(1.0).alias(f"b{j}") for j in each)), f"langid-contexts-{n}", rows=most)
        joined = own.join(weights, "context")
        if n > 1:
            joined = joined.withColumn("suffix", F.expr("substr(gram, 2)")).join(below.select(F.col("gram").alias("suffix"), *(F.col(f"p{j}").alias(f"q{j}") for j in each)), "suffix")
            contexts.append(weights.select(F.col("context").alias("gram"), *(F.log(f"b{j}").cast("float").alias(f"v{j}") for j in each)))
        else:
            joined = joined.select("*", *(F.lit(1 / letters).alias(f"q{j}") for j in each))
            unseen = np.log(np.array([weights.first()[f"b{j}"] for j in each]) / letters).astype(np.float32)
        share = [F.when(F.col(f"t{j}") > 0, F.greatest(F.col(f"c{j}") - F.lit(discounts[j]), F.lit(0.0)) / F.col(f"t{j}")).otherwise(0.0) for j in each]
        below = scratch_table(joined.select("gram", *(f"c{j}" for j in each), *((share[j] + F.col(f"b{j}") * F.col(f"q{j}")).alias(f"p{j}") for j in each)), f"langid-probabilities-{n}", rows=most)
        grams.append(below.select("gram", *(F.log(f"p{j}").cast("float").alias(f"v{j}") for j in each)))
    # Entropy and spread of each language over all its letters.
    moments = below.agg(*(F.sum(F.col(f"c{j}") * F.log(f"p{j}") ** k) / F.sum(f"c{j}") for j in each for k in (1, 2))).first()
    means, squares = np.array(moments[::2]), np.array(moments[1::2])
    rest = (unseen, -means, np.sqrt(np.maximum(squares - means**2, 0)), np.log(np.array(own_letters) + 1))
    if sum(t.count() for t in (*grams, *contexts)) * (8 + 4 * len(langs)) > broadcast_bytes:
        return Tables(langs, grams, contexts, *rest)
    hashed = [_hashed(t, n, len(langs)) for n, t in enumerate(grams, 1)]
    backed = [_hashed(t, n, len(langs)) for n, t in enumerate(contexts, 1)]
    return Model(langs, [k for k, _ in hashed], [v for _, v in hashed], [k for k, _ in backed], [v for _, v in backed], *rest)


class Scorer:
    """Cross-entropies of texts; words are remembered."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.forget()

    def forget(self) -> None:
        """Start anew; what is asked for again is taken from the words before."""
        self.old: tuple[dict[str, int], np.ndarray] = (getattr(self, "row", {}), getattr(self, "logs", None))
        self.row: dict[str, int] = {}
        self.logs = np.zeros((1024, len(self.model.langs) + 1))

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.row]
        if len(self.row) + len(new) > self.most:
            self.forget()
            new = list(tokens)
        if not new:
            return
        base = len(self.row)
        while len(self.logs) < base + len(new):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        self.logs[base : base + len(new)] = 0
        words, of, old = [], [], self.old[0]
        for k, token in enumerate(new):
            self.row[token] = base + k
            if token in old:
                self.logs[base + k] = self.old[1][old[token]]
                continue
            for w in words_of(token):
                words.append(w)
                of.append(base + k)
        if words:
            logs, lengths = self.model.word_logs(words)
            np.add.at(self.logs, np.array(of), np.concatenate([logs, lengths[:, None]], axis=1))

    def text(self, tokens: list[str]) -> np.ndarray:
        """Summed log-probabilities by language, and the number of predicted characters."""
        return self.logs[np.fromiter(map(self.row.__getitem__, tokens), np.int64, len(tokens))].sum(axis=0)


def _by_joins(df: DataFrame, model: Tables, text_col: str, columns: list[str], names: list[str], reject_sigmas: float, reject_at: float) -> DataFrame:
    """identify() with a model in tables. df must be read in the same order each time, as from files."""
    mark, each = "langid_place", range(len(model.langs))
    while mark in df.columns:
        mark += "_"
    placed = df.withColumn(mark, F.monotonically_increasing_id())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 512):
                b = whole.slice(lo, 512)
                found = [(p, w, n) for p, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for w, n in Counter(w for token in (t.as_py() or "").split() for w in words_of(token)).items()]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["place", "word", "n"])

    held = scratch_table(placed.select(F.col(mark).alias("place"), F.col(text_col).alias("text")).mapInArrow(words, "place long, word string, n long"), "langid-words")
    padded = F.concat(F.lit(PAD * (ORDER - 1)), F.col("word"), F.lit(PAD))
    starts = F.sequence(F.lit(1), F.char_length("word") + 1)
    pieces = held.select("word").distinct().select("word", F.explode(F.transform(starts, lambda k: F.substr(padded, k, F.lit(ORDER)))).alias("gram"))
    scored = pieces.select("gram").distinct()
    found = [F.lit(float(x)) for x in model.unseen]
    for n in range(1, ORDER + 1):
        tail = F.substr("gram", F.lit(ORDER - n + 1), F.lit(n))
        if n > 1:
            backs = model.contexts[n - 2].select(F.col("gram").alias("context"), *(F.col(f"v{j}").alias(f"b{j}") for j in each))
            scored = scored.withColumn("context", F.substr(tail, F.lit(1), F.lit(n - 1))).join(backs, "context", "left").drop("context")
            found = [F.coalesce(F.col(f"b{j}"), F.lit(0.0)) + F.col(f"l{j}") for j in each]
        own = model.grams[n - 1].withColumnRenamed("gram", "tail")
        scored = scored.withColumn("tail", tail).join(own, "tail", "left").drop("tail")
        scored = scored.withColumns({f"l{j}": F.coalesce(F.col(f"v{j}").cast("double"), found[j]) for j in each}).select("gram", *(f"l{j}" for j in each))
    # Some n-grams stand in very many words, some words in nearly all texts.
    scored = scored.select(own_key("gram").alias("key"), *(f"l{j}" for j in each))
    by_word = pieces.select("word", own_key("gram").alias("key")).join(scored, "key").groupBy("word").agg(F.count(F.lit(1)).alias("m"), *(F.sum(f"l{j}").alias(f"l{j}") for j in each))
    by_word = by_word.withColumn("key", own_key("word")).drop("word")
    sums = held.select("place", "n", own_key("word").alias("key")).join(by_word, "key").groupBy("place").agg(F.sum(F.col("n") * F.col("m")).alias("m"), *(F.sum(F.col("n") * F.col(f"l{j}")).alias(f"l{j}") for j in each))
    mean = F.array(*(-F.col(f"l{j}") / F.col("m") for j in each))
    best = sums.select("place", "m", mean.alias("mean"), (F.array_position(mean, F.array_min(mean)) - 1).cast("int").alias("j"))
    at = lambda xs: F.get(F.array(*(F.lit(float(x)) for x in xs)), F.col("j"))
    low, own, letters = F.get("mean", F.col("j")), at(model.entropy), F.least(F.col("m").cast("double"), F.lit(40.0))
    share = F.aggregate("mean", F.lit(0.0), lambda total, x: total + F.exp((low - x) * letters))
    far = (low > own + reject_at * (at(model.even) - own)) & ((low - own) * F.sqrt(F.col("m").cast("double")) > reject_sigmas * at(model.sigma))
    decided = best.select(F.col("place").alias(mark), F.get(F.array(*map(F.lit, model.langs)), F.col("j")).alias("p"), (1 / share).alias("s"), low.alias("e"), far.alias("r"))
    of = zip(names, (F.coalesce("p", F.lit(UNDETERMINED)), F.coalesce("s", F.lit(0.0)), F.col("e"), F.coalesce("r", F.lit(True))), strict=True)
    left, right = placed.select(mark, *(F.col(c).alias(f"langid_c_{c}") for c in columns)), decided
    return left.join(right, mark, "left").select(*(F.col(f"langid_c_{c}").alias(c) for c in columns), *(v.alias(n) for n, v in of))


def identify(df: DataFrame, model: Model | Tables | None, id_col: str = "doc_id", text_col: str = "text", reject_sigmas: float = 6.0, reject_at: float = 0.75, carry: list[str] | None = None, prefix: str = "", cache_words: int = 200_000) -> DataFrame:
    """One row per document: the id (or the columns of `carry`), lang_pred, score, cross_entropy, rejected, each behind `prefix`.

    lang_pred is the language of the lowest length-normalised cross-entropy, `und` if text is null or has no letter or there is no model; of equal languages
    the first in order wins. score is the share of that language among all by likelihood of up to 40 letters of such a text, 0 for
    `und`. rejected marks texts without a letter and those that no learned language explains; without a model only the former. Rows that share an id are scored each;
    an empty input gives an empty result; texts are scored whole, whatever their length. A worker remembers up to cache_words words, twice.
    """
    columns = carry or [id_col]
    names = [prefix + c for c in ("lang_pred", "score", "cross_entropy", "rejected")]
    if isinstance(model, Tables):
        return _by_joins(df, model, text_col, columns, names, reject_sigmas, reject_at)
    shipped = df.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    sent = columns if text_col in columns else [*columns, text_col]
    text_at = sent.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = process_memo("langid")
        model = shipped.value
        if model is not None and memo.get("langid", (None,))[0] != key:
            memo["langid"] = (key, Scorer(model, cache_words))
        scorer = memo["langid"][1] if model is not None else None
        for batch in batches:
            for lo in range(0, len(batch), 256):
                b = batch.slice(lo, 256)
                split = [(t.as_py() or "").split() for t in b.column(text_at)]
                preds, scores, entropies, rejected = [], [], [], []
                if scorer:
                    scorer.learn({t for tokens in split for t in tokens})
                for tokens in split:
                    sums = scorer.text(tokens) if scorer and tokens else None
                    if sums is None or not sums[-1]:
                        preds.append(UNDETERMINED)
                        scores.append(0.0)
                        entropies.append(None)
                        rejected.append(bool(scorer) or not any(map(words_of, tokens)))
                        continue
                    n = sums[-1]
                    mean = -sums[:-1] / n
                    j = int(np.argmin(mean))
                    share = np.exp(-(mean - mean[j]) * min(n, 40.0))
                    own = model.entropy[j]
                    preds.append(model.langs[j])
                    scores.append(float(1 / share.sum()))
                    entropies.append(float(mean[j]))
                    rejected.append(bool(mean[j] > own + reject_at * (model.even[j] - own) and (mean[j] - own) * np.sqrt(n) > reject_sigmas * model.sigma[j]))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in range(len(columns))), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*columns, *names],
                )

    added = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "double", "boolean"), strict=True))
    return df.select(*sent).mapInArrow(run, f"{fields}, {added}")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
