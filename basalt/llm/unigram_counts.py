"""Token counts under a unigram tokenizer, without making tokens.

A text is split as the tokenizer splits it: each space becomes a mark, one is put
in front, and a word starts at each mark. For a word, an Aho-Corasick automaton of the
vocabulary gives all pieces that end at each position; dynamic programming over the positions
carries the best score and the piece count of the best path, nothing else. Ties are the tokenizer's: of
equal scores the path whose last piece starts first stays, unknown characters come in only where no piece of that one
character is known, with a score of 10 below the lowest, and each counts as its UTF-8 bytes. Scores are
added up as 64-bit floats in the tokenizer's order, so that near-ties fall as they do there.

Counts of short words are remembered in a table of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from basalt.llm.common import process_memo

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file. Its scores are ranks of merges, so log-probabilities are made of them by Zipf's law: -ln(rank + 2); pieces without a rank come after all others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)) and model.get_score(k) > -size]
    ranks = {k: r for r, k in enumerate(sorted(plain, key=lambda k: (-model.get_score(k), k)))}
    return [(model.id_to_piece(k), -math.log(ranks.get(k, size) + 2)) for k in range(size)]


class PieceCounter:
    """Piece counts of texts for a vocabulary with byte fallback."""

    def __init__(self, vocabulary: list[tuple[str, float]], most: int = 300_000, longest: int = 48):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.most, self.longest = most, longest

    def best(self, word: str) -> int:
        """Pieces on the best path through a word."""
        n = len(word)
        score, count, reached = [0.0] * (n + 1), [0] * (n + 1), 0
        unknown, single = self.unknown, self.single
        none = -math.inf
        for end, (length, own) in self.automaton.iter(word):
            end += 1
            while reached < end:  # positions come in order, the longest piece of each first
                if reached:
                    self._unknown(word, reached, score, count, unknown, single)
                reached += 1
                score[reached] = none
            start = end - length
            if (total := own + score[start]) > score[end]:
                score[end], count[end] = total, count[start] + 1
        while reached <= n:
            if reached:
                self._unknown(word, reached, score, count, unknown, single)
            reached += 1
            if reached <= n:
                score[reached] = none
        return count[n]

    @staticmethod
    def _unknown(word, end, score, count, unknown, single) -> None:
        """The last candidate for a position: its character alone, if that is no piece."""
        c = word[end - 1]
        if c not in single and (total := unknown + score[end - 1]) > score[end]:
            score[end], count[end] = total, count[end - 1] + len(c.encode())

    def word(self, word: str) -> int:
        if len(word) > self.longest:
            return self.best(word)
        n = self.old.get(word)
        if n is None:
            n = self.best(word)
        if len(self.known) >= self.most:  # what isn't asked for until the table is full again is forgotten
            self.old, self.known = self.known, {}
        self.known[word] = n
        return n

    def text(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(MARK, " ").split(" ")
        if parts[0] == "":  # the text starts with a mark of its own
            del parts[0]
        count = 0
        for part in parts:
            n = self.known.get(MARK + part)
            count += self.word(MARK + part) if n is None else n
        return count


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document: the id, n_chars (code points), n_tokens.

    Null and empty texts have none. A text of any length is counted whole, also if it has no space. Rows that share an
    id are counted each. An empty input gives an empty result. Only the id and the text are read.
    `vocabulary` is the path of a sentencepiece file (default: the public piece_bpe_32k).
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = process_memo("token counts")
        if (key := f"pieces {vocabulary}") not in memo:
            memo[key] = PieceCounter(load_vocabulary(vocabulary))
        counter = memo[key]
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(counter.text, texts), pa.int64())], names=[id_col, "n_chars", "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_chars long, n_tokens long")
