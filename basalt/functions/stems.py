"""Porter's stemmer."""

from __future__ import annotations

import re
from functools import lru_cache

# The algorithm's suffixes with what replaces them (fixed values). Of a step the longest suffix that a word ends with counts.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
COMPLETED = {"at": "ate", "bl": "ble", "iz": "ize"}
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
ENDINGS = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
DROPPED = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v for vowels, c for consonants; a y behind a consonant is a vowel."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out.endswith("c") else "c"
    return out


def measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", shape(word)))


def _short(word: str) -> bool:
    """Whether a word ends in consonant, vowel, consonant, the last none of w, x, y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _ending(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replaced(word: str, table: dict[str, str]) -> str:
    s = _ending(word, table)
    return word if s is None or measure(word[: -len(s)]) == 0 else word[: -len(s)] + table[s]


def _past(word: str) -> str:
    """Without eed, ed and ing, and what is left put right."""
    s = _ending(word, ("eed", "ed", "ing"))
    if s == "eed":
        return word[:-1] if measure(word[:-3]) else word
    if s is None or "v" not in shape(word[: -len(s)]):
        return word
    word = word[: -len(s)]
    if t := _ending(word, COMPLETED):
        return word[: -len(t)] + COMPLETED[t]
    if len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if measure(word) == 1 and _short(word) else word


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if s := _ending(word, PLURALS):
        word = word[: -len(s)] + PLURALS[s]
    word = _past(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, DOUBLE_SUFFIXES), ENDINGS)
    s = _ending(word, DROPPED)
    if s and measure(word[: -len(s)]) > 1 and (s != "ion" or word[-4] in "st"):
        word = word[: -len(s)]
    if word.endswith("e") and ((m := measure(word[:-1])) > 1 or m == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word
