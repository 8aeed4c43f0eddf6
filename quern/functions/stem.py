"""Stems of English words by Porter's algorithm (1980), with the usual later additions.

The additions: ``-ies`` and ``-ied`` of four letters keep ``ie``, a final ``y`` turns to ``i`` after
a consonant only, ``-ful`` + ``-li``, ``-bli`` and ``-logi``, and a few irregular words.
"""

from __future__ import annotations

from functools import lru_cache

# Irregular words and their stems.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# The endings of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _kinds(word: str) -> str:
    """A letter a letter: v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _kinds(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    kinds = _kinds(word)
    return kinds.endswith("cvc") and word[-1] not in "wxy" or kinds == "vc"


def _replaced(word: str, endings: dict[str, str]) -> str:
    """The longest ending that fits is replaced if what stands before has a measure."""
    for end in sorted((e for e in endings if word.endswith(e)), key=len, reverse=True):
        stem = word[: -len(end)]
        before = stem + "l" if end == "logi" else stem
        return stem + endings[end] if _measure(before) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    stem = next((word[: -len(end)] for end in ("ed", "ing") if word.endswith(end) and "v" in _kinds(word[: -len(end)])), None)
    if stem is None:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _doubled(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _bare(word: str) -> str:
    for end in STEP4:
        if word.endswith(end):
            stem = word[: -len(end)]
            fits = _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t"))
            return stem if fits else word
    return word


def _final(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short(stem):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _kinds(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    again = _replaced(word, STEP2)
    if word.endswith("alli") and again != word:
        again = _replaced(again, STEP2)
    return _final(_bare(_replaced(again, STEP3)))
