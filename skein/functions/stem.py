"""English stems by Porter's algorithm (1980), with the usual later additions, and the two tokenizers that use them."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from skein.functions.text import STOPWORDS

# The algorithm's suffixes, what they become, and words with stems of their own.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
SINGLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
IDENTIFIER = re.compile(r"[a-zA-Z0-9_]+(?:[./:][a-zA-Z0-9_]+)+")
SCHEME = re.compile(r"(?:https?|ftp)://", re.I)
WORD = re.compile(r"[a-zA-Z0-9_\-]{2,}")
_STOP = frozenset(STOPWORDS)


def _shape(word: str) -> str:
    """c or v for every letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end; or just a vowel and a consonant."""
    s = _shape(word)
    return s == "vc" or (s.endswith("cvc") and word[-1] not in "wxy")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-3] + ("ie" if len(word) == 4 else "i")
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    base = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
    if base is None:
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c":
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if _measure(base) == 1 and _short_end(base) else base


def _second(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]):
        return _second(word[:-4] + "al")
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) else word
    s = _longest(word, DOUBLE)
    return word[: -len(s)] + DOUBLE[s] if s and _measure(word[: -len(s)]) else word


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a word in any case."""
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif s := _longest(word, PLURALS):
        word = word[: -len(s)] + PLURALS[s]
    word = _past(word)
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _second(word)
    if (s := _longest(word, SINGLE)) and _measure(word[: -len(s)]):
        word = word[: -len(s)] + SINGLE[s]
    if s := _longest(word, LAST):
        base = word[: -len(s)]
        if _measure(base) > 1 and (s != "ion" or base[-1:] in ("s", "t")):
            word = base
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def word_tokens(text: str) -> list[str]:
    """FN6: stems of the runs of at least two of [a-zA-Z0-9_-] that aren't stop words."""
    return [stem(w) for w in map(str.lower, WORD.findall(text)) if w not in _STOP]


def namespace_tokens(text: str) -> list[str]:
    """FN7: dotted, path and colon identifiers whole, then for each its distinct parts as stems, with the words before it, then the words after the last."""
    bare = SCHEME.sub(" ", text)
    found = list(IDENTIFIER.finditer(bare))
    if not found:
        return word_tokens(text)
    out, at = [m[0].lower() for m in found], 0
    for m in found:
        parts = (p.lower() for p in re.split("[./:]+", m[0]) if len(p) > 1)
        out += dict.fromkeys(stem(p) for p in parts if p not in _STOP)
        out += word_tokens(bare[at : m.start()])
        at = m.end()
    return out + word_tokens(bare[at:])


def _column(c: Column | str, of) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: of(t or "")), "array<string>", functionType=PandasUDFType.SCALAR)(c)


def stemmed(c: Column | str) -> Column:
    """FN6 as a column; a null text has no tokens."""
    return _column(c, word_tokens)


def namespaced(c: Column | str) -> Column:
    """FN7 as a column; a null text has no tokens."""
    return _column(c, namespace_tokens)
