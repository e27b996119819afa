"""The English stemmer that full-text search names its words with: the public Snowball rules (Porter 2), step by step.

Each step takes a word and gives it back with its ending changed. A word has two regions: the first begins behind the first consonant that follows a
vowel, the second is the same again within the first. Endings go only where they lie in the region that their rule names.
"""

from __future__ import annotations

import re

# Fixed values of the rules.
VOWELS = "aeiouy"
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
WHOLE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
FIRST_REGION = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
#: Endings in the first region and what takes their place.
LONG_ENDINGS = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
MIDDLE_ENDINGS = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Endings that go from the second region.
LAST_ENDINGS = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_SHORT_END = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    named = next((len(p) for p in FIRST_REGION if word.startswith(p)), None)
    first = named if named is not None else m.end() if (m := _REGION.match(word)) else len(word)
    second = m.end() if (m := _REGION.match(word, first)) else len(word)
    return first, second


def _ending(word: str, endings: tuple[str, ...]) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    ending = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return word
    stem = word[: len(word) - len(ending)]
    if ending.startswith("ee"):
        return stem + "ee" if len(stem) >= first else word
    if not _has_vowel(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(DOUBLES):
        return stem[:-1]
    return stem + "e" if first >= len(stem) and _SHORT_END.search(stem) else stem


def _replaced(word: str, endings: dict[str, str], first: int, second: int) -> str:
    ending = _ending(word, tuple(endings))
    if ending is None or len(word) - len(ending) < (second if ending == "ative" else first):
        return word
    stem = word[: len(word) - len(ending)]
    if ending == "ogi" and not stem.endswith("l") or ending == "li" and stem[-1:] not in tuple(BEFORE_LI):
        return word
    return stem + endings[ending]


def _shortened(word: str, second: int) -> str:
    ending = _ending(word, LAST_ENDINGS)
    if ending is None or len(word) - len(ending) < second:
        return word
    stem = word[: len(word) - len(ending)]
    return word if ending == "ion" and not stem.endswith(("s", "t")) else stem


def _last_letter(word: str, first: int, second: int) -> str:
    at = len(word) - 1
    if word.endswith("e") and (at >= second or at >= first and not _SHORT_END.search(word[:-1])):
        return word[:-1]
    return word[:-1] if word.endswith("ll") and at >= second else word


def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters stay."""
    if len(word) < 3 or word in IRREGULAR:
        return IRREGULAR.get(word, word)
    word = re.sub(r"([aeiouy])y", r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    first, second = _regions(word)
    word = _plural(word)
    if word in WHOLE:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _replaced(word, LONG_ENDINGS, first, second)
    word = _replaced(word, MIDDLE_ENDINGS, first, second)
    word = _shortened(word, second)
    return _last_letter(word, first, second).replace("Y", "y")
