"""English stems by suffix stripping with measure conditions (Porter's second algorithm, as published with the Snowball language)."""

from __future__ import annotations

import re
from functools import lru_cache

# The word lists and endings of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
           "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
UNCHANGED_WITHOUT_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
          "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
          "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
VOWEL = "[aeiouy]"
REGION = re.compile(f"{VOWEL}[^aeiouy]")
LONG_PREFIX = re.compile("gener|commun|arsen")
SHORT_END = re.compile(f"(^|[^aeiouy]){VOWEL}[^aeiouywxY]$|^{VOWEL}[^aeiouy]$")
DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words that differ by inflection share it."""
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)  # a Y that is a consonant
    prefix = LONG_PREFIX.match(word)
    found = None if prefix else REGION.search(word)
    r1 = prefix.end() if prefix else found.end() if found else len(word)
    found = REGION.search(word, r1)
    r2 = found.end() if found else len(word)

    # plurals
    ending = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and re.search(VOWEL, word[:-2]):
        word = word[:-1]
    if word in UNCHANGED_WITHOUT_PLURAL:
        return word

    # past tense and participles
    ending = _longest(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[:-len(ending)] + "ee"
    elif ending and re.search(VOWEL, word[:-len(ending)]):
        word = word[:-len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif DOUBLE.search(word):
            word = word[:-1]
        elif len(word) <= r1 and SHORT_END.search(word):
            word += "e"
    word = re.sub("(?<=.[^aeiouy])[yY]$", "i", word)

    # derived forms, in the region after the first syllable
    ending = _longest(word, STEP_2)
    if ending and len(word) - len(ending) >= r1:
        rest = word[:-len(ending)]
        if not (ending == "li" and not re.search("[cdeghkmnrt]$", rest) or ending == "ogi" and not rest.endswith("l")):
            word = rest + STEP_2[ending]
    ending = _longest(word, STEP_3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[:-len(ending)] + STEP_3[ending]
    ending = _longest(word, STEP_4)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[:-len(ending)]
    if word.endswith("e") and (len(word) > r2 or len(word) > r1 and not SHORT_END.search(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")
