"""The Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980)."""

from __future__ import annotations

import re

# [C](VC)^m[V]: a consonant is a letter but a, e, i, o, u, or y after a consonant
_CONSONANT, _VOWEL = "[^aeiou]", "[aeiouy]"
_RUN_C, _RUN_V = f"{_CONSONANT}[^aeiouy]*", f"{_VOWEL}[aeiou]*"
_M1 = re.compile(f"^(?:{_RUN_C})?{_RUN_V}{_RUN_C}")
_M_IS_1 = re.compile(f"^(?:{_RUN_C})?{_RUN_V}{_RUN_C}(?:{_RUN_V})?$")
_M2 = re.compile(f"^(?:{_RUN_C})?(?:{_RUN_V}{_RUN_C}){{2}}")
_HAS_VOWEL = re.compile(f"^(?:{_RUN_C})?{_VOWEL}")
_CVC = re.compile(f"^{_RUN_C}{_VOWEL}[^aeiouwxy]$")
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")

# Fixed values of the algorithm: suffixes and what replaces them where the stem before has m > 0 (steps 2 and 3).
_STEP_2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
# Step 4: suffixes that go where the stem before has m > 1.
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _ending(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    first_y = word[0] == "y"
    w = "Y" + word[1:] if first_y else word  # a first y is a consonant
    # 1a: plurals
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b: -eed, -ed, -ing
    if w.endswith("eed"):
        if _M1.match(w[:-3]):
            w = w[:-1]
    else:
        cut = _ending(w, ("ed", "ing"))
        if cut and _HAS_VOWEL.match(w[: -len(cut)]):
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _DOUBLE.search(w):
                w = w[:-1]
            elif _CVC.match(w):
                w += "e"
    # 1c
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP_2, _STEP_3):
        if (end := _ending(w, table)) and _M1.match(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    # 4
    if end := _ending(w, [*_STEP_4, "ion"]):
        body = w[: -len(end)]
        if _M2.match(body) and (end != "ion" or body.endswith(("s", "t"))):
            w = body
    # 5
    if w.endswith("e"):
        body = w[:-1]
        if _M2.match(body) or (_M_IS_1.match(body) and not _CVC.match(body)):
            w = body
    if w.endswith("ll") and _M2.match(w[:-1] if w.endswith("ll") else w):
        w = w[:-1]
    return "y" + w[1:] if first_y else w
