"""The stemmer of M. F. Porter, An algorithm for suffix stripping, Program 14(3), 1980, from the paper's rules."""

from __future__ import annotations

import re

# Suffix rules of steps 2, 3 and 4 of the paper (fixed values).
_STEP2 = ("ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, "
          "alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble")
_STEP3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _pairs(rules: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.strip(" ").partition(" ")[::2]) for r in rules.split(",")), key=lambda p: -len(p[0]))


_TWO, _THREE, _FOUR = _pairs(_STEP2), _pairs(_STEP3), sorted(_STEP4.split(), key=len, reverse=True)


def _shape(stem: str) -> str:
    """The letters as c and v; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for old, new in rules:
        if w.endswith(old):
            head = w[: -len(old)]
            return head + new if _measure(head) > least else w
    return w


def stem_word(word: str) -> str:
    """The stem of a word, in lower case. Words of one or two letters stay as they are."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("s"):  # step 1a
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):  # step 1b
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):  # step 1c
        w = w[:-1] + "i"
    w = _swap(_swap(w, _TWO, 0), _THREE, 0)
    for s in _FOUR:
        if w.endswith(s):
            head = w[: -len(s)]
            if _measure(head) > 1 and (s != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e"):  # step 5
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
