"""The Porter stemmer (Porter, "An algorithm for suffix stripping", Program 14, 1980), with the few additions that current
libraries make by default: short words stay, a pool of irregular forms, -ies and -ied of four letters, y after a consonant,
-bli, -alli, -fulli and -logi, and the short-word rule for stems of two letters."""

from __future__ import annotations

from functools import lru_cache

# Irregular forms.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffixes and what replaces them where a vowel-consonant sequence precedes.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(word: str) -> bool:
    s = _shape(word)
    return s[-3:] == "cvc" and word[-1] not in "wxy" or len(word) == 2 and s == "vc"


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    best = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if best is None:
        return word
    stem = word[: -len(best[0])]
    if best[0] == "logi":
        return stem + best[1] if _measure(stem + "l") > least else word
    return stem + best[1] if _measure(stem) > least else word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    # plurals
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and progressive
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                base = word[: -len(end)]
                if "v" in _shape(base):
                    word = base
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c":
                        word = word if word[-1] in "lsz" else word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = _replace(word[:-2], STEP2, 0)
    else:
        word = _replace(word, STEP2, 0)
    word = _replace(word, STEP3, 0)
    end = max((e for e in STEP4 if word.endswith(e)), key=len, default="")
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short(base):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
