"""Rules written as plain phrases, and the patterns they stand for.

A phrase is words parted by blanks. `a|b` is either word, a closing `?` makes a word optional, `_` stands for a blank inside an
alternative, `-` for a hyphen, a blank or nothing, `#` for a number, and `..n` for up to n words of any kind. Case does not
count, and a phrase begins and ends at whole words; a word that ends with `*` may go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

_GAP = r"[\s,:;/()'\"–-]+"


def _word(word: str) -> str:
    if word == "#":
        return r"\d{1,3}"
    goes_on = word.endswith("*")
    body = _GAP.join(r"[\s-]?".join(re.escape(piece) for piece in part.split("-")) for part in word.rstrip("*").split("_"))
    return body + (r"\w*" if goes_on else "")


def phrase(text: str) -> str:
    """The pattern of one phrase, without its ends."""
    tokens = text.split()
    last = max(i for i, t in enumerate(tokens) if not t.endswith("?"))
    out = ""
    for i, token in enumerate(tokens):
        if token.startswith(".."):
            out += rf"(?:[^\s.]+\s+){{0,{int(token[2:])}}}"
            continue
        body = "(?:" + "|".join(_word(w) for w in token.rstrip("?").split("|")) + ")"
        if i > last:
            out += f"(?:{_GAP}{body})?"
        elif i == last:
            out += body
        else:
            out += f"(?:{body}{_GAP})?" if token.endswith("?") else body + _GAP
    return out


def _first(text: str) -> set[str]:
    """The characters a phrase can begin with."""
    out: set[str] = set()
    for token in text.split():
        if token.startswith(".."):
            raise ValueError(f"a phrase begins with a word: {text}")
        out |= {r"\d" if word == "#" else re.escape(word[0]) for word in token.rstrip("?").split("|")}
        if not token.endswith("?"):
            return out
    return out


def pattern(phrases: Iterable[str]) -> str:
    """Any of the phrases. Characters that none begins with are passed over by one test."""
    phrases = list(phrases)
    first = "".join(sorted(set().union(*map(_first, phrases))))
    return rf"(?i)(?=[{first}])(?<![\w])(?:" + "|".join(phrase(p) for p in phrases) + r")(?![\w])"
