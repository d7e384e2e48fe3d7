"""Text column expressions: folding, word-start matching, key prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the plain letter each is read as.
ACCENTED = "àáâãäåāăąçćčďđðèéêëēėęěğìíîïīįıłľñńňòóôõöøōőŕřśšşșťţțùúûüūůűųýÿźżž"
PLAIN = "aaaaaaaaacccdddeeeeeeeegiiiiiiillnnnoooooooorrsssstttuuuuuuuuyyzzz"
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))


def fold(c: Column) -> Column:
    """Lower case without Latin accents: "Zürich" is "zurich", "Straße" "strasse"."""
    out = F.translate(F.lower(c), ACCENTED, PLAIN)
    for ligature, spelled in LIGATURES:
        out = F.replace(out, F.lit(ligature), F.lit(spelled))
    return out


def fold_text(text: str) -> str:
    """`fold` of a Python literal."""
    out = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    for ligature, spelled in LIGATURES:
        out = out.replace(ligature, spelled)
    return out


def squash(c: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def rx_escape(text: str) -> str:
    """A literal inside a Java or RE2 pattern."""
    return re.sub(r"([\\.+*?()|\[\]{}^$#&~-])", r"\\\1", text)


def contains_any(c: Column, terms) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | c.contains(term)
    return hit


def word_pattern(words) -> str:
    """Any of the words, bounded by what is neither a letter nor a digit."""
    body = "|".join(rx_escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return rf"(^|[^a-z0-9])({body})([^a-z0-9]|$)"


def keyword_terms(kw: str, limit: int, length: int) -> list[tuple[str, str]]:
    """`(literal, pattern)` per term: a quoted phrase is one term, each matches at a word start.
    More than `limit` terms, or one over `length` characters, are refused: reading only part of
    them would match more rows than asked."""
    out = []
    for phrase, word in re.findall(r'"([^"]*)"|([^\s"]+)', kw.replace("“", '"').replace("”", '"')):
        if len(phrase or word) > length:
            raise ValueError(f"a keyword may have at most {length} characters")
        words = (phrase or word).lower().split()
        if words:
            start = "(^|[^a-z0-9])" if re.match(r"[a-z0-9]", words[0]) else ""
            out.append((words[0], "(?i)" + start + "[^a-z0-9]+".join(rx_escape(w) for w in words)))
    if len(out) > limit:
        raise ValueError(f"at most {limit} keywords may be asked for at once")
    return out


def key_prefixes(key: Column) -> Column:
    """Every proper prefix of a colon-joined key that ends before a colon: a:b:c -> [a, a:b]."""
    parts = F.split(key, ":")
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), ":")),
    ).otherwise(F.array().cast("array<string>"))


def drop_last_part(key: Column) -> Column:
    """The key without what follows its last colon."""
    return F.regexp_replace(key, r":[^:]*$", "")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]
