"""Years of experience a text asks for, elected among all the figures of years in it.

A text is cut once at its figures ("3-5 years", "five (5) yrs"). Every figure becomes a candidate that carries the words right
before and after it. Guards veto candidates that speak of something else: ages, a firm's history, lengths of contracts and
degrees, periods that lie back, benefits. What is left is sorted by what stands beside it: experience named outright, a
requirement without that word, a ceiling. The floor is elected from the firmest kind that a text has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from ..rules import derivations as R

_NUMBER = r"(?:\d{1,3}|" + "|".join(R.NUMBER_WORDS) + ")"
_UNIT = r"(?:years?|yrs?)\b['’]?"
# The letters a number word begins with: whatever else a text holds is passed over by one test.
_FIRST = "".join(sorted({w[0] for w in R.NUMBER_WORDS}))
#: A figure of years: floor, the digits repeated in brackets, a second figure, the unit.
FIGURE = (rf"(?i)(?=[\d{_FIRST}])(?<![\w.,/$€£#-])({_NUMBER})(?![\d.,]\d)(?:\s*\((\d{{1,3}})\))?\s*(?:\+|plus)?(?:\s*{_UNIT})?"
          rf"(?:\s*(?:-|to|or|and)\s*({_NUMBER})(?:\s*\(\d{{1,3}}\))?)?\s*(?:\+|plus|or more)?\s*-?\s*{_UNIT}")
_BEFORE, _AFTER = 80, 100


def _years(token: Column) -> Column:
    names = F.expr("map(" + ", ".join(f"'{w}', {n}" for w, n in R.NUMBER_WORDS.items()) + ")")
    return F.coalesce(F.try_element_at(names, F.lower(token)), token.try_cast("int"))


def candidates(text: Column) -> Column:
    """Array of `(at, lo, hi, before, after)`: every figure of years with the words around it, in order."""
    # A pattern passes over a text far faster than `translate`, which looks up every character.
    plain = F.regexp_replace(text, "[‑‒–—―−]", "-")

    def cut(parts: Column, figures: Column) -> Column:
        around = lambda i: F.when((i >= 0) & (i < F.size(figures)), F.get(figures, i)).otherwise("")
        part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        return F.transform(figures, lambda f, i: F.struct(
            i.alias("at"),
            _years(F.coalesce(F.nullif(F.regexp_extract(f, FIGURE, 2), F.lit("")), F.regexp_extract(f, FIGURE, 1))).alias("lo"),
            _years(F.regexp_extract(f, FIGURE, 3)).alias("hi"),
            F.right(F.concat(part(i - 1), around(i - 1), part(i)), F.lit(_BEFORE)).alias("before"),
            F.left(F.concat(part(i + 1), around(i + 1), part(i + 2)), F.lit(_AFTER)).alias("after"),
        ))

    both = lambda t: F.struct(F.split(t, FIGURE, -1).alias("p"), F.regexp_extract_all(t, F.lit(FIGURE), F.lit(0)).alias("f"))
    return let(let(plain, both), lambda s: cut(s["p"], s["f"]))


def judged(found: Column) -> Column:
    """The candidates no guard vetoes, as `(lo, hi, at, kind)`; kinds are `stated`, `implied`, `ceiling` and `soft_ceiling`."""
    beside = lambda c, rules: _any([c[side].rlike(rule) for side, rule in rules])
    plausible = lambda c: c["lo"].isNotNull() & (c["lo"] <= R.MAX_TEXT_YEARS) & (c["hi"].isNull() | (c["hi"] < 100))
    kept = F.filter(found, lambda c: plausible(c) & ~beside(c, R.YEARS_GUARDS))

    # Step by step, so that no rule is asked twice of a figure and none of figures that no step before it kept.
    def said(c: Column) -> Column:
        implied = beside(c, R.YEARS_IMPLIED) & ~beside(c, R.YEARS_PREFERRED)
        return F.struct(c.alias("c"), F.when(beside(c, R.YEARS_STATED), "stated").when(implied, "implied").alias("kind"))

    def above(s: Column) -> Column:
        before = s["c"]["before"]
        ceiling = F.when(before.rlike(R.YEARS_CEILING), "ceiling").when(s["c"]["hi"].isNull() & before.rlike(R.YEARS_SOFT_CEILING), "soft_ceiling")
        return F.struct(s["c"].alias("c"), s["kind"].alias("kind"), let(ceiling, lambda c: F.when(c.isNotNull() & ~before.rlike(R.YEARS_FLOOR_BEFORE), c)).alias("above"))

    def span(s: Column) -> Column:
        c, top = s["c"], s["above"].isNotNull()
        high = F.when(top, F.coalesce(c["hi"], c["lo"])).when((c["hi"] >= c["lo"]) & (c["hi"] <= R.MAX_FIELD_YEARS), c["hi"])
        return F.struct(F.when(top, 0).otherwise(c["lo"]).alias("lo"), high.alias("hi"), c["at"].alias("at"), F.coalesce(s["above"], s["kind"]).alias("kind"))

    asked = F.filter(F.transform(kept, said), lambda s: s["kind"].isNotNull())
    return F.transform(F.transform(asked, above), span)


def elected(spans: Column) -> Column:
    """The span with the smallest floor among the firmest kind: experience named (ceilings "up to" count as a floor of none),
    else a requirement without the word, else a softer ceiling."""
    tiers = (("stated", "ceiling"), ("implied",), ("soft_ceiling",))
    ranked = lambda kinds: F.array_min(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.struct(s["lo"], s["at"], s["hi"])))
    return F.coalesce(*[ranked(kinds) for kinds in tiers])


def floors(spans: Column) -> Column:
    """All floors of the firmest kind that a text states, sorted."""
    of = lambda kind: F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: s["kind"] == kind), lambda s: s["lo"])))
    return let(of("stated"), lambda stated: F.when(F.size(stated) > 0, stated).otherwise(of("implied")))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out
