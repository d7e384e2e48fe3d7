"""Statements on sponsorship and relocation, read clause by clause.

Each sentence that names a topic becomes a tape: its words in order, each with the classes it belongs to. A class is then a
list of places on the tape. A place is the word's number plus a large step for every clause that has ended before it, so a
negation, a hedge, a condition or an object that reaches so many words before and after itself, but never beyond its clause,
is a test whether some place of a class lies within an interval. Everything is SQL expressions over one row: a text is read
in one pass, without a join. The readings are put together as SQL text, which Spark parses once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import statements as R

_TOPIC = r"(?i)sponsor|reloca|citizen|authori[sz]ed to|right to work|eligible to work|work(?:ing)? (?:permit|authori[sz]ation)|\bvisas?\b|\bh-?1-?b\b"
_ALL = "SVZAKMNHhORYPIJUnXTDFpBWGC"
#: Classes that are also looked for in the whole sentence, by the words' numbers.
_FREE = "NOBHL"
_CLAUSE_STEP = 1_000_000


def _map(table: dict) -> str:
    return "map(" + ", ".join(f"'{k}', {v!r}" for k, v in table.items()) + ")"


def _by_letter(table: dict) -> str:
    """What a word stands for, looked up among those of its first letter: Spark searches a map from end to end."""
    letters = sorted({k[0] for k in table})
    nested = ", ".join(f"'{a}', {_map({k: v for k, v in table.items() if k[0] == a})}" for a in letters)
    return f"try_element_at(try_element_at(map({nested}), left(w, 1)), w)"


def tape_words(sentence: Column) -> Column:
    """The words of a sentence in lower case, phrases of one meaning as one word, ends of clauses as words of their own."""
    out = F.regexp_replace(F.lower(sentence), r"['’`]", "")
    for pattern, word in R.SPELLINGS:
        out = F.regexp_replace(out, pattern, word)
    out = F.regexp_replace(out, r"[;()\[\]–—]|\s-\s|\.{2,}", " | ")
    out = F.regexp_replace(out, r"([:?])", " $1 ")
    out = F.regexp_replace(out, r"[^a-z0-9|:?]+", " ")
    return F.filter(F.split(out, " "), lambda w: w != "")


def _field(name: str, free: bool = False) -> str:
    """Field names are told apart without regard to case."""
    return ("free_" if free else "") + ("low_" if name.islower() else "up_") + name


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _places() -> str:
    """Of `words` (one tape) the places of each class, and those of levels and countries with what they name."""
    tags = f"transform(words, w -> coalesce({_by_letter(R.CLASSES)}, ''))"
    ends = "filter(transform(tags, (c, i) -> CASE WHEN contains(c, 'E') THEN i END), i -> i IS NOT NULL)"
    place = f"(i + {_CLAUSE_STEP} * size(filter(ends, e -> e < i)))"
    # The words of some class with their places, which every class then picks from.
    marked = f"filter(transform(tags, (c, i) -> CASE WHEN c <> '' THEN named_struct('c', c, 'i', i, 'x', {place}) END), k -> k IS NOT NULL)"
    of = lambda name, value: f"transform(filter(marked, k -> contains(k.c, '{name}')), k -> {value})"
    topics = ", ".join(f"'at_{n}', {of(n, 'struct(k.i, k.x)')}" for n in "SAZM")
    fields = ", ".join([f"'{_field(n)}', {of(n, 'k.x')}" for n in _ALL] + [f"'{_field(n, True)}', {of(n, 'k.i')}" for n in _FREE])
    named = ", ".join(f"'{field}', filter(transform(words, (w, i) -> named_struct('x', {place}, 'says', try_element_at({_map(table)}, w))), s -> s.says IS NOT NULL)"
                      for field, table in (("levels", R.LEVELS), ("countries", R.COUNTRIES)))
    return _let(tags, "tags", _let(ends, "ends", _let(marked, "marked", f"named_struct({topics}, {fields}, {named})")))


def _near(names: str, reach: tuple[int, int]) -> str:
    """A word of some class within so many words before and after the mention, in its clause."""
    return "(" + " OR ".join(f"exists(t.{_field(n)}, p -> p BETWEEN m.x - {reach[0]} AND m.x + {reach[1]} AND p <> m.x)" for n in names) + ")"


def _anywhere(names: str) -> str:
    return "(" + " OR ".join(f"size(t.{_field(n)}) > 0" for n in names) + ")"


#: The mention is a label's last word, or all but the last.
_LABEL = f"exists(t.{_field('L', True)}, e -> e BETWEEN m.i + 1 AND m.i + 2)"


def _answered(names: str) -> str:
    """The answer to the label that the mention ends begins with a word of some class."""
    inside = " OR ".join(f"exists(t.{_field(n, True)}, p -> p BETWEEN e + 1 AND e + {R.REACH['answer']})" for n in names)
    return f"exists(t.{_field('L', True)}, e -> e BETWEEN m.i + 1 AND m.i + 2 AND ({inside}))"


def _scope() -> str:
    """`in`, `out`, `refused` or `unknown`: whether an offer covers the job that it is read for."""
    limits = (12, 12)
    beside = lambda field: f"transform(filter(t.{field}, s -> s.x BETWEEN m.x - {limits[0]} AND m.x + {limits[1]}), s -> s.says)"
    read = f"""CASE WHEN size(levels) > 0 AND _job.rank < array_min(levels) THEN 'refused'
        WHEN {_near('F', limits)} AND NOT _job.full_time OR size(named) > 0 AND size(_job.countries) > 0 AND NOT arrays_overlap(named, _job.countries)
            THEN CASE WHEN {_near('U', limits)} THEN 'refused' ELSE 'out' END
        WHEN size(named) > 0 AND size(_job.countries) = 0 THEN 'unknown' ELSE 'in' END"""
    return _let(beside("levels"), "levels", _let(beside("countries"), "named", read))


def _sponsor_verdict() -> str:
    """What one mention of sponsorship says: refuse, offer, may:<reason>, hedge, or nothing (null)."""
    reach = R.REACH
    visa = _near("V", reach["object"])
    back, ahead = reach["hedge"]
    facts = {
        "visa": visa, "label": _LABEL, "scope": _scope(),
        "aside": f"{_near('X', (3, 3))} AND NOT {visa} OR {_near('K', reach['near'])} AND NOT {_near('V', reach['near'])}",
        "hedged": f"exists(t.{_field('H', True)}, p -> p BETWEEN m.i - {back} AND m.i + {ahead})",
        # A label says nothing by itself; its answer does.
        "negated": f"CASE WHEN {_LABEL} THEN {_answered('N')} ELSE {_near('N', reach['negation'])} END",
        "offering": f"CASE WHEN {_LABEL} THEN {_answered('O')} ELSE {_near('O', reach['offer'])} OR array_contains(t.{_field('O')}, m.x) END",
        "said": f"{visa} OR {_near('p', reach['object'])} OR {_LABEL} AND {_answered('O')}",
        "asked": f"{_near('R', reach['near'])} AND NOT {_near('U', reach['near'])} AND NOT {_LABEL}",
        "weak": f"CASE WHEN {_near('h', reach['object'])} THEN 'may:hedged' WHEN {_near('T', reach['near'])} AND NOT {_near('D', reach['near'])} THEN 'may:transfer_only' END",
    }
    read = f"""CASE WHEN f.aside OR f.hedged AND {_near('J', reach['object'])} THEN NULL
        WHEN f.hedged AND (f.negated OR f.offering OR f.said AND {_near('H', reach['object'])}) THEN CASE f.scope WHEN 'refused' THEN 'refuse' WHEN 'out' THEN NULL ELSE 'may:hedged' END
        WHEN f.negated AND (f.visa OR f.label OR {_anywhere('VAp')} OR {_near('O', reach['offer'])}) THEN 'refuse'
        WHEN f.offering AND f.said AND NOT f.asked
            THEN CASE f.scope WHEN 'refused' THEN 'refuse' WHEN 'out' THEN NULL WHEN 'unknown' THEN 'may:scope_unread' ELSE coalesce(f.weak, CASE WHEN f.hedged THEN 'may:hedged' ELSE 'offer' END) END
        WHEN f.hedged AND f.visa THEN 'hedge' END"""
    return _let("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in facts.items()) + ")", "f", read)


def _permit_verdict() -> str:
    """A permit to work that one must hold already, or without help, refuses those who need one."""
    needed = R.REACH["required"]
    return f"""CASE WHEN ({_near('N', (3, 10))} AND {_near('S', (2, 12))} OR {_near('R', needed)} AND {_near('Y', needed)})
        AND NOT {_anywhere('P')} AND NOT {_near('n', needed)} THEN 'refuse' END"""


def _citizen_verdict() -> str:
    """Citizenship that the job requires refuses everyone else; as a protected trait or for some jobs it does not."""
    needed, close = R.REACH["required"], R.REACH["near"]
    return f"CASE WHEN {_near('R', needed)} AND NOT ({_anywhere('PI')} OR {_near('nN', needed)} OR {_near('h', close)} OR {_near('SO', close)}) THEN 'refuse' END"


def _move_verdict() -> str:
    """What one mention of moving says: move, nomove or nothing."""
    helped = f"CASE WHEN {_LABEL} THEN {_answered('OB')} ELSE {_near('B', (5, 5))} END"
    refused = f"CASE WHEN {_LABEL} THEN {_answered('N')} ELSE ({_near('N', (6, 5))} OR {_near('C', (6, 8))}) AND {_near('B', (5, 5))} END"
    return f"CASE WHEN {refused} THEN 'nomove' WHEN {_near('G', (2, 4))} OR {_near('W', (4, 0))} AND NOT {_near('B', (0, 5))} THEN NULL WHEN {helped} THEN 'move' END"


def _said() -> str:
    """All that the tapes in `_places` say."""
    readings = {"S": _sponsor_verdict(), "A": _permit_verdict(), "Z": _citizen_verdict(), "M": _move_verdict()}
    of_tape = ", ".join(f"transform(t.at_{name}, m -> {verdict})" for name, verdict in readings.items())
    return f"coalesce(array_distinct(flatten(transform(_places, t -> array_compact(concat({of_tape}))))), array())"


def annotate_stances(df: DataFrame) -> DataFrame:
    """`stances`, a sorted list of `offers_sponsorship`, `may_offer_sponsorship`, `refuses_sponsorship` and
    `offers_relocation`, and `may_offer_because`, why an offer is not a firm one.

    A refusal outweighs every offer. A hedge anywhere in the sentence, or in another sentence about visas, holds an offer
    back. An offer to full-time staff, to a level or in a country counts only for a job inside that scope (`title`,
    `employment_type`, and `countries` where the table has it); outside it says nothing, or refuses where it says "only"; a
    country that can't be compared makes it a may-offer. Sponsors of projects, events and clearances are no visa's. A null or
    empty text has no stances.
    """
    from .annotate import employment_flags, employment_rule, sentences

    title, none = F.coalesce("title", F.lit("")), F.expr("CAST(array() AS array<string>)")
    full_time = F.coalesce(employment_flags(F.col("employment_type"), F.col("title"))["is_full_time"], F.lit(True)) & ~F.coalesce(employment_rule("internship", F.col("employment_type"), F.col("title")), F.lit(False))
    rank = F.expr(f"coalesce(array_max(transform(_title, w -> try_element_at({_map(R.LEVELS)}, w))), {R.PLAIN_RANK})")
    # An abbreviation's points end no sentence, and a question's short answer belongs to it.
    text = F.regexp_replace(F.regexp_replace(F.col("description"), r"(?i)\bu\.\s?s\.(?:\s?a\.)?(?=\W)", "US"), r"(?i)\?\s+(?=(?:yes|no|not|none)\b)", " : ")
    topical = F.filter(sentences(text), lambda s: s.rlike(_TOPIC))
    # Each step is a column of its own, so that none is computed twice.
    out = df.withColumns({"_title": tape_words(title), "_tapes": F.transform(F.when(F.col("description").rlike(_TOPIC), topical), tape_words)})
    countries = F.coalesce(F.col("countries"), none) if "countries" in df.columns else none
    out = out.withColumns({"_job": F.struct(full_time.alias("full_time"), rank.alias("rank"), countries.alias("countries")), "_places": F.expr(f"transform(_tapes, words -> {_places()})")})
    out = out.withColumn("_said", F.expr(_said()))
    says = lambda verdict: F.array_contains("_said", verdict)
    held_back = says("may:hedged") | says("hedge")
    reasons = F.array_compact(F.array(*[F.when(says(f"may:{r}") | ((F.lit(r) == "hedged") & says("offer") & held_back), r) for r in R.MAY_OFFER_REASONS]))
    may = says("offer") & held_back | says("may:hedged") | says("may:transfer_only") | says("may:scope_unread")
    sponsorship = F.when(says("refuse"), "refuses_sponsorship").when(says("offer") & ~held_back, "offers_sponsorship").when(may, "may_offer_sponsorship")
    stances = F.array_sort(F.array_compact(F.array(sponsorship, F.when(says("move") & ~says("nomove"), "offers_relocation"))))
    out = out.withColumns({"stances": stances, "may_offer_because": F.when(sponsorship == "may_offer_sponsorship", reasons).otherwise(none)})
    return out.drop("_title", "_job", "_tapes", "_places", "_said")
