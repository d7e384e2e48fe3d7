"""Derived columns: table in, table out, native column expressions over rule data.

Work that depends on a value held by many rows (a location, a title) is done once per distinct
value and joined back. The gazetteer is rule data of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordinal import top_per_group
from ..functions.text import let, rx_escape, squash
from ..rules import derivations as R
from ..rules.places import COUNTRIES, INDIA_PLACES, INDIA_STATES
from ..session import cut_lineage
from .experience import candidates, elected, floors, judged
from .filters import employment_flags, employment_rule

# --- countries and places --------------------------------------------------------------------


def gazetteer(spark: SparkSession, countries: Mapping[str, Mapping] = COUNTRIES) -> DataFrame:
    """`(term, kind, code)` rows: word, segment, shared_word, shared_segment, city_word, name."""
    rows = []
    for code, c in countries.items():
        rows.append((c["name"].lower(), "name", code))
        for kind in ("word", "segment", "shared_word", "shared_segment", "city_word"):
            rows += [(term, kind, code) for term in c.get(kind + "s", ())]
    return spark.createDataFrame(rows, "term string, kind string, code string")


def _word_terms(text: Column, longest: int) -> Column:
    """Every run of 1..longest whole words of the text, joined by one blank."""
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}.]+", " "), " "), lambda w: w != "")
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[grams(n) for n in range(1, longest + 1)])))


def _segment_terms(text: Column) -> Column:
    """The whole parts of the text between separators."""
    parts = F.split(text, r"[,;|/():]|\s[-–]\s?|[-–]\s")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def annotate_country(df: DataFrame, countries: DataFrame | None = None, column: str = "location") -> DataFrame:
    """`countries`: sorted ISO codes the location names.

    A sure term names its country whatever else is said. A city word counts unless another country
    is stated by name or code. A shared segment, or a shared word beside no other country's shared
    segment, counts only where no other country is named for sure.
    Terms may have any number of words.
    """
    terms = countries if countries is not None else gazetteer(df.sparkSession)
    longest = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    places = df.select(F.col(column).alias("_place")).where(F.col("_place").isNotNull()).distinct()
    text = F.lower("_place")
    as_word = lambda terms, word: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(word).alias("as_word")))
    # Both readings of a place in one list: the table is read once for them.
    read = places.select("_place", F.inline(F.concat(as_word(_word_terms(text, longest), True), as_word(_segment_terms(text), False))))
    wordy = F.col("kind").isin("word", "shared_word", "city_word", "name")
    hits = read.join(terms, "term").filter(wordy == F.col("as_word"))

    def codes(*kinds):
        return F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("code")))

    found = hits.groupBy("_place").agg(
        codes("word", "segment").alias("sure"),
        codes("city_word").alias("city"),
        codes("shared_segment").alias("shared_seg"),
        codes("shared_word").alias("shared_word"),
        codes("name", "segment", "shared_segment").alias("stated"),
        F.collect_set(F.when(F.col("kind") == "shared_word", F.struct("term", "code"))).alias("bearers"),
    )

    def others(array: str, code: Column) -> Column:
        return F.exists(F.col(array), lambda x: x != code)

    city = F.filter("city", lambda c: ~others("stated", c))
    # Of the countries that bear a word, one named otherwise takes it from the rest ("Tbilisi, Georgia").
    taken = lambda c: F.exists("bearers", lambda b: (b["code"] == c) & F.exists("bearers", lambda o: (o["term"] == b["term"]) & (o["code"] != c) & F.array_contains(F.array_union("sure", city), o["code"])))
    shared_word = F.filter("shared_word", lambda c: ~others("shared_seg", c) & ~taken(c))
    shared = F.filter(F.array_union("shared_seg", shared_word), lambda c: ~others("sure", c))
    named = found.select("_place", F.array_sort(F.array_union(F.array_union("sure", city), shared)).alias("countries"))
    empty = F.array().cast("array<string>")
    return _join_back(df, column, named).withColumn("countries", F.coalesce("countries", empty))


def _join_back(df: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """`df` with what `found` (one row a `_place`) says of its column's value. Rows without a value
    match nothing and are dealt out evenly instead of meeting in one task. What was found is written
    once, so that its size is known: few values are broadcast and the rows need no shuffle by them."""
    found = cut_lineage(found)
    spread = F.concat(F.lit("\x1f"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
    keyed = df.withColumn("_key", F.coalesce(F.col(column), spread))
    return keyed.join(found, F.col("_key") == F.col("_place"), "left").drop("_place", "_key")


def annotate_region(df: DataFrame, places: Mapping[str, Mapping] = INDIA_PLACES, states: Sequence[str] = INDIA_STATES,
                    column: str = "location") -> DataFrame:
    """`places`: the region's cities and states a location names; a guarded city is not read
    beside its guard words. Evaluated once per distinct location, as a join of its word runs with
    the region's terms, whatever their number."""
    rows = [(term, "name", name, rule["state"]) for name, rule in places.items() for term in rule["aliases"]]
    rows += [(term, "guard", name, None) for name, rule in places.items() for term in rule.get("unless", ())]
    rows += [(state, "state", state, None) for state in states]
    longest = max(len(_plain_words(term)) for term, *_ in rows)
    terms = df.sparkSession.createDataFrame([(" ".join(_plain_words(term)), *rest) for term, *rest in rows], "term string, kind string, name string, state string")
    distinct = df.select(F.col(column).alias("_place")).where(F.col("_place").isNotNull()).distinct()
    words = F.filter(F.split(F.lower("_place"), "[^a-z0-9]+"), lambda w: w != "")
    runs = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(w, lambda _, i: F.array_join(F.slice(w, i + 1, n), " "))))
    hits = distinct.select("_place", F.explode(F.array_distinct(let(words, runs))).alias("term")).join(terms, "term")
    of = lambda kind, value: F.collect_set(F.when(F.col("kind") == kind, value))
    found = hits.groupBy("_place").agg(of("name", F.struct("name", "state")).alias("cities"), of("guard", F.col("name")).alias("guarded"), of("state", F.col("name")).alias("states"))
    open_cities = F.filter("cities", lambda c: ~F.array_contains("guarded", c["name"]))
    named = F.concat(F.transform(open_cities, lambda c: c["name"]), F.transform(open_cities, lambda c: c["state"]), F.col("states"))
    read = found.select("_place", F.array_sort(F.array_distinct(named)).alias("places"))
    return _join_back(df, column, read).withColumn("places", F.coalesce("places", F.array().cast("array<string>")))


def _plain_words(term: str) -> list[str]:
    return re.findall("[a-z0-9]+", term.lower())


# --- employment type, band, remote -----------------------------------------------------------


def annotate_employment(df: DataFrame) -> DataFrame:
    """Four booleans from the raw type and the title; nothing readable counts as full-time."""
    return df.withColumns(employment_flags(F.col("employment_type"), F.col("title")))


def band(min_years: Column, title: Column, employment_type: Column) -> Column:
    intern = r"(?i)\bintern(?:ship)?s?\b"
    is_intern = F.coalesce(title.rlike(intern), F.lit(False)) | F.coalesce(employment_type.rlike(intern), F.lit(False))
    return (
        F.when(is_intern, "intern").when(min_years.isNull(), "unspecified").when(min_years <= 1, "entry")
        .when(min_years <= 4, "mid").when(min_years <= 7, "senior").otherwise("staff")
    )


def annotate_band(df: DataFrame) -> DataFrame:
    return df.withColumn("band", band(F.col("min_years"), F.col("title"), F.col("employment_type")))


def remote_signal(text: Column) -> Column:
    """"remote", "hybrid", "onsite" or null: a tag first, then the phrases of each verdict in turn."""
    low = F.lower(text)
    first = lambda verdicts: F.coalesce(*[F.when(hit, F.lit(v)) for hit, v in verdicts])
    tagged = let(low, lambda t: first([(t.contains(tag), v) for tag, v in R.REMOTE_TAGS.items()]))
    return F.coalesce(tagged, let(F.regexp_replace(text, R.REMOTE_THINGS, " "), lambda plain: first([(plain.rlike(said), v) for v, said in R.REMOTE_PHRASES])))


def annotate_remote(df: DataFrame) -> DataFrame:
    """The field, unless the text confidently says remote."""
    return df.withColumn("remote", F.when(remote_signal(F.col("description")) == "remote", F.lit(True)).otherwise(F.col("remote")))


# --- experience ------------------------------------------------------------------------------


def experience_columns(field: Column, description: Column, title: Column,
                       company: Column | None = None) -> tuple[dict[str, Column], ...]:
    """Steps of columns: the figures of years in the text, those that count, the cascade's answer and every floor."""
    lo = F.regexp_extract(field, R.EXPERIENCE_FIRST, 1).try_cast("int")
    hi = F.regexp_extract(field, R.EXPERIENCE_SECOND, 1).try_cast("int")
    hi_months = field.rlike(R.EXPERIENCE_SECOND_MONTHS)
    months = hi_months | field.rlike(R.EXPERIENCE_MONTHS)
    f_lo = F.when(months, F.floor(lo / 12).cast("int")).otherwise(lo)
    f_hi = F.when(hi_months, F.ceil(hi / 12).cast("int")).otherwise(hi)
    from_field = let(F.struct(f_lo.alias("lo"), f_hi.alias("hi")), lambda f: F.when(f["lo"] <= R.MAX_FIELD_YEARS, F.struct(
        f["lo"].alias("lo"), F.when((f["hi"] >= f["lo"]) & (f["hi"] <= R.MAX_FIELD_YEARS), f["hi"]).alias("hi"), F.lit("field").alias("source")
    )))
    # A text that names no years is not scanned.
    found = F.when(description.rlike(R.YEARS_HINT), candidates(description))
    spans = F.coalesce(judged(F.col("_years_found")), F.array().cast("array<struct<lo:int,hi:int,at:int,kind:string>>"))
    from_text = let(elected(F.col("_spans")), lambda s: F.when(s["lo"].isNotNull(), F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), F.lit("regex").alias("source"))))
    label = F.concat_ws(" ", field, title)
    word = F.lit(None).cast("int")
    for pattern, years in reversed(R.SENIORITY):
        word = F.when(label.rlike(pattern), F.lit(years)).otherwise(word)
    level_map = F.create_map(*[x for k, v in R.LEVEL_YEARS.items() for x in (F.lit(k), F.lit(v))])
    level = F.try_element_at(level_map, F.lower(F.regexp_extract(title, R.LEVEL, 1)))
    ladder = F.lit(None).cast("int")
    if company is not None:
        mark = F.concat(F.regexp_extract(title, R.LADDER_LEVEL, 1), F.regexp_extract(title, R.LADDER_LEVEL, 2))
        for name, steps in R.COMPANY_LADDERS.items():
            for step, years in steps.items():
                ladder = F.when((F.lower(F.trim(company)) == name) & (mark == step), F.lit(years)).otherwise(ladder)
    estimate = F.coalesce(ladder, word, level)
    from_word = let(estimate, lambda e: F.when(e.isNotNull(), F.struct(e.alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit("seniority").alias("source"))))
    answer = F.coalesce(from_field, from_text, from_word)
    return {"_years_found": found}, {"_spans": spans}, {"_experience": answer, "stated_floors": floors(F.col("_spans"))}


def annotate_experience(df: DataFrame, field: str = "experience") -> DataFrame:
    """min_years, max_years, experience_source and stated_floors."""
    company = F.col("company") if "company" in df.columns else None
    field_col = F.col(field) if field in df.columns else F.lit(None).cast("string")
    text, spans, answer = experience_columns(field_col, F.col("description"), F.col("title"), company)
    return df.withColumns(text).withColumns(spans).withColumns(answer).withColumns({
        "min_years": F.col("_experience.lo"), "max_years": F.col("_experience.hi"), "experience_source": F.col("_experience.source"),
    }).drop("_experience", "_spans", "_years_found")


# --- pay -------------------------------------------------------------------------------------


def amount(text: Column) -> Column:
    """A written number in US or European grouping: two or fewer trailing digits are cents."""

    def read(t: Column) -> Column:
        eu = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        us = F.replace(t, F.lit(","), F.lit(""))
        comma, dot = t.contains(","), t.contains(".")
        comma_last = F.locate(",", F.reverse(t)) < F.locate(".", F.reverse(t))
        return (
            F.when(comma & dot & comma_last, eu).when(comma & dot, us).when(comma & t.rlike(r",\d{1,2}$"), eu).when(comma, us)
            .when(t.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
        ).try_cast("double")

    return let(text, read)


def _scale(unit: Column) -> Column:
    u = F.lower(F.coalesce(unit, F.lit("")))
    return F.when(u == "k", 1000).when(u.rlike("^(lakhs?|lacs?|l)$"), 100_000).otherwise(1)


def _period(text: Column) -> Column:
    out = None
    for pattern, factor in R.PERIODS:
        out = F.when(text.rlike(pattern), factor) if out is None else out.when(text.rlike(pattern), factor)
    return out.otherwise(1)


def _currency(*marks: Column) -> Column:
    symbols = F.create_map(*[x for s, c in R.SYMBOL_CURRENCY.items() for x in (F.lit(s), F.lit(c))])
    read = []
    for mark in marks:
        m = F.upper(F.trim(mark))
        read.append(F.when(m.isin(*R.CURRENCY_CODES), m).otherwise(F.try_element_at(symbols, m)))
    return F.coalesce(*read)


def _bound(table: Mapping[str, int], currency: Column) -> Column:
    """A currency's bound; none named is read as dollars, one without a bound has null."""
    rows = F.create_map(*[x for c, v in table.items() for x in (F.lit(c), F.lit(v))])
    return F.try_element_at(rows, F.coalesce(currency, F.lit("USD")))


def _span(low: Column, low_unit: Column, high: Column, high_unit: Column, currency: Column, factor: Column) -> Column:
    """`(lo, hi, currency)` a year, null outside the currency's plausible bounds. Each step names
    what the last one computed, so nothing is parsed twice."""
    stated_high = F.coalesce(high, F.lit("")) != ""
    parsed = F.struct(
        amount(low).alias("a"), F.when(stated_high, amount(high)).alias("b"), F.nullif(F.coalesce(low_unit, F.lit("")), F.lit("")).alias("au"),
        _scale(high_unit).alias("bu"), currency.alias("currency"), factor.cast("double").alias("factor"),
    )

    def yearly(p: Column) -> Column:
        shared_unit = F.when(p["b"].isNotNull() & (p["bu"] > 1), p["bu"]).otherwise(1)
        scale = F.when(p["au"].isNotNull(), _scale(p["au"])).otherwise(shared_unit)
        a, b = F.round(p["a"] * scale) * p["factor"], F.round(p["b"] * p["bu"]) * p["factor"]
        return F.struct(F.least(a, b).alias("lo"), F.when(b.isNotNull(), F.greatest(a, b)).alias("hi"), p["currency"].alias("currency"))

    def bounded(s: Column) -> Column:
        floor, ceiling = _bound(R.MIN_ANNUAL, s["currency"]), _bound(R.MAX_ANNUAL, s["currency"])
        fits = s["lo"].between(floor, ceiling) & (s["hi"].isNull() | s["hi"].between(floor, ceiling))
        return F.when(fits, F.struct(s["lo"].cast("long").alias("lo"), s["hi"].cast("long").alias("hi"), s["currency"].alias("currency")))

    return let(let(parsed, yearly), bounded)


def salary_from_field(value: Column, source: Column | None = None) -> Column:
    """What a field states. A source that quotes by the month without saying so has figures too small
    for a year read as monthly."""
    part = lambda n: F.regexp_extract(value, R.SALARY_FIELD, n)
    code = F.regexp_extract(value, r"(?i)\b(" + "|".join(R.CURRENCY_CODES) + r")\b", 1)
    symbol = F.regexp_extract(value, r"((?:CA|C|HK|SG|S|AU|A|NZ|US)\$|[£€₹])", 1)
    read = lambda factor: _span(part(1), part(2), part(4), part(5), _currency(code, symbol), factor)
    currency = _currency(code, symbol)
    silent = ~value.rlike(r"(?i)year|annum|annual|\bpa\b|" + "|".join(p.removeprefix("(?i)") for p, _ in R.PERIODS))
    # Rupees in thousands without a period are monthly where they are pay at all.
    thousands = F.coalesce(currency == "INR", F.lit(False)) & silent & value.rlike(r"(?i)\dk\b")
    span = F.when(~thousands, read(_period(value)))
    if source is not None:
        figures_only = F.regexp_replace(value, r"(?i)\b(?:to|[a-z]{3})\b|\dk\b", "").rlike(r"^[^a-zA-Z]*$")
        monthly = F.coalesce(source.isin(*R.MONTHLY_SOURCES), F.lit(False)) & silent & figures_only & currency.isin(*R.MONTHLY_CURRENCIES)
        by_month = F.when(monthly, read(F.lit(12)))
        small = F.coalesce(by_month["hi"], by_month["lo"]) <= 12 * R.THOUSANDS_INR_MONTHLY
        span = F.coalesce(span, F.when(~thousands | small, by_month))
    return F.when(value.rlike(r"\d"), span)


def salary_from_text(description: Column) -> Column:
    """The first pattern, in confidence order, whose plausible figures agree; if they disagree the
    text gives none. A text without a figure of two digits or more is not scanned."""
    text = F.when(description.rlike(r"\d\d|\d\s*[kK]\b|(?i)lpa|lakh"), F.regexp_replace(description, R.NOT_PAY, " "))

    def lakhs(m: Column) -> Column:
        return _span(m["g2"], F.lit("lakh"), m["g5"], F.lit("lakh"), F.lit("INR"), F.lit(1))

    def money_span(m: Column) -> Column:
        return _span(m["g2"], m["g3"], m["g5"], m["g6"], _currency(m["g1"], m["g4"], m["g7"]), _period(m["g8"]))

    def resolve(spans: Column) -> Column:
        lows = F.transform(spans, lambda s: s["lo"])
        money = F.array_distinct(F.array_compact(F.transform(spans, lambda s: s["currency"])))
        agree = (F.size(money) <= 1) & (F.array_max(lows) - F.array_min(lows) <= F.greatest(F.lit(1000.0), F.array_min(lows) * 0.05))
        # The most telling mention stands: with a currency, with a top, then the first.
        best = F.array_max(F.transform(spans, lambda s, i: F.struct(
            s["currency"].isNotNull().alias("a"), s["hi"].isNotNull().alias("b"), (-i).alias("c"), s.alias("span")
        )))["span"]
        return F.when(F.size(spans) > 0, F.struct(best.alias("span"), agree.alias("ok")))

    def tier(t: Column, name: str, pattern: str) -> Column:
        # The text is scanned once; the parts are read off the short matches.
        parts = lambda m: F.struct(*[F.regexp_extract(m, pattern, n).alias(f"g{n}") for n in range(1, 9)])
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), parts)
        return let(F.array_compact(F.transform(found, lakhs if name == "lpa" else money_span)), resolve)

    def scan(t: Column) -> Column:
        tiers = {name: tier(t, name, pattern) for name, pattern in R.SALARY_TEXT}
        # In confidence order the marked tiers come last; a text without a currency is not scanned for them.
        marked = F.when(t.rlike(R.CURRENCY_MARK), F.coalesce(*[tiers.pop(name) for name in R.MARKED_TIERS]))
        return F.coalesce(*tiers.values(), marked)

    found = F.when(text.isNotNull(), let(text, scan))
    return let(found, lambda f: F.when(f["ok"], f["span"]))


def annotate_salary(df: DataFrame, field: str = "salary") -> DataFrame:
    """min/max yearly pay, currency and source; `countries` (when present) drops a rupee figure too
    small to be pay where the posting is."""
    df = df.withColumn("_field", salary_from_field(F.col(field), F.col("ats") if "ats" in df.columns else None) if field in df.columns else F.lit(None).cast("struct<lo:bigint,hi:bigint,currency:string>"))
    df = df.withColumn("_text", F.when(F.col("_field").isNull(), salary_from_text(F.col("description"))))
    span = F.coalesce("_field", "_text")
    if "countries" in df.columns:
        abroad = (F.size("countries") > 0) & ~F.array_contains("countries", "IN")
        tiny = (span["currency"] == "INR") & abroad & (F.coalesce(span["hi"], span["lo"]) < R.ABROAD_INR_BELOW)
        span = F.when(~F.coalesce(tiny, F.lit(False)), span)
    return df.withColumn("_span", span).withColumns({
        "min_salary_annual": F.col("_span.lo").cast("int"), "max_salary_annual": F.col("_span.hi").cast("int"),
        "salary_currency": F.col("_span.currency"),
        "salary_source": F.when(F.col("_span").isNotNull(), F.when(F.col("_field").isNotNull(), "field").otherwise("regex")),
    }).drop("_field", "_text", "_span")


def annotate_all(df: DataFrame) -> DataFrame:
    """Remote, countries, experience and pay at once."""
    return annotate_salary(annotate_experience(annotate_country(annotate_remote(df))))


# --- domain, families, watched roles ---------------------------------------------------------


def classify_domain(df: DataFrame, rules: Mapping[str, str] = R.DOMAIN_RULES) -> DataFrame:
    """`is_tech` and `reason` from title and department; the title decides before the department."""
    raw = F.trim(F.replace(F.coalesce("title", F.lit("")), F.lit("_"), F.lit(" ")))
    dept = F.trim(F.coalesce("department", F.lit("")))
    signal = F.regexp_replace(raw, rules["not_signal"], " ")
    hit = lambda c, name: c.rlike(rules[name])
    veto = hit(signal, "other_field") | hit(signal, "trade") | (hit(dept, "other_field") & ~hit(signal, "code_work"))
    by_department = (
        hit(dept, "department") & ~hit(dept, "not_department") & ~hit(dept, "other_field")
        & ~hit(raw, "other_role") & ~hit(raw, "other_field")
    )
    reason = (
        F.when(hit(signal, "strong"), "strong-software-signal")
        .when(hit(signal, "generic") & veto, "generic-token-but-non-software")
        .when(hit(signal, "generic"), "generic-tech-token")
        .when((signal != raw) & hit(signal, "code_work"), "software-work-beside-a-trade")
        .when(by_department, "tech-department")
        .otherwise("no-tech-signal")
    )
    return df.withColumn("reason", reason).withColumn(
        "is_tech", ~F.col("reason").isin("generic-token-but-non-software", "no-tech-signal")
    )


def classify_title_rules(df: DataFrame, cues: Sequence[tuple] = R.TITLE_CUES, negative: str = R.NEGATIVE_TITLES) -> DataFrame:
    """`family`, `tier`, `cue`: the matching cue of lowest rank, then earliest position. A negative
    word without a strong cue puts the title outside the domain. Each distinct title is read once."""
    titles = df.select("title").where(F.col("title").isNotNull()).distinct()
    matches = F.array_compact(F.array(*[
        F.when(F.col("title").rlike(pattern), F.struct(
            F.lit(rank).alias("rank"), F.regexp_instr(F.col("title"), F.lit(pattern)).alias("at"), F.lit(i).alias("cue_order"),
            F.lit(family).alias("family"), F.lit(name).alias("cue"), F.lit(strong).alias("strong"),
        ))
        for i, (family, name, pattern, rank, strong) in enumerate(cues)
    ]))
    read = titles.withColumn("_m", matches)
    best = F.array_min("_m")
    families = F.size(F.array_distinct(F.transform("_m", lambda m: m["family"])))
    negated = F.col("title").rlike(negative) & ~F.exists("_m", lambda m: m["strong"])
    none = F.size("_m") == 0
    read = read.select(
        "title",
        F.when(negated, R.NON_TECH).when(none, F.lit(None)).otherwise(best["family"]).alias("family"),
        F.when(negated, "negative").when(none, F.lit(None)).when(best["rank"] == R.GENERIC_RANK, "generic-software")
        .when(families == 1, "sole-cue").otherwise("precedence").alias("tier"),
        F.when(negated, F.lit(None)).when(none, F.lit(None)).otherwise(best["cue"]).alias("cue"),
    )
    return df.join(read, "title", "left")


def watch_roles(df: DataFrame, watchlist: Sequence[tuple] = R.WATCHLIST) -> DataFrame:
    """One row per posting and watched role its title matches."""
    roles = F.array_compact(F.array(*[
        F.when(reduce(lambda a, b: a | b, [F.col("title").rlike(p) for p in patterns]), F.struct(
            F.lit("watch:" + name).alias("role"), F.lit(parent).alias("parent")
        ))
        for name, parent, patterns in watchlist
    ]))
    return df.withColumn("_roles", roles).select("*", F.inline("_roles")).drop("_roles")


# --- the trained family head -----------------------------------------------------------------


def capped_per_class(df: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """At most `cap` labelled rows per class, chosen by a seeded hash."""
    return top_per_group(df, ["label"], [F.xxhash64(F.lit(seed), F.col("id")), F.col("id")], cap, "_n").drop("_n")


def train_family_head(df: DataFrame, regs: Sequence[float] = (0.001, 0.01, 0.1), folds: int = 5, cap: int = 2000,
                      coverage: float = 0.9, group: str = "copy_key", seed: int = 0) -> tuple[object, DataFrame, float]:
    """A weighted multinomial logistic regression over `vector` predicting `label`.

    Copies of a posting share `group`, so folds split by its hash and never straddle one. Returns
    the model, a row per candidate weight with its cross-validated accuracy, and the cutoff that
    leaves `coverage` of held-out rows classified.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = df.sparkSession
    rows = capped_per_class(df, cap, seed)
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))  # one row per class
    total = counts.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    weights = counts.join(F.broadcast(total), F.lit(True), "inner").select(
        "label", (F.col("_total") / (F.col("_classes") * F.col("_n"))).alias("weight")
    )
    ready = rows.join(weights, "label").select(
        F.col("label").cast("double").alias("label"), "weight", array_to_vector(F.col("vector").cast("array<double>")).alias("features"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(folds)).alias("fold"),
    ).persist()
    try:
        scores, held = [], {}
        for reg in regs:
            parts = []
            for fold in range(folds):
                model = LogisticRegression(weightCol="weight", regParam=reg, maxIter=50, family="multinomial").fit(ready.filter(F.col("fold") != fold))
                parts.append(model.transform(ready.filter(F.col("fold") == fold)).select(
                    "label", "prediction", F.array_max(vector_to_array("probability")).alias("p")
                ))
            held[reg] = reduce(DataFrame.unionByName, parts)
            right = held[reg].agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")).first()["accuracy"]
            scores.append((float(reg), float(right or 0.0)))
        best = max(scores, key=lambda s: (s[1], -s[0]))[0]
        cutoff = held[best].agg(F.percentile_approx("p", 1.0 - coverage, 10000)).first()[0]
        final = LogisticRegression(weightCol="weight", regParam=best, maxIter=100, family="multinomial").fit(ready)
    finally:
        ready.unpersist()
    return final, spark.createDataFrame(scores, "reg double, accuracy double"), float(cutoff or 0.0)


def head_weights(model) -> tuple[list[list[float]], list[float]]:
    """The model's rows of weights and its biases, small enough to inline as literals."""
    return [list(map(float, row)) for row in model.coefficientMatrix.toArray()], [float(b) for b in model.interceptVector.toArray()]


def score_family(df: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], labels: Sequence[str], cutoff: float,
                 vector: str = "vector") -> DataFrame:
    """`family` and `probability`: softmax of the dot products, below the cutoff unclassified."""
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    v = F.col(vector)
    dots = F.transform(rows, lambda w: F.aggregate(F.zip_with(v, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x))
    logits = F.zip_with(dots, F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: a + b)
    scored = df.withColumn("_logits", logits).withColumn("_top", F.array_max("_logits"))
    exps = F.transform("_logits", lambda z: F.exp(z - F.col("_top")))
    probability = F.lit(1.0) / F.aggregate(exps, F.lit(0.0), lambda s, x: s + x)
    position = F.array_position("_logits", F.col("_top"))
    names = F.array(*[F.lit(str(x)) for x in labels])
    return scored.withColumn("probability", probability).withColumn(
        "family", F.when(F.col("probability") >= cutoff, F.element_at(names, position.cast("int"))).otherwise(F.lit("unclassified"))
    ).drop("_logits", "_top")


def stamp_confident(df: DataFrame, scored: DataFrame, probability: float = 0.9, max_share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """The table with `is_confident_non_tech` true exactly on confidently out-of-domain ids, and
    one row saying how many are stamped, newly stamped and unstamped. A share above `max_share`
    is refused."""
    wanted = scored.filter((F.col("family") == R.NON_TECH) & (F.col("probability") >= probability)).select("id").distinct().withColumn("_on", F.lit(True))
    joined = df.withColumnRenamed("is_confident_non_tech", "_was") if "is_confident_non_tech" in df.columns else df.withColumn("_was", F.lit(False))
    joined = joined.join(wanted, "id", "left").withColumn("is_confident_non_tech", F.coalesce("_on", F.lit(False)))
    was = F.coalesce("_was", F.lit(False))
    report = joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("is_confident_non_tech")).alias("stamped"),
        F.count_if(F.col("is_confident_non_tech") & ~was).alias("newly_stamped"), F.count_if(~F.col("is_confident_non_tech") & was).alias("unstamped"),
    )
    seen = report.first()
    if seen["rows"] and seen["stamped"] / seen["rows"] > max_share:
        raise ValueError(f"{seen['stamped']} of {seen['rows']} rows would be hidden, above {max_share:.0%}")
    return joined.drop("_on", "_was"), report


# --- statements in the text ------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """The text cut at sentence ends, blank pieces dropped."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+|\n+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: squash(s)), lambda s: s != "")


def mention_sentences(df: DataFrame, width: int = R.MENTION_CHARS) -> DataFrame:
    """One row per topic sentence, cut to `width` characters around its first topic word."""
    rows = df.select("id", F.posexplode(sentences(F.col("description"))).alias("at", "sentence"))
    rows = rows.filter(F.col("sentence").rlike(R.MENTION) & ~F.col("sentence").rlike(R.EQUAL_OPPORTUNITY))
    start = F.greatest(F.regexp_instr("sentence", F.lit(R.MENTION)) - 80, F.lit(1))
    cut = F.length("sentence") > width
    return rows.withColumn("mention", F.when(cut, F.substring("sentence", start, F.lit(width))).otherwise(F.col("sentence"))).drop("sentence")


def stated_end_date(df: DataFrame) -> DataFrame:
    """`end_day` and `end_said`: the latest closing day the text states, with its words.

    A closing phrase is read with what stands behind it up to a day: day, month and year in figures
    or with the month's name. Figures that could be two days are left out.
    """
    text = squash(F.col("description"))
    filler = r"(?:[\s:–,.-]*\b(?:" + "|".join(R.CLOSING_FILLERS) + r")\b)*[\s:–,.-]*"
    day = r"((?:\d{1,4}(?:st|nd|rd|th)?|[a-z]{3,9})(?:[\s,./-]+(?:of )?(?:\d{1,4}(?:st|nd|rd|th)?|[a-z]{3,9})\b\.?){2})"
    closing = F.regexp_extract_all(text, F.lit(f"{R.CLOSING_PHRASES}{filler}{day}"), F.lit(0))

    def read(said: Column) -> Column:
        low = F.lower(F.regexp_extract(said, f"{R.CLOSING_PHRASES}{filler}{day}", 1))
        parts = F.filter(F.split(F.regexp_replace(low, r"\bof\b|(?<=\d)(?:st|nd|rd|th)\b", " "), r"[\s,./-]+"), lambda w: w != "")
        figures = F.transform(parts, lambda w: w.try_cast("int"))
        named = F.filter(F.transform(parts, lambda w: F.coalesce(*[F.when(w.isin(m, m[:3]), F.lit(i + 1)) for i, m in enumerate(R.MONTHS)])), lambda n: n.isNotNull())
        year = F.filter(figures, lambda n: n >= 1000)
        small = F.filter(figures, lambda n: n < 1000)
        # Year first is year, month, day. Else the month has a name, or one of the two is over 12, or both are equal.
        a, b = F.get(small, F.lit(0)), F.get(small, F.lit(1))
        year_first = F.get(figures, F.lit(0)) >= 1000
        month = F.when(F.size(named) == 1, F.get(named, F.lit(0))).when(year_first, a).when(a > 12, b).when((b > 12) | (a == b), a)
        of_month = F.when(F.size(named) == 1, a).when(year_first, b).when(a > 12, a).when((b > 12) | (a == b), b)
        iso = F.concat_ws("-", F.get(year, F.lit(0)).cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(of_month.cast("string"), 2, "0"))
        sure = (F.size(year) == 1) & month.isNotNull() & of_month.isNotNull()
        return F.struct(F.when(sure, iso.try_cast("date")).alias("day"), F.regexp_replace(said, r"[\s.,]+$", "").alias("said"))

    low, high = R.END_YEARS
    fit = F.filter(F.transform(closing, read), lambda e: F.year(e["day"]).between(low, high))
    return df.withColumn("_end", F.array_max(fit)).withColumn("end_day", F.col("_end.day")).withColumn("end_said", F.col("_end.said")).drop("_end")


def skill_mentions(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row per posting and vocabulary term its text holds.

    `vocabulary`: term, skill, exact_case (match as written), list_only (counts only beside another
    term in a comma list), not_after (a preceding word that makes it another thing). The longest
    term at a position wins, and an employer's own product is not a skill.

    Each word of a text meets the terms that begin with it; terms of any length match. Until then a row carries the words as
    they are, the longest term's number of them and one more; only those that meet a term are lower-cased and compared.
    """
    # Written once, the vocabulary carries its size: Spark sees that it can be broadcast and need not shuffle every word.
    vocab = cut_lineage(vocabulary.withColumn("_key", F.split(F.lower("term"), " ")).withColumn("_head", F.col("_key")[0]).withColumn("n", F.size("_key")))
    longest = vocab.agg(F.max("n")).first()[0] or 1
    # A word holds no comma but its first character.
    words = F.regexp_extract_all("description", F.lit(r"[,\p{L}\p{N}+#.][\p{L}\p{N}+#.]*"), F.lit(0))
    base = df.select("id", F.lower(F.coalesce("company", F.lit(""))).alias("_company"), F.transform(words, lambda w: F.rtrim(w, F.lit("."))).alias("_w"))
    bare = lambda w: F.when(w.startswith(","), F.substring(w, 2, 2**31 - 1)).otherwise(w)
    # The words are lower-cased within the generator: of a plain column Spark would infer a filter and read texts a second time for it.
    rows = base.select("id", "_company", "_w", F.posexplode(F.transform("_w", lambda w: F.lower(bare(w)))).alias("_i", "_first"))
    # A word with its neighbours: the one before, and enough behind for the longest term and the word that follows it.
    rows = rows.select("id", "_company", "_first", (F.col("_i") + 1).alias("at"), F.slice("_w", F.col("_i") + 1, longest + 1).alias("_run"), F.get("_w", F.col("_i") - 1).alias("before"))
    said = F.transform(F.slice("_run", 1, F.col("n")), bare)
    hits = rows.join(vocab, F.col("_first") == F.col("_head")).filter((F.col("n") == 1) | (F.transform(said, lambda w: F.lower(w)) == F.col("_key")))
    after = F.get("_run", F.col("n"))
    in_list = F.col("_run")[0].startswith(",") | F.coalesce(after.startswith(","), F.lit(False))
    hits = hits.filter(~F.col("exact_case") | (F.array_join(said, " ") == F.col("term")))
    hits = hits.filter(~F.col("list_only") | in_list)
    hits = hits.filter(F.col("not_after").isNull() | F.col("before").isNull() | (F.lower("before") != F.lower("not_after")))
    hits = hits.filter(~F.col("_company").contains(F.lower("skill")))
    # Read from the left, longer hits first, a hit is covered when an earlier one reaches as far.
    spans = hits.groupBy("id", "at", "n").agg(F.collect_set("skill").alias("_skills"))
    before = Window.partitionBy("id").orderBy("at", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_reach", F.max(F.col("at") + F.col("n")).over(before))
    kept = spans.filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("at") + F.col("n")))
    return kept.select("id", F.explode("_skills").alias("skill")).distinct()


# --- who a board belongs to ------------------------------------------------------------------


def humanised(tenant: Column) -> Column:
    """A tenant spelled as a name: words split, a trailing number dropped, short words as acronyms;
    null for a code (all digits, or digits in two or more runs in every word)."""
    words = F.filter(F.split(tenant, r"[-_\s]+"), lambda w: w != "")
    trimmed = F.when((F.size(words) > 1) & F.element_at(words, -1).rlike(r"^\d+$"), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(words)
    cased = F.transform(trimmed, lambda w: F.when((w == F.lower(w)) & (F.length(F.regexp_replace(w, r"[^a-z]", "")) <= 3), F.upper(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))
    ))
    code = F.forall(trimmed, lambda w: w.rlike(r"^\d+$") | w.rlike(r"\d+\D+\d+"))
    return F.when((F.size(words) > 0) & ~code, F.array_join(cased, " "))


def settle_company(rows: DataFrame, curated: DataFrame, share: float = 0.5) -> DataFrame:
    """`(board, name, name_source)`: the curated name, else the name at least `share` of a board's
    stating rows carry (the lowest among equals), else its tenant spelled out, else null.

    Rows are counted by board and name before anything is grouped, so one board's size does not
    matter.
    """
    stated = rows.withColumn("_name", F.trim("company")).withColumn(
        "_name", F.when((F.col("_name") != "") & (F.lower("_name") != F.lower(F.element_at(F.split("board", ":"), -1))), F.col("_name"))
    )
    counts = stated.groupBy("board", "_name").agg(F.count(F.lit(1)).alias("_n"))
    voted = counts.groupBy("board").agg(
        F.min(F.when(F.col("_name").isNotNull(), F.struct((-F.col("_n")).alias("neg"), F.col("_name").alias("name")))).alias("_best"),
        F.sum(F.when(F.col("_name").isNotNull(), F.col("_n"))).alias("_stating"),
    )
    agreed = F.when(-F.col("_best.neg") >= F.col("_stating") * share, F.col("_best.name"))
    spelled = humanised(F.element_at(F.split("board", ":"), -1))
    joined = voted.join(curated.select(F.lower("board").alias("_key"), F.col("name").alias("_curated")), F.lower(F.col("board")) == F.col("_key"), "left")
    source = F.when(F.col("_curated").isNotNull(), "curated").when(agreed.isNotNull(), "stated").when(spelled.isNotNull(), "tenant")
    return joined.select("board", F.coalesce("_curated", agreed, spelled).alias("name"), source.alias("name_source"))


def name_forms(text: Column) -> Column:
    """Exact spellings a name is listed under: its words, all of them joined, and each without a
    trailing number."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    forms = F.concat(words, F.array(F.array_join(words, "")))
    both = F.concat(forms, F.transform(forms, lambda w: F.regexp_replace(w, r"\d+$", "")))
    return F.array_distinct(F.filter(both, lambda w: w != ""))


def classify_operator(boards: DataFrame, lists: DataFrame, agency_words: str = r"(?i)\b(staffing|recruit\w*|talent|consult\w*|manpower|outsourcing)\b") -> DataFrame:
    """`operator` per board: aggregator, staffing or services when a list names it, employer by
    default or by exception; `unverified` marks a default employer that reads like an agency.

    `lists`: form, kind (exception, verified, aggregator, staffing, services).
    """
    forms = boards.select("board", "company", F.explode(F.array_union(
        name_forms(F.element_at(F.split("board", ":"), 2)), name_forms(F.col("company"))
    )).alias("form"))
    kinds = forms.join(lists, "form").groupBy("board").agg(F.collect_set("kind").alias("kinds"))
    joined = boards.join(kinds, "board", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    has = lambda k: F.array_contains("kinds", k)
    operator = (
        F.when(has("exception"), "employer").when(has("aggregator"), "aggregator").when(has("staffing"), "staffing")
        .when(has("services"), "services").otherwise("employer")
    )
    return joined.withColumn("operator", operator).withColumn(
        "unverified", (F.col("operator") == "employer") & ~has("exception") & ~has("verified") & F.coalesce(F.col("company").rlike(agency_words), F.lit(False))
    ).drop("kinds")


def company_operator(boards: DataFrame) -> DataFrame:
    """`operator` per company: an aggregator if any board re-posts, else staffing, else services."""
    rank = F.when(F.col("operator") == "aggregator", 0).when(F.col("operator") == "staffing", 1).when(F.col("operator") == "services", 2).otherwise(3)
    return boards.groupBy("company").agg(F.min(F.struct(rank.alias("r"), F.col("operator").alias("operator"))).alias("b")).select("company", F.col("b.operator").alias("operator"))


