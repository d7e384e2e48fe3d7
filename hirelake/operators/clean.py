"""Cleaning and canonicalisation of the posting table, each with its change report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, rx_escape, squash
from ..rules import cleaning as R
from ..rules.places import CITY_GROUPS, COUNTRIES
from .filters import date_shaped, employment_flags

TAGS = r"(?s)<[^>]*>"
NON_TEXT = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"
LINE_BREAKS = r"\s*[\r\n]+\s*"
# UTF-8 byte sequences read as Latin-1, and ASCII; what is left over after them is no such text.
UTF8_AS_LATIN1 = r"[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}"


def unescape(c: Column) -> Column:
    """Named entities decoded from the fixed list, "&amp;" last; text without one is left alone."""
    out = c
    for entity, text in R.ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(text))
    return F.when(c.contains("&"), out).otherwise(c)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 read as Latin-1 put right, only where every byte sequence is valid."""
    broken = c.rlike(r"[\xC2-\xF4][\x80-\xBF]") & (F.regexp_replace(c, UTF8_AS_LATIN1, "") == "")
    return F.when(broken, F.decode(F.encode(F.when(broken, c), "ISO-8859-1"), "UTF-8")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Script and style blocks, tags and entities gone; white space single; null when nothing is left.

    In markup the blocks go before any entity is decoded, so an escaped code sample keeps its text;
    a text without a tag may be encoded whole, so it is decoded first.
    """
    decoded = F.when(c.rlike(TAGS), c).otherwise(unescape(c))
    bare = F.regexp_replace(F.regexp_replace(decoded, NON_TEXT, " "), TAGS, " ")
    return F.nullif(squash(unescape(F.regexp_replace(unescape(bare), TAGS, " "))), F.lit(""))


def change_report(before: DataFrame, after: DataFrame, columns: Iterable[str], source: str = "ats") -> DataFrame:
    """`(source, column, rows, rows_changed)`: values that differ, nulls equal to nulls.

    `after` must carry the old values beside the new ones as `old_<column>`; `with_old` adds them,
    so the report needs no join.
    """
    columns = list(columns)
    counts = after.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"old_{c}"))).alias(f"changed_{c}") for c in columns],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"changed_{c}").alias("rows_changed")) for c in columns])
    return counts.select("source", "rows", F.inline(pairs)).select("source", "column", "rows", "rows_changed")


def with_old(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({f"old_{c}": F.col(c) for c in columns})


def epoch_ms_to_iso(c: Column) -> Column:
    """Milliseconds since 1970 as an ISO UTC string; anything else as it was."""
    stamp = F.date_format(F.timestamp_millis(c.try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.when(c.rlike(r"^\d{12,14}$"), stamp).otherwise(c)


def clean_postings(df: DataFrame) -> DataFrame:
    """Title, company and location decoded and trimmed, mojibake repaired, markup dropped, a line
    break in a location read as a list, descriptions as plain text, epoch dates as UTC stamps."""
    present = [c for c in ("title", "company", "location", "description", "posted_at") if c in df.columns]
    decoded = {}
    for name in present:
        if name in ("title", "company"):
            decoded[name] = F.trim(unescape(F.col(name)))
        elif name == "location":
            flat = F.regexp_replace(F.trim(F.regexp_replace("location", TAGS, " ")), LINE_BREAKS, "; ")
            decoded[name] = squash(unescape(flat))
        elif name == "description":
            decoded[name] = html_to_text(F.col(name))
        else:
            decoded[name] = epoch_ms_to_iso(F.col(name))
    # Two steps, so the repair reads each decoded value once instead of computing it again.
    out = df.withColumns(decoded)
    out = out.withColumns({name: repair_mojibake(F.col(name)) for name in present if name in ("title", "company", "location")})
    return out.withColumn("location", tidy_location(F.col("location"))) if "location" in present else out


def tidy_location(c: Column) -> Column:
    """Template tokens, a country named twice at a place's end, and a place listed twice dropped."""
    entries = F.filter(F.transform(F.split(c, r"\s*;\s*"), lambda e: F.trim(e)), lambda e: e != "")
    countries = "|".join(rx_escape(name) for name in R.COUNTRY_LEVEL)
    repeated = rf"(?i)(^|,\s*)({countries})(?:\s*,\s*\2)+\s*$"

    def tidy(entry: Column) -> Column:
        tokens = F.filter(F.split(entry, r"\s*,\s*"), lambda t: (t != "") & ~F.lower(t).isin(*R.TEMPLATE_TOKENS))
        return F.regexp_replace(F.array_join(tokens, ", "), repeated, "$1$2")

    def first_of_each(kept: Column, entry: Column) -> Column:
        said = (entry == "") | F.exists(kept, lambda k: F.lower(squash(k)) == F.lower(squash(entry)))
        return F.when(said, kept).otherwise(F.concat(kept, F.array(entry)))

    text = F.array_join(F.aggregate(F.transform(entries, tidy), F.array().cast("array<string>"), first_of_each), "; ")
    return F.nullif(text, F.lit(""))


def place_key(c: Column) -> Column:
    """One key for all spellings of a place: folded, each renamed city as its group's first."""
    out = squash(fold(c))
    for group in CITY_GROUPS:
        others = "|".join(rx_escape(s) for s in group[1:])
        out = F.regexp_replace(out, rf"(^|[^a-z0-9])(?:{others})(?![a-z0-9])", "$1" + group[0])
    return out


STATED_LOCATION = r"(?i)(?:^|[^A-Za-z])(?:(?:job|work|office|primary) )?locations?\s*[:：]\s*([A-Z][\w.'-]*(?: [A-Z][\w.'-]*){0,2}(?:, ?[A-Z][\w.'-]*(?: [A-Z][\w.'-]*){0,2}){0,2})"


def stated_location(description: Column) -> Column:
    """The place an explicit "Location:" line states, if its parts read as a place list: short
    capitalised names of which one is a known place or an upper-case code."""
    stated = F.regexp_extract(description, STATED_LOCATION.replace("(?i)", "", 1).replace("locations?", "[Ll]ocations?"), 1)
    parts = F.split(stated, r"\s*,\s*")
    known = sorted({w for c in COUNTRIES.values() for kind in ("words", "shared_words", "city_words") for w in c.get(kind, ())} | {c["name"].lower() for c in COUNTRIES.values()})
    reads = F.exists(parts, lambda p: F.lower(p).isin(*known) | p.rlike("^[A-Z]{2}$"))
    return F.when((stated != "") & reads, stated)


def resolve_locations(df: DataFrame) -> DataFrame:
    """Location tidied; where none is stated, the text's own "Location:" line; and its place key."""
    place = F.coalesce(tidy_location(F.col("location")), stated_location(F.col("description")))
    return df.withColumn("location", place).withColumn("place_key", place_key(F.split("location", "[,;]").getItem(0)))


def host_of(url: Column) -> Column:
    rest = F.element_at(F.split(url, "://", 2), -1)
    return F.lower(F.split(F.split(rest, "/", 2).getItem(0), r"\?", 2).getItem(0))


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a two-label suffix; empty where there is no domain."""
    labels = F.filter(F.split(F.lower(F.trim(host)), r"\."), lambda p: p != "")
    two_label = F.element_at(labels, -2).isin(*R.TWO_LABEL_SUFFIXES)
    n = F.when((F.size(labels) >= 3) & two_label, 3).otherwise(2)
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")).otherwise(F.lit(""))


def normalise_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]] = R.URL_RULES, source: str = "ats") -> DataFrame:
    """`url` only if http(s) and in its source's current shape, with `host` and `domain`."""
    url = F.trim("url")
    url = F.when(F.lower(url).rlike("^https?://"), url).otherwise(F.lit(""))
    for name, pattern, replacement in rules:
        url = F.when(F.col(source) == name, F.regexp_replace(url, pattern, replacement)).otherwise(url)
    return df.withColumn("url", url).withColumn("host", host_of(F.col("url"))).withColumn("domain", registrable_domain(F.col("host")))


def clean_markdown(c: Column) -> Column:
    text = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    # A hash right after a letter is C# or F#, not a heading.
    return squash(F.regexp_replace(text, r"[*`>]+|(?<![A-Za-z])#+", " "))


def build_documents(df: DataFrame, buckets: Sequence[int] = R.BUCKETS) -> DataFrame:
    """`document` (title and body), `n_tokens`, and the smallest length `bucket` that holds it."""
    body = clean_markdown(F.coalesce("description", F.lit("")))
    doc = df.withColumn("document", F.concat(F.trim(F.coalesce("title", F.lit(""))), F.lit("\n\n"), body))
    tokens = F.size(F.filter(F.split("document", r"\s+"), lambda t: t != ""))
    bucket = F.lit(buckets[-1])
    for size in reversed(buckets[:-1]):
        bucket = F.when(F.col("n_tokens") <= size, size).otherwise(bucket)
    return doc.withColumn("n_tokens", tokens).withColumn("bucket", bucket)


def bucket_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))


def content_fingerprints(df: DataFrame, raw_fields: Sequence[str] = R.RAW_FIELDS) -> DataFrame:
    """`doc_hash` (title and description), `fields_hash` (every stated raw field, so a field nobody
    states changes nothing) and `text_hash` (white space normalised)."""
    text = F.concat(F.trim(F.coalesce("title", F.lit(""))), F.lit("\n"), F.trim(F.coalesce("description", F.lit(""))))
    stated = [F.concat(F.lit(n + "="), F.col(n).cast("string")) for n in raw_fields if n in df.columns]
    return df.withColumns({
        "doc_hash": F.md5(text), "fields_hash": F.md5(F.concat_ws("\x1f", *stated)),
        "text_hash": F.md5(squash(F.lower(F.coalesce("description", F.lit(""))))),
    })


def language_scores(text: Column, profiles: Mapping[str, Sequence[str]] = R.LANGUAGE_WORDS) -> Column:
    """Array of `(score, lang)`: how many of the text's words are common in each language."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    return F.array(*[
        F.struct(F.size(_held(words, common)).alias("score"), F.lit(lang).alias("lang"))
        for lang, common in profiles.items()
    ])


def _held(words: Column, common: Sequence[str]) -> Column:
    return F.filter(words, lambda w: w.isin(*common))


def language_gate(df: DataFrame, keep: str = "en", profiles: Mapping[str, Sequence[str]] = R.LANGUAGE_WORDS) -> DataFrame:
    """`language` of title and text, and `kept`; a text with no common word is rejected."""
    text = F.concat_ws(" ", "title", "description")
    best = F.array_max(language_scores(text, profiles))
    out = df.withColumn("_best", best).withColumn("language", F.when(F.col("_best.score") > 0, F.col("_best.lang")))
    return out.withColumn("kept", F.coalesce(F.col("language") == keep, F.lit(False))).drop("_best")


def language_report(gated: DataFrame, source: str = "ats") -> DataFrame:
    return gated.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept"), F.count_if(F.col("language").isNull()).alias("undetected")
    )


def served_posted_at(posted: Column, first_seen: Column) -> Column:
    """Never past the day after first sight, never a pre-2000 sentinel; other shapes untouched."""
    latest = F.date_add(F.substring(first_seen, 1, 10).try_cast("date"), 1).cast("string")
    shaped = F.coalesce(date_shaped(posted), F.lit(False))
    return (
        F.when(~shaped, posted).when(F.substring(posted, 1, 4) < "2000", F.lit(None))
        .when(latest.isNotNull() & (F.substring(posted, 1, 10) > latest), F.substring(first_seen, 1, 10)).otherwise(posted)
    )


SERVED_ORDER = (
    "id", "ats", "board", "company", "title", "description", "description_stored", "location", "countries", "places", "remote", "employment_type",
    "is_full_time", "is_part_time", "is_contract", "is_internship", "experience", "min_years", "max_years", "experience_source",
    "experience_at_most_0", "experience_at_most_2", "experience_at_most_5", "experience_at_most_10", "salary",
    "min_salary_annual", "max_salary_annual", "salary_currency", "salary_source", "salary_known", "department",
    "is_confident_non_tech", "stances", "operator", "family", "url", "requisition", "posted_at", "posted_at_comparable", "first_seen", "vector",
)


def served_projection(df: DataFrame, requisition_boards: DataFrame | None = None, board: str = "board") -> DataFrame:
    """Facts, derivations and filter flags in served order. A requisition is kept only on the
    listed boards, where something can match on it."""
    out = df.withColumn("posted_at", served_posted_at(F.col("posted_at"), F.col("first_seen")))
    flags = employment_flags(F.col("employment_type"), F.col("title"))
    flags.update({f"experience_at_most_{n}": F.col("min_years").isNull() | (F.col("min_years") <= n) for n in (0, 2, 5, 10)})
    flags["salary_known"] = F.col("min_salary_annual").isNotNull()
    flags["posted_at_comparable"] = F.coalesce(date_shaped(F.col("posted_at")), F.lit(False))
    flags["description_stored"] = F.col("description").isNotNull()
    out = out.withColumns(flags)
    if "is_confident_non_tech" not in out.columns:
        out = out.withColumn("is_confident_non_tech", F.lit(False))
    if requisition_boards is not None and "requisition" in out.columns:
        listed = requisition_boards.select(F.lower("board").alias("_key")).distinct().withColumn("_listed", F.lit(True))
        out = out.join(listed, F.lower(out[board]) == F.col("_key"), "left").withColumn(
            "requisition", F.when(F.col("_listed"), F.col("requisition"))
        )
    return out.select(*[c for c in SERVED_ORDER if c in out.columns])


def company_words(c: Column) -> Column:
    """Comparable words: no case, accents, punctuation or trailing legal form."""
    plain = F.replace(F.replace(fold(c), F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(""))
    words = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # Words up to the last one that is no legal form; a name of legal forms alone keeps them.
    real = F.transform(words, lambda w, i: F.when(~w.isin(*R.LEGAL_FORMS), i + 1).otherwise(0))
    last = F.coalesce(F.array_max(real), F.lit(0))
    return F.when(last > 0, F.slice(words, 1, F.greatest(last, F.lit(1)))).otherwise(words)


def company_keys(df: DataFrame, column: str = "company") -> DataFrame:
    """`company_key`, the comparable words joined, and `company_head`, the first of them."""
    return df.withColumn("_w", company_words(F.col(column))).withColumns({
        "company_key": F.array_join("_w", " "), "company_head": F.try_element_at("_w", F.lit(1)),
    }).drop("_w")

