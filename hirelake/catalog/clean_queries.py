"""Registered queries: cleaning jobs over the bound postings, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..rules.cleaning import ENTITIES, LANGUAGE_WORDS, LEGAL_FORMS, RAW_FIELDS, URL_RULES
from .filter_queries import CONTRACT, FULL_OR_NONE, INTERN, PART
from .registry import query


def _entities(c):
    for entity, text in ENTITIES.items():
        c = f"replace({c}, '{entity.replace(chr(39), chr(39) * 2)}', '{text.replace(chr(39), chr(39) * 2)}')"
    return c


SPACES = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
TEXT = SPACES.format(_entities(f"regexp_replace({_entities('regexp_replace(html, {block}, {blank}, {flags})')}, '(?s)<[^>]*>', ' ', 'g')")).replace(
    "{block}", "'<(?:script\\b[^>]*>.*?</script|style\\b[^>]*>.*?</style)\\s*>'").replace("{blank}", "' '").replace("{flags}", "'gis'")


@query("clean_pages", f"SELECT page_id, {TEXT} AS description FROM pages")
def _clean_pages(b):
    return b.pages.select("page_id", clean.html_to_text(F.col("html")).alias("description"))


# Marked-up titles and places derived from the bound rows.
DIRTY = """
    SELECT id, ats, ' ' || title || ' &amp; more ' AS title, company,
           '<b>' || location || '</b>' || chr(10) || location AS location,
           '<p>' || description || '</p><style>p{{}}</style>' AS description,
           CASE WHEN posted_at IS NULL THEN '1700000000000' ELSE posted_at END AS posted_at
    FROM {postings}"""


@query("clean_postings", f"""
    SELECT id, trim(title || ' & more') AS title, company,
           CASE location WHEN 'Munich, Germany, Germany' THEN 'Munich, Germany' WHEN 'Toronto, Canada; London, UK' THEN location ELSE location END AS location,
           {SPACES.format('description')} AS description,
           CASE WHEN posted_at IS NULL THEN '2023-11-14T22:13:20+00:00' ELSE posted_at END AS posted_at
    FROM postings""")
def _clean_postings(b):
    return clean.clean_postings(b.sql(DIRTY)).drop("ats")


@query("clean_postings_report", """
    SELECT ats AS source, c AS "column", count(*) AS rows, count(*) FILTER (WHERE changed) AS rows_changed
    FROM (SELECT ats, 'title' AS c, TRUE AS changed FROM postings
          UNION ALL SELECT ats, 'location', location IS NOT NULL FROM postings
          UNION ALL SELECT ats, 'description', description IS NOT NULL FROM postings
          UNION ALL SELECT ats, 'posted_at', posted_at IS NULL FROM postings)
    GROUP BY 1, 2""")
def _clean_report(b):
    columns = ["title", "location", "description", "posted_at"]
    dirty = clean.with_old(b.sql(DIRTY), columns)
    return clean.change_report(dirty, clean.clean_postings(dirty), columns)


@query("repair_mojibake")
def _mojibake(b):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    df = b.documents.select("doc_id", "text", broken.alias("broken"))
    return df.select("doc_id", (clean.repair_mojibake(F.col("broken")) == F.col("text")).alias("repaired"))


@query("resolve_locations", """
    WITH r AS (SELECT id, CASE WHEN location = 'Munich, Germany, Germany' THEN 'Munich, Germany'
                               WHEN location IS NULL AND contains(description, 'Location: Austin, TX') THEN 'Austin, TX' ELSE location END AS location FROM postings),
    k AS (SELECT *, translate(lower(trim(split_part(split_part(location, ',', 1), ';', 1))), 'ü', 'u') AS head FROM r)
    SELECT id, location, CASE head WHEN 'bangalore' THEN 'bengaluru' ELSE head END AS place_key FROM k""")
def _resolve(b):
    return clean.resolve_locations(b.postings).select("id", "location", "place_key")


@query("normalise_urls", """
    SELECT id, CASE WHEN ats = 'nation_2' THEN 'https://jobs.nation-two.example.org/o/' || split_part(id, ':', 3) ELSE url END AS url,
           CASE WHEN ats = 'nation_2' THEN 'jobs.nation-two.example.org' ELSE 'jobs.' || ats || '.example.com' END AS host,
           CASE WHEN ats = 'nation_2' THEN 'example.org' ELSE 'example.com' END AS domain
    FROM postings""")
def _urls(b):
    moved = ("nation_2", r"^https?://[^/]+/(\d+)/(\d+)$", "https://jobs.nation-two.example.org/o/$2")
    return clean.normalise_urls(b.postings, (*URL_RULES, moved)).select("id", "url", "host", "domain")


@query("page_domains", """
    SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
           regexp_extract(regexp_extract(url, '^https?://([^/?#]*)', 1), '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS pages
    FROM pages GROUP BY 1, 2""")
def _page_domains(b):
    rows = clean.normalise_urls(b.pages.withColumn("ats", F.lit("web")))
    return rows.groupBy("host", "domain").agg(F.count(F.lit(1)).alias("pages"))


DOC = "trim(coalesce(title, '')) || chr(10) || chr(10) || trim(regexp_replace(regexp_replace(regexp_replace(description, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*`>]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("build_documents", f"""
    WITH d AS (SELECT id, regexp_replace({DOC}, '(^|[^A-Za-z])#+', '\\1 ', 'g') AS document FROM texts),
    s AS (SELECT id, len(list_filter(string_split_regex(document, '\\s+'), lambda x: x <> '')) AS n_tokens FROM d)
    SELECT CASE WHEN n_tokens <= 512 THEN 512 WHEN n_tokens <= 1024 THEN 1024 WHEN n_tokens <= 2048 THEN 2048 ELSE 4096 END AS bucket,
           count(*) AS rows, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM s GROUP BY 1""")
def _documents(b):
    return clean.bucket_counts(clean.build_documents(b.texts))


STATED = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '{n}=' || CAST({n} AS STRING) END" for n in RAW_FIELDS)


@query("content_fingerprints", f"""
    SELECT id, md5(trim(title) || chr(10) || trim(coalesce(description, ''))) AS doc_hash,
           md5(concat_ws(chr(31), {STATED})) AS fields_hash,
           md5(trim(regexp_replace(lower(coalesce(description, '')), '\\s+', ' ', 'g'))) AS text_hash
    FROM postings""")
def _fingerprints(b):
    return clean.content_fingerprints(b.postings).select("id", "doc_hash", "fields_hash", "text_hash")


def _lang_sql():
    words = "string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[^\\p{L}]+')"
    scores = ", ".join(
        f"len(list_filter({words}, lambda w: list_contains([{', '.join(repr(x) for x in common)}], w))) AS s_{lang}"
        for lang, common in LANGUAGE_WORDS.items()
    )
    best = "greatest(s_en, s_fr, s_de, s_es)"
    # A tie goes to the later language code, as the maximum of (score, code) does.
    pick = f"CASE WHEN {best} = 0 THEN NULL WHEN s_fr = {best} THEN 'fr' WHEN s_es = {best} THEN 'es' WHEN s_en = {best} THEN 'en' ELSE 'de' END"
    return f"""
    WITH s AS (SELECT id, ats, {scores} FROM texts), l AS (SELECT ats, {pick} AS language FROM s)
    SELECT ats AS source, count(*) AS rows, count(*) FILTER (WHERE coalesce(language = 'en', FALSE)) AS kept,
           count(*) FILTER (WHERE language IS NULL) AS undetected FROM l GROUP BY 1"""


@query("language_gate", _lang_sql())
def _language(b):
    return clean.language_report(clean.language_gate(b.texts))


SERVED = ["id", "posted_at", "posted_at_comparable", "requisition", "is_full_time", "is_part_time", "is_contract", "is_internship",
          "experience_at_most_2", "salary_known", "description_stored"]


@query("served_projection", f"""
    WITH p AS (SELECT * REPLACE (CASE
              WHEN NOT coalesce(posted_at LIKE '____-__-__%', FALSE) THEN posted_at WHEN substring(posted_at, 1, 4) < '2000' THEN NULL
              WHEN first_seen IS NOT NULL AND substring(posted_at, 1, 10) > CAST(CAST(substring(first_seen, 1, 10) AS DATE) + 1 AS STRING) THEN substring(first_seen, 1, 10)
              ELSE posted_at END AS posted_at) FROM postings)
    SELECT p.id, posted_at, coalesce(posted_at LIKE '____-__-__%', FALSE) AS posted_at_comparable,
           CASE WHEN b.in_scope THEN requisition END AS requisition,
           ({FULL_OR_NONE} AND NOT regexp_matches(title, '\\bintern(ship)?s?\\b', 'i')) OR {FULL_OR_NONE.split(' OR NOT (')[0][1:]} AS is_full_time, {PART} AS is_part_time, {CONTRACT} AS is_contract,
           {INTERN} OR regexp_matches(title, '\\bintern(ship)?s?\\b', 'i') AS is_internship,
           min_years IS NULL OR min_years <= 2 AS experience_at_most_2, min_salary_annual IS NOT NULL AS salary_known,
           description IS NOT NULL AS description_stored
    FROM p LEFT JOIN boards b ON p.board = b.board""")
def _served(b):
    return clean.served_projection(b.postings, b.boards.filter("in_scope")).select(*SERVED)


@query("company_keys", f"""
    WITH w AS (SELECT id, company, list_filter(string_split_regex(replace(lower(company), '.', ''), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM postings)
    SELECT id, array_to_string(CASE WHEN list_contains([{', '.join(repr(x) for x in LEGAL_FORMS)}], words[-1]) THEN words[:-2] ELSE words END, ' ') AS company_key,
           words[1] AS company_head FROM w""")
def _company_keys(b):
    return clean.company_keys(b.postings).select("id", "company_key", "company_head")
