"""Fixed schemas of the tables the library reads and writes."""

from __future__ import annotations

POSTING = (
    "id string, ats string, company string, title string, location string, remote boolean, department string, url string, "
    "posted_at string, scraped_at string, description string, experience string, employment_type string, salary string, "
    "marketplace_employer_id string, requisition string"
)

LEDGERS = {
    "liveness": "ats string, tenant string, url string, status string, jobs int, checked_at string",
    "priority": "board string, score double, last_tech_jobs int, updated_at string",
    "cost": "board string, seconds double, jobs int, updated_at string",
    "gap": "board string, unsettled bigint, updated_at string",
    "alias": "ats string, duplicate string, canonical string, signal string, resolved_to string, checked_at string",
    "failures": "board string, strikes int, last_reason string, last_seen_gone string",
    "backing": "eightfold string, backing string",
    "evictions": "ts string, board string, rule string, count bigint",
}

TICK = "board string, metric string, family string, band string, delta bigint"
TICK_ARCHIVE = "ts string, metric string, family string, band string, ats string, delta bigint"
METHOD = (
    "ts string, family_list_fingerprint string, family_classifier_version string, tech_filter_version int, "
    "derivations_version int, dedup_version int"
)
