"""Values of the search filters."""

# Employment-type words. A type is read where an include is present and no exclude
# is; an (include, veto) pair counts only where the veto is absent; whole values count alone.
EMPLOYMENT_TYPES = {
    "full-time": {
        "column": "is_full_time",
        "includes": ("full", "_ft", "temps plein", "tiempo completo", "vollzeit", "全职"),
        "unless": (("permanent", "part"), ("regular", "part"), ("cdi", "part"), ("fte", "after")),
        "whole": ("f", "ft"),
    },
    "part-time": {"column": "is_part_time", "includes": ("part", "_pt")},
    "contract": {"column": "is_contract", "includes": ("contract", "freelance", "fixed", "temporary")},
    "internship": {
        "column": "is_internship",
        "includes": ("intern", "co-op", "coop"),
        "excludes": ("international",),
        "title": r"(?i)\bintern(?:ship)?s?\b",
    },
}

# The options the facets offer.
EXPERIENCE_CEILINGS = (0, 2, 5, 10)
SEEN_HOURS = (2, 4, 6, 8, 12, 18, 24, 168)
POSTED_DAYS = (1, 7, 30, 90)
KEYWORD_SCOPES = {"title": ("title",), "description": ("description",), "both": ("title", "description")}
KEYWORD_DEFAULT_SCOPE = "title"
KEYWORD_MAX_TERMS = 5
TERM_LENGTH = 60
SALARY_DEFAULT_CURRENCY = "USD"

# Filters the zero-result answer never names, since no control removes them.
NEVER_BLOCKING = (
    "posted_sortable", "kw_in", "title_words", "salary_currency", "posted_after", "posted_before",
    "seen_after", "seen_before", "first_seen_after",
)

# Units of each currency per one US dollar, 2026-09-07.
FX_RATES = {
    "USD": 1.0, "INR": 94.55, "EUR": 0.8611, "GBP": 0.7397, "CAD": 1.3831, "AUD": 1.3877, "NZD": 1.7001,
    "SGD": 1.2671, "CHF": 0.8099, "JPY": 156.18, "CNY": 6.7194, "HKD": 7.841, "TWD": 31.63, "KRW": 1346.56,
    "SEK": 9.5717, "NOK": 9.3035, "DKK": 6.4337, "PLN": 3.714, "CZK": 20.83, "HUF": 312.02, "RON": 4.521,
    "BRL": 5.1221, "MXN": 16.89, "ZAR": 15.96, "AED": 3.6725, "SAR": 3.75, "ILS": 3.0122, "TRY": 48.46,
    "PHP": 62.74, "IDR": 17655.31, "MYR": 4.0443, "THB": 32.92, "VND": 25999.42, "NGN": 1321.99,
    "PKR": 277.39, "QAR": 3.64, "COP": 3131.92,
}
