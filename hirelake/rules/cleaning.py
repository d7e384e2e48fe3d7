"""Values the cleaning jobs read."""

# Named entities a posting's text holds.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&rsquo;": "’", "&lsquo;": "‘",
    "&ldquo;": "“", "&rdquo;": "”", "&ndash;": "–", "&mdash;": "—", "&bull;": "•", "&hellip;": "…", "&eacute;": "é",
    "&egrave;": "è", "&uuml;": "ü", "&ouml;": "ö", "&auml;": "ä", "&amp;": "&",
}

# Template tokens that are no place, countries that end a place once, legal forms
# that end a company name, host parts that count as one public suffix.
TEMPLATE_TOKENS = ("blank", "n/a", "none", "null")
COUNTRY_LEVEL = (
    "germany", "france", "india", "united states", "usa", "united kingdom", "uk", "canada", "japan", "switzerland",
    "spain", "ireland", "australia", "netherlands", "singapore", "italy", "poland", "brazil", "mexico", "sweden",
)
LEGAL_FORMS = (
    "inc", "incorporated", "llc", "llp", "ltd", "limited", "pvt", "private", "plc", "corp", "corporation", "co", "company",
    "gmbh", "ag", "sa", "sas", "sarl", "bv", "nv", "ab", "oy", "as", "srl", "spa", "pty", "kg", "se",
)
TWO_LABEL_SUFFIXES = ("co", "com", "org", "net", "gov", "ac", "edu")

# Token-length buckets of a document, and the raw fields a change is read from.
BUCKETS = (512, 1024, 2048, 4096)
RAW_FIELDS = (
    "ats", "company", "title", "location", "remote", "department", "url", "posted_at", "experience", "employment_type",
    "salary", "requisition",
)

# (source, pattern, replacement): links a source moved, brought to its current shape.
URL_RULES = (
    ("darwinbox", r"/ms/candidate/careers/jobs/", "/ms/candidatev2/main/careers/jobDetails/"),
)

# Common words per language; a document's language is the one whose words it holds most.
LANGUAGE_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "are", "on", "by", "this", "you", "we", "it", "as", "be", "or", "at"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "pour", "dans", "est", "en", "du", "ou", "elle", "avec", "vous", "nous"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "für", "von", "zu", "den", "auf", "sie", "wir", "im", "dem", "auch", "als"),
    "es": ("el", "los", "las", "y", "que", "una", "por", "con", "para", "es", "se", "del", "su", "al", "como", "más", "pero", "este", "la", "de"),
}
