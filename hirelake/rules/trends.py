"""Values the trends engine reads."""

# Which counting fields move lines, the sizes below which a step or a base is not
# read, days and counts of the windows, and how many lines are charted.
LINE_MOVING_FIELDS = ("family_list_fingerprint", "family_classifier_version", "tech_filter_version")
METHOD_FIELDS = ("family_list_fingerprint", "family_classifier_version", "tech_filter_version", "derivations_version", "dedup_version")
SMALLEST_STEP = 5
RATIO_FLOOR = 20
PARTIAL_READ_MIN_LEAP = 20
MOVER_FLOOR = 20
MIN_SPAN_DAYS = 3
INDEX_BASE_FLOOR = 5
LINES_CHARTED = 8
NEW_WINDOW_DAYS = 7
FOUND_LATE_DAYS = 14
FOUND_LATE_MIN_OPENED = 10
HOT_TOP = 100
HOT_MIN_STOCK = 25
HOT_MIN_DAYS = 3
HIDDEN_BY_DEFAULT = ("staffing", "aggregator")
LEVEL_METRICS = ("new", "stock")
TURNOVER_METRICS = ("opened", "closed", "recounted_in", "recounted_out")

# What a typed name also means, and words of a test copy of a site.
QUERY_ALIASES = {
    "aws": "amazon", "amazon web services": "amazon", "jp morgan": "jpmorgan chase", "j p morgan": "jpmorgan chase", "jpm": "jpmorgan chase",
    "chase": "jpmorgan chase", "meta platforms": "meta", "facebook": "meta", "google deepmind": "google", "alphabet": "google",
    "tcs": "tata consultancy", "youtube": "google", "deepmind": "google",
}
TEST_TENANT = r"^(dev|test|uat|sandbox|staging|demo|preprod)\d*$"
TYPO_MIN = 5
SQUEEZE_MIN = 5
