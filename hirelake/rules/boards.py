"""Values about boards and their copies."""

# Sources whose native id is a requisition every board of one tenant shares, words
# of a site meant for insiders, and the source that fronts other boards.
TENANT_SOURCES = ("workday", "taleo_enterprise", "taleo_be", "adp")
NON_PUBLIC_TOKENS = ("hidden", "confidential", "internal", "private", "sourcer", "targeted")
FRONT_SOURCE = "eightfold"

# Days after which a verdict is checked again, strikes to quarantine, days to parole.
RECHECK_DAYS = {"live": 7, "dead": 90, "unknown": 3}
QUARANTINE_AT = 20
PAROLE_DAYS = 7

# Fixed value: the share of a front's postings that may be on no backing board.
RESIDUAL_SHARE = 0.01
