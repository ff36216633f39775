"""Values that are part of the semantics: limits, vocabularies, wording."""

# Limits.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_UPLOAD_MEGABYTES = 10
MAX_FREE_TEXT_LENGTH = 200
MAX_ORIGINAL_FILENAME_LENGTH = 255
MAX_MONTHS = 120
MAX_WEIGHT_DIGITS = 15
MAX_FUTURE_DAYS = 30
EARLIEST_DATE = "2000-01-01"
MAX_COLUMNS = 25
MAX_HEADER_SEARCH_LINES = 10
MAX_DATA_ROWS = 500_000
MAX_PROBLEMS_REPORTED = 20
MAX_ROW_RANGES_REPORTED = 5
MAX_EXAMPLE_VALUES = 3
MAX_QUOTED_CHARS = 40
LEASE_SECONDS = 180
CLAIM_CEILING_SECONDS = 1800
HUNG_SECONDS = 600
HARD_TIMEOUT_SECONDS = 1200
REAPS_PER_SWEEP = 5
NOTIFY_BASE_SECONDS = 300
NOTIFY_MAX_ATTEMPTS = 5
NOTIFY_PER_SWEEP = 5
UPLOAD_BUDGET_SECONDS = 300
MAX_ATTEMPTS = 5
MAX_ORGS_CREATED = 5
UPLOADS_PER_HOUR = 5
UPLOADS_PER_WEEK = 20
INVITES_PER_HOUR = 5
DETAIL_CHARS = 8000

# Upload layout.
REQUIRED_COLUMNS = ["product", "date", "weight"]
ALIASES = {
    "product": ["product", "product name", "item", "item name", "description"],
    "date": ["date", "date ordered", "order date"],
    "weight": ["weight"],
}
DELIMITERS = [",", ";", "\t", "|"]

# Cell rules.
PLACEHOLDERS = [
    "-", ".", "na", "n/a", "nan", "none", "null",
    "#n/a", "#value!", "#ref!", "#div/0!", "#name?", "#null!", "#num!",
]
CURRENCY_SYMBOLS = "$€£¥₹₩₽₺₫¢"
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}

# What a reader is told, by kind and fault: (clause, advice).
CLAUSES = {
    ("product", "empty"): ("is empty", None),
    ("product", "placeholder"): ("is a placeholder rather than a product", None),
    ("product", "invisible-character"): ("contains a line break, a tab or an invisible character", None),
    ("weight", "empty"): ("is empty", None),
    ("weight", "parenthesized-negative"): (
        "is a negative number written in parentheses, an accounting notation for a credit or return",
        "Delete that row rather than just removing the parentheses.",
    ),
    ("weight", "negative"): (
        "is negative, which usually means a credit or return",
        "Delete that row rather than just dropping the minus sign.",
    ),
    ("weight", "money"): ("is money", "Check you mapped the right column."),
    ("weight", "scientific"): (
        "is in scientific notation, so the exact figure is already lost",
        "Format the column as a number.",
    ),
    ("weight", "has-a-unit"): (
        "has a unit in it",
        "Enter plain numbers only — the lb or kg choice on the form sets the unit for the whole file.",
    ),
    ("weight", "not-a-number"): ("is not a number", None),
    ("weight", "comma-decimal"): ("has a comma we cannot read", "Use a period for the decimal point."),
    ("weight", "not-plain"): ("is not a plain number, such as 12 or 1234.50", None),
    ("weight", "too-many-digits"): ("has too many digits to be real", None),
    ("date", "empty"): ("is empty", None),
    ("date", "unknown-month-name"): ("has a month name we do not recognise", None),
    ("date", "date-serial"): (
        "looks like an unconverted date serial",
        "Format the column as a date in your spreadsheet and save it again.",
    ),
    ("date", "unrecognized"): ("is not a date we recognise", "Use YYYY-MM-DD."),
    ("date", "not-a-real-date"): ("is not a real calendar date", None),
    ("date", "too-old"): (f"is before {EARLIEST_DATE}", None),
    ("date", "too-far-ahead"): (f"is more than {MAX_FUTURE_DAYS} days from now", None),
}
FORMULA_RULE = "The product starts with =, +, -, or @, which spreadsheets treat as the start of a formula"
ORDER_ADVICE = "Re-save the date column as YYYY-MM-DD and upload again."
HEADER_LABELS = {"product": "product name", "date": "date ordered", "weight": "weight"}

# Vocabularies.
ATTEMPT_STATUSES = ["pending", "processing", "succeeded", "failed", "canceled"]
TERMINAL = ["succeeded", "failed", "canceled"]
FAILURE_CLAIMANTS = {
    "child_crashed": "parent",
    "contract_violation": "either",
    "hard_timeout": "parent",
    "hung": "parent",
    "infrastructure": "parent",
    "unknown": "either",
    "upstream_api": "child",
    "abandoned": "parent",
    "shut_down": "parent",
    "unusable_data": "child",
}
# class: reason, in the order in which a child asks whether an error is one; any other is unknown
CHILD_ERRORS = {
    "UpstreamApiError": "upstream_api",
    "UnusableDataError": "unusable_data",
    "InvalidInputError": "contract_violation",
    "ContractError": "contract_violation",
}
INTERRUPTED = "Something on our end interrupted the analysis before it could finish."
FOLLOW_UP_RETRY = (
    "This was not a problem with your file. You can run it again without uploading it a second time, "
    "or contact us if it keeps happening."
)
FOLLOW_UP_REPORT = (
    "This was not a problem with your file. Retrying is unlikely to help, so contact us and we will look into it."
)
FOLLOW_UP_FILE = "Retrying is unlikely to help. Contact us and we can help figure out what to change."
# reason: (what happened, next step, its text)
FAILURE_EXPLANATIONS = {
    "child_crashed": (INTERRUPTED, "retry", FOLLOW_UP_RETRY),
    "hung": (INTERRUPTED, "retry", FOLLOW_UP_RETRY),
    "hard_timeout": ("The analysis took too long, so we stopped it.", "retry", FOLLOW_UP_RETRY),
    "infrastructure": (INTERRUPTED, "retry", FOLLOW_UP_RETRY),
    "contract_violation": ("The analysis finished in a state we could not read.", "contact", FOLLOW_UP_REPORT),
    "upstream_api": (INTERRUPTED, "retry", FOLLOW_UP_RETRY),
    "abandoned": (INTERRUPTED, "retry", FOLLOW_UP_RETRY),
    "unknown": (INTERRUPTED, "retry", FOLLOW_UP_RETRY),
    "shut_down": (INTERRUPTED, "retry", FOLLOW_UP_RETRY),
    "unusable_data": ("We could not make a usable report from this file.", "contact", FOLLOW_UP_FILE),
}
COUNTS_BASES = ["people", "meals"]
UNIT_SYSTEMS = ["lb", "kg"]
ROLES = ["member", "admin"]
INVITE_STATUSES = ["pending", "accepted", "declined", "revoked", "expired", "superseded"]
AUDIT_ACTOR_KINDS = ["user", "superadmin", "system"]
RESULT_KINDS = {
    "pdf": ("pdf", "application/pdf"),
    "xlsx": ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    "chart": ("png", "image/png"),
}
REJECTION_REASONS = ["invalid_metadata", "too_large", "bad_columns", "unparseable", "empty", "bad_rows", "other"]
TRANSIENT_SQL_STATES = ["40001", "40P01", "53200", "53300", "57014", "57P01", "57P02", "57P03", "57P05"]
TRANSIENT_SYSCALLS = ["EAI_AGAIN", "ECONNREFUSED", "ECONNRESET", "EHOSTUNREACH", "ENETUNREACH", "ENOTFOUND", "EPIPE", "ETIMEDOUT"]
TRANSIENT_MESSAGES = [
    "Connection terminated unexpectedly",
    "Connection terminated due to connection timeout",
    "timeout exceeded when trying to connect",
    "Client has encountered a connection error and is not queryable",
    "Query read timeout",
]
PERMISSIONS = {
    "Upload a new report": ["member", "admin"],
    "Read all org reports": ["member", "admin"],
    "Delete their own reports": ["member", "admin"],
    "Leave an organization": ["member", "admin"],
    "Create a new organization": ["member", "admin"],
    "Rename themself": ["member", "admin"],
    "Change their email": ["member", "admin"],
    "Delete their account": ["member", "admin"],
    "Delete any report in the org": ["admin"],
    "Invite a new user to the org": ["admin"],
    "Remove a user from the org": ["admin"],
    "Promote a member to admin": ["admin"],
    "Demote an admin to member": ["admin"],
    "Rename the organization": ["admin"],
    "Delete the organization": ["admin"],
}
