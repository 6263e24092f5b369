"""Word lists, limits, labels and patterns that results depend on."""

# --- Fixed values: title and location rules -----------------------------------
TECHNICAL_WORDS = ("engineer", "developer")
MANAGEMENT_WORDS = ("manager", "director", "head", "vp", "vice president", "chief", "president")
SENIORITY_WORDS = (
    "senior", "sr", "staff", "principal", "lead", "architect",
    "distinguished", "iii", "iv", "l5", "l6", "l7",
)
LOCATION_ALIASES = {"bangalore": ("bangalore", "bengaluru")}
REMOTE_WORD = "remote"
HOME_COUNTRY = "india"

# --- Fixed values: funnel labels and report sizes -----------------------------
REASONS = ("excluded_company", "role", "seniority", "location")
TECH_KEYWORDS = (
    "engineer", "engineering", "developer", "development", "scientist",
    "analyst", "sde", "technical", "software", "data", "ml", "ai",
    "backend", "frontend", "platform", "devops", "security", "qa",
)
NO_LOCATION = "(none)"
TOP_LOCATIONS = 25
TOP_TITLES = 40

# --- Fixed values: sources ----------------------------------------------------
BOARD_A = "greenhouse"
BOARD_B = "lever"
SEARCH = "apify"
BOARD_B_URL_PATTERN = r"jobs\.lever\.co/([^/]+)/"
MAX_SEARCHES = 5
DEFAULT_MAX_ITEMS = 100
DEFAULT_MAX_PAGES = 2
RUN_SUCCEEDED = "SUCCEEDED"

# --- Fixed values: board probe ------------------------------------------------
PROBE_COUNTRY_OR_REMOTE = ("india", "remote")
PROBE_COUNTRY = ("india",)
PROBE_TITLE_WORDS = ("engineer", "developer")
SAMPLE_TITLES = 3

# --- Fixed values: scoring ----------------------------------------------------
MAX_DESCRIPTION_CHARS = 12000
NO_DESCRIPTION = "Not provided"
NOT_SPECIFIED = "Not specified"
NO_SKILLS = "None"
TEMPERATURE = 0
SCORE_MIN, SCORE_MAX = 0.0, 100.0
SCORE_BANDS = (
    (90.0, "exceptional match"),
    (75.0, "strong match"),
    (60.0, "reasonable match"),
    (40.0, "weak match"),
    (0.0, "poor match"),
)

# --- Fixed values: retries and waits ------------------------------------------
MAX_RATE_LIMIT_RETRIES = 6
MAX_OTHER_RETRIES = 3
RATE_LIMIT_ERROR = "RateLimitError"
RETRYABLE_ERRORS = ("APITimeoutError", "InternalServerError", "APIConnectionError")
WAIT_CAP_SECONDS = 60.0
WAIT_JITTER_SECONDS = 1.0
BACKOFF_SECONDS = 1.0
WAIT_MESSAGE_PATTERN = r"(?i)try again in\s+([\d.]+)\s*(ms|s)\b"

# --- Fixed values: run reports ------------------------------------------------
PRICED_MODEL = "gpt-4.1-mini"
PRICE_PER_MILLION_PROMPT = 0.40
PRICE_PER_MILLION_COMPLETION = 1.60
MIN_ROWS_TO_COMPARE = 30
MAX_ROWS_TO_COMPARE = 60
STOP_REASON = "Only {rows} jobs survived the filter (minimum {minimum} required)."

# --- Fixed values: sinks ------------------------------------------------------
CSV_COLUMNS = (
    "rank", "score", "title", "company", "location",
    "source", "url", "matched_skills", "missing_skills", "rationale",
)
NO_MATCHES_LINE = "No matching jobs found."
