"""Fixed values of the data model.

Everything here is part of the contract: results change if a value changes.
"""

# Work-item states, in life-cycle order.
STATUSES = ("Pending", "InProgress", "Blocked", "Complete")
DEFAULT_STATUS = "Pending"
DONE_STATUS = "Complete"

# A new item cannot be created without these, checked in this order.
REQUIRED_ON_CREATE = ("name", "domain", "description")
MISSING_FIELD_TEXT = "New feature '%s' requires '%s' field"

# Name given to a project nobody has named yet.
DEFAULT_PROJECT_NAME = "My Project"

# Recency: half of the score is lost every seven days. LN_2 has six digits on purpose.
HALF_LIFE_SECONDS = 604800.0
LN_2 = 0.693147
SCORE_FLOOR = 0.01
SCORE_CEILING = 1.0
INITIAL_SCORE = 1.0

# Directory names whose contents never count, at any depth.
SKIP_DIRS = (
    ".git",
    ".taskfold",
    "target",
    "node_modules",
    ".vscode",
    ".idea",
    "build",
    "bin",
)

# Top-level directories whose sub-directories may become suggested items.
SOURCE_ROOTS = ("src", "lib", "app", "pkg")
MIN_SUGGESTION_FILES = 2

# Domain of a directory name: the first group with a word that occurs in the name.
DOMAIN_WORDS = (
    ("security", ("auth", "login", "session")),
    ("api", ("api", "routes", "endpoints")),
    ("storage", ("db", "storage", "models", "schema")),
    ("ui", ("ui", "components", "views", "pages")),
    ("testing", ("test", "spec")),
)

SUMMARY_EXTENSIONS = 5
NO_EXTENSIONS_TEXT = "none detected"

# Report column widths (characters kept before the cut mark).
REPORT_ID_WIDTH = 19
REPORT_DOMAIN_WIDTH = 13
CUT_MARK = ".."

# Size limits of one project, used by the audit and by the nested documents.
MAX_FEATURES = 1000
MAX_FILES = 5000
MAX_PATH_CHARS = 512
MAX_DESCRIPTION_CHARS = 2048
ARCHIVE_AFTER_DAYS = 90
TOP_BY_RECENCY = 20
