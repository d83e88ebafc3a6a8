"""Fixed values.

Everything here must stay exactly as written for results to agree with
the original service: text patterns, labels, scoring constants and
request defaults.  Modules import them from here; nothing else in the
library hard-codes them.
"""

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Skill strings: trimmed, then split on a comma followed by optional whitespace.
SKILL_SEPARATOR = r",\s*"

# Title cleaning, applied in this order: remove bracketed parts, cut from the
# first hyphen to the end, keep only ASCII letters, these lower-case
# Vietnamese letters and whitespace; then strip and lower-case.
BRACKETED = r"\([^)]*\)"
HYPHEN_TAIL = r"-.*$"
VIETNAMESE_LOWER_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"

# Characters Python's str.isspace() treats as whitespace (Java regex class
# syntax); titles and keywords are stripped and split on these.
WHITESPACE_CLASS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# Title → profession scoring.
MAX_IGNORED_KEYWORD_LENGTH = 2  # keywords of at most this many characters are skipped
EXACT_MATCH_FACTOR = 2  # exact score = len(keyword) / len(title) * 2
MIN_PARTIAL_TOKEN_LENGTH = 4  # shorter keyword tokens only count on equality
PARTIAL_MATCH_SCORE = 0.7
MULTI_TOKEN_BONUS = 1.2  # several tokens and a match count of at least 2
MULTI_TOKEN_BONUS_MIN_MATCHES = 2
DEFAULT_THRESHOLD = 0.8
UNKNOWN_PROFESSION = "Unknown"

# Skill profile.
OTHER_SKILLS_LABEL = "Other Skills"
DEFAULT_PROFILE_LIMIT = 15

# Recommendation.
DEFAULT_TOP_SKILLS = 10
DEFAULT_RECOMMEND_LIMIT = 20

# Lookups: a limit that is not a number means this many rows.
DEFAULT_LOOKUP_LIMIT = 10
