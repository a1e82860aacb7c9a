"""Fixed values of the data model. The numbers are stored in tables, so they never change."""

# Chunk kinds.
KIND_UNKNOWN = 0
KIND_TITLE = 1
KIND_FOLDER = 2
KIND_LAST_PROMPT = 3
KIND_USER_PROMPT = 4
KIND_ASSISTANT_TEXT = 5
KINDS = (0, 1, 2, 3, 4, 5)

# Where a title came from.
TITLE_UNKNOWN = 0
TITLE_CUSTOM = 1
TITLE_AI = 2
TITLE_FIRST_PROMPT = 3
TITLE_FILE_NAME = 4

# Where a folder came from.
FOLDER_UNKNOWN = 0
FOLDER_TRANSCRIPT = 1

# Record types that are read, and those that only move the activity bounds.
READ_TYPES = ("user", "assistant", "custom-title", "ai-title", "last-prompt")
IGNORED_TYPES = (
    "attachment", "system", "mode", "queue-operation", "atis-latch",
    "bridge-session", "pr-link", "frame-link", "file-history-snapshot", "file-history-delta",
)
UNKNOWN_TYPE = "unknown"

# Text limits, in characters.
TITLE_LENGTH = 80
STORED_CANDIDATE_LENGTH = 512
CHUNK_LENGTH = 8192
KEY_PROMPT_LENGTH = 160
DESCRIPTION_LENGTH = 180
OUTCOME_LENGTH = 400
KEY_PROMPT_COUNT = 3
QUICK_PROMPT_LIMIT = 2
EARLIER_TITLE_LIMIT = 4
ELLIPSIS = "…"

# Search defaults.
KIND_WEIGHTS = {1: 8.0, 2: 2.0, 3: 3.0, 4: 1.5, 5: 0.6}
OTHER_WEIGHT = 1.0
CO_OCCURRENCE_WEIGHT = 2.0
REPEAT_WEIGHT = 0.0
RECENCY_WEIGHT = 0.6
RECENCY_DECAY_DAYS = 30.0
CANDIDATE_LIMIT = 200
RESULT_LIMIT = 30
MINIMUM_QUERY_LENGTH = 2
SNIPPET_TOKENS = 12
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6

# Recap and change-coalescing defaults.
DAY_START_HOUR = 4
LOOKBACK_DAYS = 4
SETTLE_SECONDS = 2
MAX_WAIT_SECONDS = 20

# A chunk is identified by (session_id, chunk_no). chunk_no = seq * 2^28 + position inside the record:
# one record is one text cell (below 2 GB), so it cannot hold 2^28 pieces.
CHUNK_NO_SHIFT = 28
