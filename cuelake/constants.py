"""Tunable values of the timed-text operators. Results depend on them."""

MIN_LINE_DURATION = 0.5
GAP_BREAK = 1.5
NO_HARD_SPLIT_BELOW = 12
CHARS_PER_SECOND = 3.0
FRAGMENT_CJK_CHARS, FRAGMENT_LATIN_WORDS, FRAGMENT_LATIN_MAX_CHARS = 2, 2, 20
MERGE_FRAGMENT_GAP = 1.5
MIN_PIECE_CJK_CHARS, MIN_PIECE_LATIN_WORDS = 3, 1
CUE_CHAR_BUDGET_RATIO = 2
MERGE_GAP, MERGE_MAX_DURATION = 0.8, 7.0
MIN_CLAUSE_BREAK_RATIO = 0.4
UNPUNCTUATED_ABOVE = 0.5
MIN_MISS, MIN_UNDETECTED, LEVEL_SUSPICIOUS_DB = 2.0, 5.0, 12.0
SECOND_PASS_MIN_BLANK, SECOND_PASS_WINDOW = 15.0, 300.0
MAX_COMPRESSION, MIN_LOGPROB = 2.4, -1.0
COVERED_GAP_BRIDGE = 1.5
OVERLAP_TOLERANCE = 0.2
MIN_KEPT, MAX_ADDED_RATIO, MAX_ADDED_FLOOR = 0.6, 0.25, 2
REFINE_CHUNK_TOKENS, REFINE_MARKER, REFINE_FLOOR, REFINE_GIVE_UP = 1500, 6, 500, 3
MAX_INTERNAL_GAP, MAX_GAP_CEILING, GAP_PERCENTILE = 1.2, 2.5, 0.40
FRAGMENT_BUDGET_RATIO = 1.5
CONTEXT_LINES, TAIL_LINES = 2, 10
REVIEW_CHUNK_TOKENS, REVIEW_MARKER, REVIEW_FLOOR, REVIEW_GIVE_UP = 12000, 3, 2000, 2
MIN_SNIPPET_OVERLAP, MAX_RANGE_SHARE, MAX_RANGE_LINES = 0.6, 0.20, 60
ALIGNMENT_MIN_CORRELATION, ALIGNMENT_MIN_LINES = 0.45, 20
MAX_TERMS, MAX_TERM_CHARS = 300, 40
MAX_CHARS_PER_LINE, MAX_DURATION = 42, 6.0
BATCH_SIZE, CONTEXT_LIMIT = 200, 100_000
MIN_YIELD_RATIO = 0.01
KEEP_LOGS = 20
STALL_SECONDS = 60.0
FRAME_SECONDS = 5.0
# Endings of video files.
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "ts", "m2ts", "mpg", "mpeg", "rmvb", "m4v")
