"""Word lists, labels, patterns and limits that decide the results.

Everything here is data, listed in natural order, and is the default of a
parameter somewhere else.  Nothing in this module computes.
"""

# --- record layout -----------------------------------------------------------

INFO_KEYS = [
    "ten",
    "tuoi",
    "email",
    "dien_thoai",
    "vi_tri",
    "hoc_van",
    "kinh_nghiem",
    "dia_chi",
    "ky_nang",
]

COL_SENT = "Thời gian nhận"
COL_SOURCE = "Nguồn"

# record column <- info key, in record order (after the two columns above)
RECORD_FROM_INFO = {
    "Vị trí": "vi_tri",
    "Họ tên": "ten",
    "Tuổi": "tuoi",
    "Email": "email",
    "Điện thoại": "dien_thoai",
    "Địa chỉ": "dia_chi",
    "Học vấn": "hoc_van",
    "Kinh nghiệm": "kinh_nghiem",
    "Kỹ năng": "ky_nang",
}

RECORD_COLUMNS = [COL_SENT, COL_SOURCE, *RECORD_FROM_INFO]

# --- field extraction --------------------------------------------------------

LABELS = {
    "ten": ["Họ tên", "Tên"],
    "tuoi": ["Tuổi", "Age"],
    "vi_tri": ["Vị trí", "Position"],
    "hoc_van": ["Học vấn", "Education"],
    "kinh_nghiem": ["Kinh nghiệm", "Experience"],
    "dia_chi": ["Địa chỉ", "Address"],
    "ky_nang": ["Kỹ năng", "Skills", "Skill"],
}
LABEL_SEPARATOR = r"[:\-\s]+"
REST_OF_LINE = r"([^\n]+)"
UP_TO_THREE_DIGITS = r"(\d{1,3})"
EMAIL_LOCAL_SIGN = r"[a-zA-Z0-9_.+-]"
EMAIL_HOST = r"@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_PATTERN = r"(\+?\d[\d\-\s]{7,}\d)"

# --- intake ------------------------------------------------------------------

DOCUMENT_SUFFIXES = [".pdf", ".docx"]
OBVIOUS_NAME_WORDS = ["cv", "resume", "curriculum", "vitae"]
DEFAULT_KEYWORDS = ["CV", "Resume", "Curriculum Vitae"]
RECENT_MESSAGES = 100
FETCH_BATCH = 100
POLL_SECONDS = 600

# zone names a mail date may carry, as offsets
MAIL_ZONES = {
    "UT": "+0000",
    "UTC": "+0000",
    "GMT": "+0000",
    "Z": "+0000",
    "AST": "-0400",
    "ADT": "-0300",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}

# --- model answers -----------------------------------------------------------

TEXT_BUDGET = 8000
TRUNCATION_MARK = "...[text truncated]"
MAX_ATTEMPTS = 3
QUOTA_WORDS = ["quota", "429", "resource_exhausted", "rate limit"]
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
BARE_OBJECT = r"(?s)(\{.*\})"
FENCED_ARRAY = r"(?s)```json\s*(.+?)\s*```"
BARE_ARRAY = r"(?s)(\[\s*\{.+?\}\s*\])"
TOP_SOURCES = 5

# --- questions, answers, logs ------------------------------------------------

QUESTION_CLASSES = [
    ("search", ["tìm", "kiếm", "search", "find"]),
    ("statistics", ["thống kê", "stats", "count", "số lượng"]),
    ("comparison", ["so sánh", "compare", "khác nhau"]),
    ("summary", ["tóm tắt", "summary", "overview"]),
    ("skills", ["kỹ năng", "skill", "năng lực"]),
    ("experience", ["kinh nghiệm", "experience", "công việc"]),
    ("education", ["học vấn", "education", "bằng cấp"]),
]
DEFAULT_QUESTION_CLASS = "general"

TIME_PHRASES = [
    "bây giờ",
    "mấy giờ",
    "thời gian hiện tại",
    "current time",
    "current date",
    "ngày bao nhiêu",
    "hôm nay",
]

POSITIVE_WORDS = ["tìm thấy", "có", "thành công", "được"]
NEGATIVE_WORDS = ["không", "chưa", "thiếu"]
POSITIVE_MARK = "✅ "
NEGATIVE_MARK = "ℹ️ "
MOOD_MIN_LENGTH = 50
FACE_EMOJI = "[😀-🙏]"
BULLET = "• "
FILE_MENTION = r"([\w\s.-]+\.(?:pdf|docx?))"

CONTEXT_MESSAGES = 10
CONTEXT_EXCHANGES = 5
CHAT_LOG_HIGH, CHAT_LOG_LOW = 1000, 800
SESSION_LOG_HIGH, SESSION_LOG_LOW = 500, 400

ROLE_LABELS = {"user": "👤 Bạn"}
OTHER_ROLE_LABEL = "🤖 AI"

# --- checks ------------------------------------------------------------------

PREFIX_RULES = [
    ("openrouter", ["sk-or-", "or-"]),
    ("google", ["AIza"]),
    ("vectorshift", ["vs-", "vectorshift"]),
]
# provider, form of its keys, length they exceed
KEY_RULES = [
    ("google", "^AIza", 10),
    ("openrouter", "^sk-or-", 20),
    ("vectorshift", "(?i)^vs-|vectorshift", 10),
]
KEY_LENGTH = 10
WARNING_SHARE = 0.8
COLUMN_WIDTH_PADDING = 2
COLUMN_WIDTH_MAX = 50

# characters Python's str.strip removes
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
