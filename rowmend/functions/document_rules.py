"""Patterns and word lists for fields of marksheets and certificates."""

# A document is relevant when at least two of these occur in it.
RELEVANT_WORDS = (
    "university", "board", "council", "statement of marks", "marksheet", "admit card",
    "hall ticket", "roll", "registration", "seat number", "prn", "examination", "result",
    "percentage", "student", "course", "semester", "grade", "school", "college", "institute",
    "trade", "discipline", "apprenticeship", "degree", "diploma", "bachelor", "master",
    "ncvt", "iti", "industrial training", "b.com", "bachelor of commerce",
)
RELEVANT_MINIMUM = 2

PAGE_MARK = "--- Page"
VALUE_EDGES = " :-;,._"

# Roll number patterns, headings above a number, and values that are none.
ROLL_PATTERNS = (
    r"seat\s*number\s*[:\-]?\s*([A-Z0-9\/\-\s]+)",
    r"seat\s*no\.?\s*[:\-]?\s*([A-Z0-9\/\-\s]+)",
    r"roll\s*no\.?\s*[:\-]?\s*([A-Z0-9\/\-\s]+)",
    r"roll\s*[:\-]?\s*([A-Z0-9\/\-\s]+)",
    r"registration\s*no\.?\s*[:\-]?\s*([A-Z0-9\/\-\s]+)",
    r"enrollment\s*no\.?\s*[:\-]?\s*([A-Z0-9\/\-\s]+)",
    r"s\.i\.d\.\s*no\.?\s*[:\-]?\s*([A-Z0-9\/\-\s]+)",
)
ROLL_HEADINGS = ("seat no.", "seat no", "roll", "roll no", "roll no.", "s.i.d. no.")
ROLL_REJECTS = ("name", "centre", "center", "course", "code", "index", "number")

# Candidate name patterns and words that rule a line or value out.
NAME_PATTERNS = (
    r"candidate'?s?\s*name\s*[:\-]?\s*(.+)",
    r"student'?s?\s*name\s*[:\-]?\s*(.+)",
    r"name\s+of\s+the\s+candidate\s*[:\-]?\s*(.+)",
    r"shri\s*/\s*smt\.?\s*[:\-]?\s*(.+)",
    r"^name\s*[:\-]?\s*(.+)",
)
NAME_LINE_EXCLUDES = ("mother", "father", "guardian", "course", "institute", "university")
NAME_REJECTS = (
    "university", "board", "council", "school", "college", "institute", "course", "result",
    "examination", "admit",
)
NAME_LINE_REJECTS = ("university", "board", "college", "education", "distance")

# University lines.
UNIVERSITY_WORDS = ("university", "board", "council", "open university")
UNIVERSITY_REJECTS = ("admitted by", "members of", "recognised by", "chancellor")

# Course patterns, values that are no course, headings above one.
COURSE_PATTERNS = (
    r"statement of marks for (.+?) examination",
    r"discipline\s*[:\-]?\s*(.+)",
    r"stream\s*[:\-]?\s*(.+)",
    r"course\s*name\s*[:\-]?\s*(.+)",
    r"programme\s*[:\-]?\s*(.+)",
    r"degree\s*[:\-]?\s*(.+)",
    r"trade\s*[:\-]?\s*(.+)",
)
COURSE_REJECTS = ("name", "result", "pass", "fail", "centre", "center", "(theoretical)")
COURSE_HEADINGS = ("discipline", "stream", "course", "trade", "programme")

# Institute labels, the words an institute must contain, headings above one.
INSTITUTE_PATTERNS = (
    r"study\s*center\s*[:\-]?\s*(.+)", r"study\s*centre\s*[:\-]?\s*(.+)",
    r"exam\s*center\s*[:\-]?\s*(.+)", r"exam\s*centre\s*[:\-]?\s*(.+)",
    r"examination\s*centre\s*[:\-]?\s*(.+)", r"center\s*[:;\-]?\s*(.+)",
    r"centre\s*[:;\-]?\s*(.+)", r"institute\s*[:\-]?\s*(.+)",
    r"college\s*[:\-]?\s*(.+)", r"school\s*[:\-]?\s*(.+)",
)
INSTITUTE_REJECTS = ("(theoretical)", "practical", "code")
INSTITUTE_WORDS = (
    "school", "college", "institute", "center", "centre", "vidyapith", "academy", "secondary",
    "polytechnic", "campus",
)
INSTITUTE_HEADINGS = ("centre", "center", "school", "college", "institution")

# Status by whole word or phrase, first hit wins.
STATUS_RULES = (
    ("Needs Improvement", "needs improvement"),
    ("Pass", r"result: pass|\bpass\b|\bqualified\b"),
    ("Fail", r"result: fail|\bfail\b"),
    ("Promoted", r"\bpromoted\b"),
    ("Appeared", r"\bappeared\b"),
    ("Completed", r"\bcompleted\b"),
)
STATUSES = ("Pass", "Fail", "Completed", "Promoted", "Appeared", "Unknown", "Needs Improvement")
# How a free-text status is read, first hit wins.
STATUS_STEMS = (
    ("Pass", ("pass", "qualified")), ("Fail", ("fail",)), ("Completed", ("complete",)),
    ("Promoted", ("promot",)), ("Appeared", ("appear",)),
    ("Needs Improvement", ("needs improvement",)),
)

# Lines searched for a year before all others.
YEAR_LINE_WORDS = (
    "year of passing", "passing year", "date:", "dated", "examination", "statement of marks",
    "admit card", "result", "issued", "semester",
)
YEAR_PATTERN = r"\b(19\d{2}|20\d{2}|21\d{2})\b"

# Weights of the combined confidence and the review limit.
TEXT_WEIGHT, FIELD_WEIGHT, REVIEW_BELOW = 0.7, 0.3, 0.60
