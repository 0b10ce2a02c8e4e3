"""Word lists, patterns and constants that results depend on.

Patterns are written so that Java's regex and RE2 read them alike, unless a name ends in ``_JAVA``.
"""

# Stop words of the sparse index.
INDEX_STOP_WORDS = "a an and any are as at be been by for from has have in is it its of on or that the their there these this those to was were which will with".split()

# Stop words of question keywords.
KEYWORD_STOP_WORDS = "a an and are as at be by can do does for from how i if in is it long many me much my of on or the to what when which who will with you your".split()

TOKEN = "[a-z0-9]+"
COUNTED_TOKEN = r"[a-z0-9]+|[^\sa-z0-9]"

# Sentence and clause boundaries. Each splits at the white space after its marks.
CLAIM_MARKS = "[.!?]"
CHUNK_MARKS = "[.;:]"
QUOTE_SPLIT_JAVA = r"(?<=[.;])\s+(?=[A-Z0-9(])"
CLAUSE_START = r"(^|\s)(\d{1,2}\.\s|[a-z]\.\s|\([a-z]\)\s|\(\d{1,2}\)\s)"
CLAUSE_SPLIT_JAVA = r"(?=(?:^|\s)(?:\d{1,2}\.\s|[a-z]\.\s|\([a-z]\)\s|\(\d{1,2}\)\s))"

# Characters that can hide text: C0 and C1 controls but TAB and LF, zero-width marks, direction overrides.
HIDDEN = r"[\x{0}-\x{8}\x{B}-\x{1F}\x{7F}-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
ENCODED_BLOB = "[A-Za-z0-9+/=]{120,}"

# Screening families in their order.
INJECTION = [
    ("instruction-override", r"(?i)\b(?:ignore|disregard|forget|override|bypass)\b[^.?!]{0,40}?\b(?:previous|prior|earlier|above|all|any|your|the)\b[^.?!]{0,20}?\b(?:instruction|instructions|prompt|prompts|rule|rules|direction|directions|context|guardrail|guardrails|restriction|restrictions)\b"),
    ("system-prompt-exfiltration", r"(?i)\b(?:reveal|show|print|repeat|output|display|disclose|tell me|what (?:is|are))\b[^.?!]{0,40}?\b(?:system prompt|your prompt|your instructions|initial instructions|the prompt above|your rules|your configuration)\b"),
    ("role-reassignment", r"(?i)\b(?:you are now|from now on,? you|you must now be|assume the role of)\b|\b(?:act|behave|respond|talk)\s+as\s+(?:if|though)\s+you\b|\b(?:act|behave|respond)\s+as\s+(?:an?\s+)?(?:ai|a\.i\.|assistant|chatbot|language\s+model|llm|dan|jailbroken|unrestricted|unfiltered)\b|\bpretend\s+(?:to\s+be|that\s+you|you\s+are)\b|\broleplay\s+as\b|\bsimulate\s+being\b"),
    ("conversation-forgery", r"(?im)^\s*(?:###\s*)?(?:system|assistant|human)\s*:|<\s*/?\s*(?:system|assistant|im_start|im_end)\s*>|\[/?INST\]|<\|[^|>]{1,20}\|>"),
    ("grounding-subversion", r"(?i)\b(?:without|don'?t|do not|no need to|stop)\b[^.?!]{0,30}?\b(?:cit(?:e|ing|ations?)|sources?|the corpus|the documents|the context|grounding|refus(?:e|ing|al))\b|\b(?:answer|respond)\b[^.?!]{0,25}?\bfrom (?:your own |general |prior )?(?:knowledge|memory|training)\b|\bmake (?:it |them )?up\b|\bjust guess\b|\binvent (?:an? )?(?:answer|article|law)\b"),
    ("policy-evasion", r"(?i)\b(?:developer mode|dan mode|jailbreak|unrestricted mode|no (?:filters?|restrictions?|limits?)|admin (?:override|access|mode))\b"),
]
MAX_SIGNALS = 3
STANDALONE_WORDS = 6

# Scope rules: (name, signal, needs a tenancy term, pattern), in their order.
FOREIGN, FREE_ZONE, EMIRATE = "foreign-jurisdiction", "free-zone-jurisdiction", "other-emirate-tenancy"
SCOPE_RULES = [
    ("Saudi Arabia", FOREIGN, False, r"(?i)\bsaudi(?:\s+arabia\w*)?\b"),
    ("Qatar", FOREIGN, False, r"(?i)\bqatar\w*\b"),
    ("Oman", FOREIGN, False, r"(?i)\boman\b|\bomani\b"),
    ("Kuwait", FOREIGN, False, r"(?i)\bkuwait\w*\b"),
    ("Bahrain", FOREIGN, False, r"(?i)\bbahrain\w*\b"),
    ("Egypt", FOREIGN, False, r"(?i)\begypt\w*\b"),
    ("Jordan", FOREIGN, False, r"(?i)\bjordan\w*\b"),
    ("Lebanon", FOREIGN, False, r"(?i)\blebanon\b|\blebanese\b"),
    ("India", FOREIGN, False, r"(?i)\bindia\b|\bindian\s+labou?r\b"),
    ("Pakistan", FOREIGN, False, r"(?i)\bpakistan\w*\b"),
    ("the Philippines", FOREIGN, False, r"(?i)\bphilippines?\b|\bfilipino\b"),
    ("Singapore", FOREIGN, False, r"(?i)\bsingapore\w*\b"),
    ("Japan", FOREIGN, False, r"(?i)\bjapan\w*\b"),
    ("China", FOREIGN, False, r"(?i)\bchina\b|\bchinese\s+labou?r\b"),
    ("the UK", FOREIGN, False, r"(?i)\bunited\s+kingdom\b|\bbritish\s+(?:labou?r|employment)\b|\buk\s+employment\b"),
    ("the United States", FOREIGN, False, r"(?i)\bunited\s+states\b|\bus\s+(?:labor|employment)\s+law\b"),
    ("the European Union", FOREIGN, False, r"(?i)\beuropean\s+union\b|\beu\s+(?:labour|employment)\s+law\b"),
    ("the DIFC", FREE_ZONE, False, r"(?i)\bdifc\b|\bdubai\s+international\s+financial\s+cent(?:re|er)\b"),
    ("the ADGM", FREE_ZONE, False, r"(?i)\badgm\b|\babu\s+dhabi\s+global\s+market\b"),
    ("Abu Dhabi", EMIRATE, True, r"(?i)\babu\s+dhabi\b"),
    ("Sharjah", EMIRATE, True, r"(?i)\bsharjah\b"),
    ("Ajman", EMIRATE, True, r"(?i)\bajman\b"),
    ("Ras Al Khaimah", EMIRATE, True, r"(?i)\bras\s+al\s+khaimah\b|\brak\b"),
    ("Fujairah", EMIRATE, True, r"(?i)\bfujairah\b"),
    ("Umm Al Quwain", EMIRATE, True, r"(?i)\bumm\s+al\s+quwain\b"),
]
TENANCY_TERM = r"(?i)\b(?:tenan\w*|landlord\w*|lease\w*|rent\w*|eviction|ejari)\b"
MIN_LETTERS = 2

# Citations: label, unit, number.
CITATION = r"(?i)\[\s*([A-Za-z0-9][A-Za-z0-9 ._'\-]{1,60}?)\s*,\s*(Article|Art\.?|Section|Sec\.?|Clause|Paragraph|Para\.?|Page)\s*\(?\s*(\d{1,4})\s*\)?\s*\]"
MARKDOWN_NOISE = r"^\s*(?:[-*+•]|\d+[.)]|#{1,6})\s*"
MIN_CLAIM_WORDS = 6
REFUSAL_MARKER = r"(?i)\b(?:not covered by (?:the indexed corpus|the documents you added)|(?:do(?:es)?|did) not (?:contain|cover|address|mention|provide|include)|(?:is|are) not (?:covered|addressed|mentioned|included)|no (?:information|provision|article|passage)s? (?:in|about|on|that)|cannot (?:answer|be answered|determine|confirm) (?:this|that|from)|(?:the )?(?:provided |retrieved )?(?:context|passages?|corpus|documents?) (?:do(?:es)?n?'?t|do(?:es)? not) )"
REFUSAL_HEAD_CHARS = 600
OFFLINE_PASSAGES, SENTENCES_PER_PASSAGE = 3, 2

# Layout and headings of statutes.
ARTICLE_HEADING = r"(?i)^\s*Article\s*\(?\s*(\d{1,3})\s*\)?\s*[*†‡]?\s*[:.–—-]?\s*$"
CONTENTS_ENTRY = r"(?i)^\s*Article\s*\(?\s*(\d{1,3})\s*(?:[-–—]\s*(\d{1,3}))?\s*\)?\s*$"
INSTRUMENT_KIND = r"(?:Federal\s+)?(?:Decree[-\s]?Law|Cabinet\s+Resolution|Law|Decree|Resolution)"
INSTRUMENT_TITLE = rf"(?i)^\s*({INSTRUMENT_KIND})\s+No\.?\s*\(?\s*(\d{{1,4}})\s*\)?\s*of\s+(\d{{4}})\s*[*†‡]?\s*\d{{0,2}}\s*$"
INSTRUMENT_KEY = rf"(?i)({INSTRUMENT_KIND})\s+No\.?\s*\(?\s*(\d{{1,4}})\s*\)?\s*of\s+(\d{{4}})"
PAGE_FURNITURE = r"(?i)^\s*(?:page\s+\d+\s+of\s+\d+|\d{1,4})\s*$"
CONTENTS_HEADING = r"(?i)^\s*contents\s*$"
CONTENTS_PAGE_CELL = r"^\s*\d{1,4}\s*[-–—]\s*\d{1,4}\s*$"
CONTENTS_TRAILING_PAGE = r"[\s.·•]*\b\d{1,4}(?:\s*[-–—]\s*\d{1,4})?\s*$"
TITLE_MARKERS = "►▶•●▪»"
WIDE_GLYPH_RATIO, LIGATURES = 0.80, {"T": "Th"}
FURNITURE_RATIO, FULL_WIDTH_RATIO, GUTTER_RATIO, JUSTIFIED_RATIO = 0.90, 0.75, 0.02, 0.90
MAX_TITLE_CHARS, CENTRED_RATIO, CENTRED_WIDTH_RATIO, MIN_COLUMN_BLOCKS = 90, 0.10, 0.60, 4
ROW_TOLERANCE, ROW_QUANTUM, MAX_CONTENTS_SPAN, BODY_WIDTH_PERCENTILE = 3.0, 3.0, 50, 0.90
GLYPH_GAP, GLYPH_SAMPLES, GLYPH_CLUSTER = 0.25, 8, 3

# Headings of other documents, first match wins: markdown, dotted number, named unit, capitals.
HEADING_MARKDOWN = r"^#{1,6}\s+(.{1,120})$"
HEADING_NUMBERED = r"^(\d+(?:\.\d+)*)[.)]?\s+([A-Z][^.!?]{2,120})$"
HEADING_UNIT = r"^(?:ARTICLE|Article|SECTION|Section|CLAUSE|Clause)\s+([\dIVXLC]+)\s*[-—:.]?\s*(.{0,120})$"
HEADING_CAPITALS = r"^([A-Z][A-Z \d&',()/-]{3,80})$"
MIN_SECTION_CHARS, MAX_HEADING_CHARS = 40, 140

# Extraction.
HTML_SKIPPED = ["script", "style", "noscript", "svg", "head", "nav", "footer"]
HTML_BLOCKS = ["p", "div", "br", "li", "tr", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp"]
TEXT_SUFFIXES = [".txt", ".md", ".markdown", ".rst", ".csv", ".log"]
HTML_SUFFIXES = [".html", ".htm"]
MIN_TEXT_LAYER_CHARS = 40

# Evaluation.
QUALITY_FLOORS = [("hit_rate_at_5", 0.90), ("hit_rate_at_1", 0.70), ("mrr", 0.78), ("refusal_accuracy", 0.78)]
MAX_FALSE_REFUSALS = 0
BUDGET_MB, BUDGET_STAGES = 600, ["embedding", "reranker", "vectorstore"]
BUDGET_LINE = r"baked \[(\w+)].*?peak RSS (\d+(?:\.\d+)?) MB"
DEFAULT_PRICE = (3.00, 15.00)

# Wording by source profile: (profile, what the refusal says is not covering, what answers come from).
SOURCE_WORDING = [
    ("corpus", "the indexed corpus", "the legislation it has indexed"),
    ("workspace", "the documents you added", "the documents in this workspace"),
]
