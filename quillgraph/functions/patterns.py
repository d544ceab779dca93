"""Words and patterns that results depend on, in the order in which they are tried. Code and SQL read them here."""

# Words that carry no meaning in a query.
STOPWORDS = [
    "a", "an", "the", "and", "or", "of", "in", "on", "to", "is", "are", "how",
    "it", "connects", "show", "me", "with", "for", "this", "that", "be", "as",
    "was", "has", "have", "had", "will", "would", "could", "should", "but", "not",
    "from", "by", "at", "which", "what", "when", "where", "who", "its", "also",
]

# Query modes.
SYNTHESIS = r"\b(summarize|summarise|overview|compare|comparison|differences?|similarities|types of|kinds of|list all|explain all|what are (all|the different)|how does .{0,30} relate|survey|landscape|categories|taxonomy|outline)\b"
EXPLORATORY = r"\b(explore|discover|what else|tell me (more|everything) about|what do you know about|give me an? (overview|summary|introduction))\b"

# Temporal intent, and the years of a range.
CURRENT_STATE = r"\b(latest|current|now|today|recent|modern|contemporary)\b"
HISTORICAL_FACT = r"\b(19|18|17|16|15)\d{2}\b|\b(history|historical|era|ancient|medieval|century)\b"
BEFORE_YEAR = r"\bbefore\s+((?:19|20)\d{2})\b"
AFTER_YEAR = r"\bafter\s+((?:19|20)\d{2})\b"
DECADE = r"\b((?:19|20)\d{2})s\b"
SINGLE_YEAR = r"\b((?:19|20)\d{2})\b"

# Paragraphs that are structural noise.
SEPARATOR = r"^[-=|#\s*_~`]+$"
PLACEHOLDER = r"^\[\.{2,}.*\]$"
TOC_ANCHOR = r"#{2,}"
TOC_RULE = r"[-|]{2,}"
HEADING_FENCE = r"^#{3,}\s"
LEAST_LETTERS = 3
FOOTNOTE_MARK = r"^[*†‡\d]\s+[A-Z]"
AFFILIATION = r"(?i)university|institute|school|department|college|faculty"
TIMELINE = r"(?i)^(Date of (receipt|delivery|revision|approval)|Received:|Accepted:|Published online:)"
SOURCE_NOTE = r"(?i)^(Source|Note):\s"
SOURCE_NOTE_CHARS = 200
PAGE_AND_NAME = r"^\d+\s+[A-Z][A-Za-z\s&]+$"

# Section titles that are page furniture (also PAGE_AND_NAME).
LEAST_TITLE = 4
TITLE_CHARS = 60
TITLE_SHAPE = r"^[A-Z][A-Za-z\s&:,\-\.]+$"
TITLE_CONNECTIVES = r"\b(is|are|was|were|has|have|of|and|the|in|for|with|by|on|at|an|a)\b"
PUBLISHING = r"(?i)\b(journal|review|proceedings|transactions|conference|bulletin|annals|quarterly|gazette|press|publications?)\b"

# Machine-made identifiers.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
OPAQUE_CHARS = 20
HEX = r"(?i)^[0-9a-f]{16,}$"
ALPHANUMERIC = r"^[A-Za-z0-9]+$"
VOWEL = r"(?i)[aeiou]"
VOWEL_SHARE = 0.15

# Tables of contents and glossaries.
TOC_LINE = r"(?i)^[-*]\s+\[.+\]\(#.+\)|^\s*(chapter|section|part|appendix)?\s*\d+[\d.]*\s+.{3,}[.\s]{4,}\d+\s*$"
TOC_HEADING = r"(?i)^#{1,4}\s+(table\s+of\s+contents?|contents?|toc)\b"
TOC_LINK = r"\[(.+?)\]\(#.+?\)"
TOC_BOLD = r"^(\d+)\.\s+\*{1,2}([^*]+?)[.*\s]+\*{0,2}\s*$"
TOC_DOTTED = r"^(.+?)\s*[.\s]{4,}\s*(\d+)\s*$"
TOC_BOLD_PAGE = r"^\*{1,2}[^*]*?(\d+)\s*\*{0,2}\s*$"
TOC_NUMBERED = r"^\s*\d[\d.]*\s+(.+?)\s*[.\s]{4,}\s*(\d+)\s*$"
GLOSSARY_HEADING = r"(?i)^#{1,4}\s+(glossary|terms\s*(&amp;|&|and)?\s*definitions?|abbreviations|key\s+terms)"
GLOSSARY_BOLD = r"^\*{1,2}(.+?)\*{1,2}\s*[-:]\s*(.+)"
GLOSSARY_COLON = r"^([^|:]{2,40})\s*:\s{1,4}(.{5,})"
GLOSSARY_TABLE = r"^\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|"

# HTML: parts that are dropped, tags that break a line, and named entities (others become a space).
FURNITURE = ("script", "style", "nav", "header", "footer")
BLOCK_TAGS = ("p", "div", "br", "section", "article", "main", "aside", "blockquote", "tr")
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "nbsp": " ", "quot": '"', "apos": "'"}
