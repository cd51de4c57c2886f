"""Word lists, patterns, thresholds and formats that define the results.

Everything in this module is a constant of the document format being computed,
kept together so that the operators contain only logic.
"""

# Characters removed when a text is stripped.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Element types.
SECTION_TYPES = ["title", "heading", "subheading", "abstract", "references"]
NON_TEXT_TYPES = ["table", "figure", "equation", "header", "footer", "page_number"]
REFERENCE_STOP_TYPES = ["heading", "title", "appendix"]
REFERENCE_HEADERS = ["references", "bibliography", "works cited"]

# Level of an element in the section tree; anything not listed is 3.
TREE_LEVELS = {
    "title": 0,
    "heading": 1,
    "subheading": 2,
    "abstract": 1,
    "references": 1,
    "appendix": 1,
    "paragraph": 3,
    "table": 3,
    "figure": 3,
    "equation": 3,
    "caption": 4,
    "citation": 4,
    "authors": 1,
    "header": 5,
    "footer": 5,
    "page_number": 5,
    "unknown": 3,
}

# Chunking.
SENTENCE_BOUNDARY = r"(?<=[.!?])(?U:\s+)(?=[A-Z0-9])"
MAX_TOKENS = 512

# In-text citations.
NUMERIC_CITATION = r"\[([0-9]+(?:(?U:\s*)[,;–-](?U:\s*)[0-9]+)*)\]"
AUTHOR_YEAR_CITATION = (
    r"\(([A-Z][a-zA-Z]+(?:(?U:\s+)(?:et(?U:\s+)al\.?|and|&)(?U:\s+)[A-Z][a-zA-Z]+)?"
    r"(?:(?U:\s*),(?U:\s*)[0-9]{4})?)\)"
)
INLINE_CITATION = r"([A-Z][a-zA-Z]+(?:(?U:\s+)et(?U:\s+)al\.?)?)(?U:\s+)\(([0-9]{4})\)"
CITATION_CONTEXT = 50

# Bibliography entries.
NUMBERED_REFERENCE = r"^\[([0-9]+)\](?U:\s*)([^\n]+)"
YEAR = r"(?U)\b((?:19|20)[0-9]{2})\b"
DOI = r"(?i)(?:doi:(?U:\s*)|https?://doi\.org/)(10\.[0-9]{4,}/(?U:\S+))"
URL = r"https?://(?U:\S+)"
ARXIV = r"(?i)arXiv:([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"
ARXIV_URL = "https://arxiv.org/abs/"
AUTHOR_SEPARATOR = r"(?U)\s*(?:,\s*and\s+|,\s*&\s*|\s+and\s+|\s*;\s*|,\s*)"

# Equations.
DISPLAY_MATH = (
    r"(?s)\$\$(.+?)\$\$"
    r"|\\begin\{(?:equation|align|gather|multline|eqnarray)\*?\}(.+?)"
    r"\\end\{(?:equation|align|gather|multline|eqnarray)\*?\}"
)
INLINE_MATH = r"(?<!\$)\$(?!\$)([^\n]+?)(?<!\$)\$(?!\$)"
EQUATION_LABEL = r"\((?U:\s*)[A-Za-z]?[0-9]+(?:\.[0-9]+)?(?U:\s*)\)(?U:\s*)$"
MATH_OPERATOR = "[=<>≤≥≠±∓∑∏∫∂∇≈∝∞→←↔⊂⊃∈∉∪∩⊕⊗]"
GREEK_LETTER = "[αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ]"
FUNCTION_CALL = r"(?U)\b[a-zA-Z]\s*\([a-zA-Z0-9,\s|]+\)"
SUB_OR_SUPERSCRIPT = r"[_\^]\{[^\n]*?\}|[_\^][a-zA-Z0-9]"
LATEX_COMMAND = (
    r"(?U)\\(?:frac|sqrt|sum|prod|int|lim|log|exp|sin|cos|tan|max|min|sup|inf"
    r"|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|omega|phi|psi"
    r"|mathbb|mathcal|mathbf|mathrm|mathit|text|operatorname"
    r"|left|right|big|Big|bigg|Bigg"
    r"|cdot|times|div|pm|mp|leq|geq|neq|approx|equiv|sim|propto"
    r"|infty|partial|nabla|forall|exists|in|notin|subset|supset"
    r"|cup|cap|oplus|otimes|vec|hat|bar|tilde|dot)\b"
)
VARIABLE = r"(?U)\b([a-zA-Z](?:_\{[^}]+\}|_[a-zA-Z0-9])?)\b"
NOT_VARIABLES = [
    "and", "or", "not", "the", "for", "all", "any", "let", "if",
    "then", "else", "where", "with", "from", "into", "over", "under",
    "sin", "cos", "tan", "log", "exp", "lim", "max", "min", "sup", "inf",
    "frac", "sqrt", "sum", "prod", "int", "text", "mathrm", "mathbf",
    "left", "right", "big", "cdot", "times", "div",
]
LATEX_REPLACEMENTS = [
    ("∈R", r"\in \mathbb{R}"),
    ("∈ R", r"\in \mathbb{R}"),
    ("Proj (", r"\text{Proj}("),
    ("Enc (", r"\text{Enc}("),
    ("Aug (", r"\text{Aug}("),
    ("exp (", r"\exp("),
    ("•", r"\cdot"),
]
MIN_MATH_SCORE = 0.55
HEURISTIC_MAX_CHARS = 250

# Page regions.
REGION_BY_TYPE = ["table", "figure", "equation", "caption", "header", "footer", "page_number"]
CAPTION_START = r"(?iU)^(?:Figure|Fig\.?|Table|Tab\.?|Equation|Eq\.?)\s*\d+"
REGION_OPERATOR = "[=<>≤≥≠±∓∑∏∫∂∇]"
REGION_LATEX = (
    r"(?U)\\(?:frac|sqrt|sum|int|prod|lim|log|exp|sin|cos|tan|alpha|beta|gamma|theta|lambda"
    r"|sigma|delta|omega|phi|psi|epsilon|mu|pi|infty|partial|nabla|mathbb|mathcal|mathbf"
    r"|mathrm|begin|end)\b"
)
REGION_FUNCTION = r"(?U)\b[a-zA-Z]\s*\(\s*[a-zA-Z]\s*\)"
REGION_ARITHMETIC = r"(?U)\b\d+\s*[\+\-\*/\^]\s*\d+"
REGION_GREEK = "[αβγδεζηθικλμνξπρστυφχψω]"
HEADER_Y = 0.06
FOOTER_Y = 0.94
MARGIN_FONT = 10.0
REGION_GAP = 0.02

# Captions, figures and tables.
TABLE_MENTION = (
    r"(?iU)^Table\s+\d+\s+(?:shows|compares|presents|reports|displays|lists|gives|illustrates"
    r"|demonstrates|is|was|were|can|contains|uses)\b"
)
TABLE_CAPTION = r"(?iU)^Table\s+\d+[:.\-]"
TABLE_START = r"(?iU)^Table\s+\d+"
FIGURE_TYPES = [
    ("architecture", ["architecture", "framework", "system", "pipeline", "workflow"]),
    ("bar_chart", ["bar chart", "bar graph", "histogram"]),
    ("line_chart", ["line chart", "line graph", "trend", "time series", "curve"]),
    ("scatter_plot", ["scatter", "correlation"]),
    ("heatmap", ["heatmap", "heat map", "confusion matrix"]),
    ("diagram", ["diagram", "flowchart", "flow chart", "schematic"]),
    ("photograph", ["photo", "photograph", "image", "micrograph", "microscopy"]),
    ("table_image", ["table"]),
]

# Section outline.
OUTLINE_HEADER = (
    r"(?i)^(abstract|references|bibliography|introduction|related work|background|methodology"
    r"|experiments|results|discussion|conclusion|appendix)"
)
OUTLINE_NUMBERED = r"^[0-9]+(\.[0-9]+)*(?U:\s+)[A-Z]"
OUTLINE_OVERVIEW = "Document Title & Author Metadata"

# Questions.
INTENTS = [
    ("summary", ["summarize", "summary", "overview", "tldr", "tl;dr", "abstract", "brief"]),
    ("table", ["table", "tabular", "row", "column", "cell", "dataset", "benchmark", "results table"]),
    ("figure", ["figure", "diagram", "image", "plot", "graph", "chart", "illustration", "architecture"]),
    ("equation", ["equation", "formula", "loss function", "math", "expression", "gradient", "latex"]),
    ("citation", ["cite", "citation", "citations", "reference", "references", "bibliography", "doi", "who wrote"]),
    ("research", ["compare", "comparison", "related work", "state of the art", "contribution", "novelty", "limitation"]),
]
DEFAULT_INTENT = "qa"
QUESTION_STOP_WORDS = (
    r"(?iU)\b(here|in|this|paper|manuscript|document|tell|me|which|were|present|what|is|are|the)\b"
)
OVERVIEW_QUESTION = "overview methodology results discussion abstract"
CITATION_QUESTION_PREFIX = "citations references bibliography "
# intent -> (hits wanted, chunk type searched first, hits wanted when that type has none)
RETRIEVAL_PLAN = [
    ("qa", 5, None, None),
    ("summary", 5, None, None),
    ("table", 3, "table", 5),
    ("figure", 3, "figure", 5),
    ("equation", 3, "equation", 5),
    ("citation", 6, None, None),
    ("research", 8, None, None),
]
SOURCE_TAG = r"(?iU)\[Source\s*([0-9]+)\]"
CONTEXT_SEPARATOR = "\n\n---\n\n"

# Embedding.
EMBEDDING_DIM = 384
WORD = r"[\p{L}\p{N}_]{2,}"

# Listing.
DEFAULT_TITLE = "Research Paper"
DEFAULT_AUTHORS = "Extracted Authors"
TEST_TITLE_MARKS = ["api_test", "sample.pdf"]
