"""They have to equal the published ones for results to match."""

from __future__ import annotations

DOMAINS = ("D1", "D2", "D3", "D4", "D5")

DOMAIN_SQS = {
    "D1": ("1.1", "1.2", "1.3"),
    "D2": ("2.1", "2.2", "2.3", "2.4", "2.5", "2.6", "2.7"),
    "D3": ("3.1", "3.2", "3.3", "3.4"),
    "D4": ("4.1", "4.2", "4.3", "4.4", "4.5"),
    "D5": ("5.1", "5.2", "5.3"),
}
ALL_SQS = tuple(sq for domain in DOMAINS for sq in DOMAIN_SQS[domain])

RAW_CODES = ("Y", "PY", "PN", "N", "NI")
JUDGMENTS = ("Low", "Some concerns", "High")
JUDGMENT_SHORT = {"L": "Low", "S": "Some concerns", "H": "High"}

# Thresholds and limits.
OVERALL_HIGH_SC_THRESHOLD = 3
RETRIEVAL_TOP_K = 5
RRF_K = 60
BM25_K1 = 1.5
BM25_B = 0.75
WEAK_RETRIEVAL_THRESHOLD = 0.35
QUOTE_VERIFY_THRESHOLD = 85
QUOTE_MIN_VERIFY_CHARS = 15
OUTCOME_MATCH_THRESHOLD = 0.85
QUOTE_SOFT_LIMIT = 1200
JUSTIFICATION_SOFT_LIMIT = 500
RAW_QUOTE_MAX = 4000
RAW_JUSTIFICATION_MAX = 1000
PREFIX_TOKEN_BUDGET = 4000
DOMAIN_TOKEN_BUDGET = 1500
SUPPLEMENT_TOKEN_BUDGET = 2000
METADATA_TOKEN_BUDGET = 3000
DOMAIN_TEXT_MIN_CHARS = 500
MIN_CANONICAL_SECTION_CHARS = 500
LARGE_SEGMENT_CHARS = 6000
TAG_SCAN_CHARS = 300
PARSE_WINDOW_PAGES = 20
DOCTYPE_SCAN_PAGES = 10
MIN_SEGMENTS = 3
MIN_SEGMENT_CHARS = 60
MAX_SEGMENTS_PER_DOC = 80
MAX_ANNOTATIONS_PER_DOC = 40
UNKNOWN_TYPE_ANNOTATIONS = 5
ANNOTATION_PREAMBLE_WORDS = 500
MAX_OUTCOMES = 10
SPARSE_MARKDOWN_RATIO = 0.6
REASONING_MAX_TOKENS = 1536
REASONING_RESERVE_TOKENS = 512
SQ_MAX_TOKENS = 4096
DEFAULT_CONTEXT_WINDOW = 131072
ZONE_SHARES = {"shared_prefix": 0.60, "domain_text": 0.25, "supplement_block": 0.15, "metadata": 0.30}
ZONE_LEGACY_BUDGETS = {"shared_prefix": 4000, "domain_text": 1500, "supplement_block": 2000, "metadata": 3000}
SKIP_OUTCOME = "__TRIAL__"
SKIP_EFFECT = "__NA__"
RESULT_KEY = ("trial_id", "outcome", "effect_of_interest", "model_sq", "pipeline_version")
BOOTSTRAP_ITERATIONS = 200

# Patterns.
NCT_PATTERN = r"(?i)\bNCT\d{8}\b"
TOKEN_PATTERN = r"[A-Za-z0-9][A-Za-z0-9_.-]*"
FLOW_PATTERN = (
    r"(?i)\b(randomi[sz]ed|assessed for eligibility|discontinued|lost to follow-up|analy[sz]ed"
    r"|withdrew|withdrawn|withdrawal|N\s*=\s*\d+)\b"
)
STRUCTURED_CONTENT_PATTERN = (
    r"(?i)\b(figure|fig\.?|diagram|consort|table|missing|lost to follow-up|withdrew|withdrawal|randomi[sz]ed)\b"
)
TABLE_CONTENT_PATTERN = r"(?i)\b(table|col\d+|missing|total)\b|[|]\s*---"
STRUCTURED_TERMS = ("randomized", "randomised", "follow-up", "withdrew", "withdrawal")
JUNK_HEADING_PATTERNS = (
    r"(?i)^PAGE\s+\d+\s+OF\s+\d+$",
    r"(?i)^WINDOW[ _]\d+$",
    r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
    r"^[A-Z][A-Z0-9_ /-]{0,30}:$",
)
FORM_LABELS = (
    "COMMENT", "COMMENTS", "DATE", "EMAIL", "FAX", "FROM", "ID", "NAME", "NOTE", "NOTES", "PHONE",
    "SIGNATURE", "SUBJECT", "TO",
)
NO_RISK_ANNOTATION = "No risk-of-bias relevant content."
NA_JUSTIFICATION = "Structurally not applicable under the RoB 2 branching rules."
FAILED_JUSTIFICATION = "No information was recorded because the signaling-question call failed."

# Section labels.
CANONICAL_SECTION_LABELS = (
    "ABSTRACT", "BACKGROUND", "INTRODUCTION", "METHOD", "METHODS", "MATERIALS AND METHODS",
    "PATIENTS AND METHODS", "PARTICIPANTS AND METHODS", "STATISTICAL ANALYSIS", "RESULT", "RESULTS",
    "DISCUSSION", "CONCLUSION", "CONCLUSIONS", "REFERENCES", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS",
    "SUPPLEMENTARY MATERIAL",
)
TOP_LEVEL_SECTION_LABELS = tuple(label for label in CANONICAL_SECTION_LABELS if label != "STATISTICAL ANALYSIS")
METADATA_LABELS = {
    "abstract": ("ABSTRACT", "SUMMARY"),
    "methods": (
        "METHOD", "METHODS", "MATERIALS AND METHODS", "PATIENTS AND METHODS", "PARTICIPANTS AND METHODS",
    ),
}
PREFIX_SECTION_PRIORITY = ("METHODS", "RESULTS")

# Domain keywords (substring tests, so "itt" also meets "committee").
SECTION_KEYWORDS = {
    "D1": ("random", "randomisation", "randomization", "allocation", "concealment", "baseline", "sequence"),
    "D2": (
        "blinding", "masking", "open-label", "deviation", "adherence", "compliance", "intention-to-treat",
        "itt", "per-protocol",
    ),
    "D3": (
        "missing", "lost to follow-up", "dropout", "withdrawal", "imputation", "censoring", "analysed",
        "analyzed",
    ),
    "D4": ("outcome", "endpoint", "measure", "assessment", "assessor", "adjudication", "central review"),
    "D5": (
        "pre-specified", "prespecified", "pre-registered", "preregistered", "protocol",
        "statistical analysis plan", "registry", "clinicaltrials.gov",
    ),
}
DOMAIN_SECTIONS = {
    "D1": ("random", "allocation", "conceal", "baseline", "sequence", "methods", "statistical analysis"),
    "D2": ("blinding", "masking", "open-label", "deviation", "adherence", "compliance", "intervention"),
    "D3": (
        "missing", "withdraw", "lost to follow-up", "dropout", "censor", "analysed", "analyzed",
        "participant flow",
    ),
    "D4": ("outcome", "endpoint", "assessment", "assessor", "adjudication", "measurement"),
    "D5": (
        "pre-specified", "prespecified", "protocol", "statistical analysis plan", "registry",
        "clinicaltrials.gov",
    ),
}


def domain_key_terms(domain: str) -> list[str]:
    """Union of both keyword lists, sorted: the retrieval query of a domain."""
    return sorted(set(DOMAIN_SECTIONS[domain]) | set(SECTION_KEYWORDS[domain]))


# Document-type lexicons, in tie-break order.
DOC_TYPE_LEXICONS = {
    "disclosure": (
        "conflict of interest", "conflicts of interest", "disclosure statement", "financial disclosure",
        "author disclosure", "competing interests", "declaration of interests",
    ),
    "administrative": (
        "copyright", "licence", "license", "creative commons", "reuse permissions", "publisher",
        "administrative",
    ),
    "sap": (
        "statistical analysis plan", "analysis population", "interim analysis", "multiplicity", "estimand",
        "sample size",
    ),
    "protocol": (
        "study protocol", "trial protocol", "randomisation", "randomization", "eligibility", "intervention",
    ),
    "appendix": (
        "supplementary appendix", "appendix", "supplementary material", "supplemental appendix", "web appendix",
    ),
}
LOW_YIELD_DOC_TYPES = ("administrative", "disclosure")

# Model prices in USD per million tokens (None = unknown, 0 = free).
# model, provider, context window, in, out, cache read, cache write
MODEL_PRICES = (
    ("nemotron-3-super-120b-a12b-free", "openrouter", 1_000_000, 0.0, 0.0, None, None),
    ("nemotron-3-super-120b-a12b", "openrouter", 1_000_000, 0.085, 0.40, None, None),
    ("gpt-oss-120b", "openrouter", 131072, 0.039, 0.18, None, None),
    ("gpt-oss-120b-free", "openrouter", 131072, 0.0, 0.0, None, None),
    ("gpt-oss-20b", "openrouter", 131072, 0.029, 0.14, None, None),
    ("qwen3-32b", "openrouter", 131072, 0.08, 0.28, None, None),
    ("llama-3.3-70b-instruct", "openrouter", 131072, 0.10, 0.32, None, None),
    ("qwen3-235b-a22b", "openrouter", 131072, 0.455, 1.82, None, None),
    ("claude-sonnet-4.6", "anthropic", 1_000_000, 3.0, 15.0, 0.30, 3.75),
    ("gpt-5.5", "openai", 1_000_000, 5.0, 30.0, 0.50, None),
    ("google/gemma-4-31b-it:free", "openrouter", 262144, 0.0, 0.0, None, None),
)

# Provider model ids.
MODEL_IDS = {
    "nemotron-3-super-120b-a12b-free": "nvidia/nemotron-3-super-120b-a12b:free",
    "nemotron-3-super-120b-a12b": "nvidia/nemotron-3-super-120b-a12b",
    "gpt-oss-120b": "openai/gpt-oss-120b",
    "gpt-oss-120b-free": "openai/gpt-oss-120b:free",
    "gpt-oss-20b": "openai/gpt-oss-20b",
    "qwen3-32b": "qwen/qwen3-32b",
    "llama-3.3-70b-instruct": "meta-llama/llama-3.3-70b-instruct",
    "qwen3-235b-a22b": "qwen/qwen3-235b-a22b",
    "claude-sonnet-4.6": "claude-sonnet-4-6",
    "gpt-5.5": "gpt-5.5",
    "google/gemma-4-31b-it:free": "google/gemma-4-31b-it:free",
}

# Provider-error markers.
RETRYABLE_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
TRANSIENT_MARKERS = (
    "rate", "transient", "toomanyrequests", "too many requests", "timeout", "temporar", "connection",
    "connect", "server", "unavailable", "429", "500", "502", "503", "504",
)
AUTH_MARKERS = (
    "authentication", "permissiondenied", "unauthorized", "forbidden", "invalid api key", "incorrect api key",
    "api key", "401", "403",
)
INVALID_REQUEST_MARKERS = (
    "badrequest", "invalidrequest", "unprocessable", "context length", "maximum context", "400", "422",
)
SAFE_HEADERS = ("request-id", "x-request-id", "x-correlation-id", "cf-ray", "retry-after", "openai-processing-ms")
