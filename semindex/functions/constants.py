"""Limits, names and lists that results depend on."""

MAX_BLOCK_CHARS = 1000
MIN_BLOCK_CHARS = 50
MIN_REMAINDER_CHARS = 200
MAX_PACK_CHARS = 1150
MIN_SCORE = 0.4
TOP_K = 20
MAX_TOP_K = 200
POINT_NAMESPACE = "f47ac10b-58cc-4372-a567-0e02b2c3d479"
MAX_FILE_BYTES = 1024 * 1024
MAX_BATCH_TOKENS = 100_000
MAX_ITEM_TOKENS = 8191
BATCH_BLOCKS = 60
RETRIES = 3
RETRY_MS = 500
DEBOUNCE_MS = 1500
URGENT_MS = 100

IGNORED_DIRS = (
    ".git", "node_modules", "dist", "out", "build", "vendor", "tmp", "temp", "target", "coverage", ".next", ".nuxt", ".turbo",
    ".idea", ".vscode", ".opencode",
)

EXTENSIONS = (
    ".tla", ".js", ".jsx", ".ts", ".vue", ".tsx", ".py", ".rs", ".go", ".c", ".h", ".cpp", ".hpp", ".cs", ".rb", ".java", ".php",
    ".swift", ".sol", ".kt", ".kts", ".ex", ".exs", ".el", ".html", ".htm", ".md", ".markdown", ".json", ".css", ".rdl", ".ml",
    ".mli", ".lua", ".scala", ".toml", ".zig", ".elm", ".ejs", ".erb", ".vb",
)

MARKDOWN_EXTENSIONS = (".md", ".markdown")
LINE_EXTENSIONS = (".vb", ".scala", ".swift")
NO_GRAMMAR_EXTENSIONS = (".elm",)
DOC_EXTENSIONS = (".md", ".markdown", ".txt", ".rst", ".adoc")
DOC_WORDS = r"\b(readme|docs?|documentation|guide|tutorial|explain|overview)\b"
DOC_WEIGHTS = {"docs": (1.08, 0.98), "code": (0.9, 1.03)}

#: Markdown header lines: with number signs, and what stands under and in a title line.
ATX = r"^(#{1,6})\s+(.+)\z"
UNDERLINE = r"^(={3,}|-{3,})\s*\z"
TITLE = r"^\s*[^#<>!\[\]`\t]+[^\n]\z"

#: What a run reports.
RUN_REASONS = {
    "applied": "incremental-index-applied",
    "fresh": "already-fresh",
    "adopted_applied": "adopted-existing-roo-index-reconciled",
    "adopted": "adopted-existing-roo-index",
}
#: What a search reports of the index it used.
SEARCH_REASONS = {
    "ready": "search-only-existing-index",
    "missing": "no-existing-index",
    "scheduled": "background-refresh-scheduled",
    "idle": "background-idle",
}

#: What the assessments say.
SAYS_READY = ("Collection has indexed data (", " points); disabled mode can search immediately.")
SAYS_MISSING = "No complete indexed collection found; disabled mode will return empty results."
SAYS_SKIPPED = "Dry-run diff skipped; query-mode reconciliation cost is unknown."
SAYS_FRESH = "No pending reconciliation work; query mode should stay fast."
SAYS_PENDING = " files pending reconciliation (~"
SAYS_NEVER = "No completed indexing timestamp found; background status is unknown."
SAYS_UNKNOWN = ("Last completed ", "; pending workload unknown because diff was skipped.")
SAYS_CAUGHT_UP = ("Background appears caught up (last completed ", ").")
SAYS_STALE = ("Background appears stale (", " files pending, last completed ", ").")
SAYS_WAITING = (" files pending; last completed ", ".")

#: Ignore rules that come before those of any file.
DEFAULT_RULES = (".*", ".*/**", "!.github", "!.github/**", *(f"{d}/**" for d in IGNORED_DIRS))

#: Word under which a code model expects queries and documents.
CODE_PREFIX = "Represent this query for searching relevant code: "

#: provider, model, dimension, score threshold, prefix.
MODEL_PROFILES = (
    ("openai", "text-embedding-3-small", 1536, 0.4, None),
    ("openai", "text-embedding-3-large", 3072, 0.4, None),
    ("openai", "text-embedding-ada-002", 1536, 0.4, None),
    ("ollama", "nomic-embed-text", 768, 0.4, None),
    ("ollama", "nomic-embed-code", 3584, 0.15, CODE_PREFIX),
    ("ollama", "mxbai-embed-large", 1024, 0.4, None),
    ("ollama", "all-minilm", 384, 0.4, None),
    ("openai-compatible", "text-embedding-3-small", 1536, 0.4, None),
    ("openai-compatible", "text-embedding-3-large", 3072, 0.4, None),
    ("openai-compatible", "text-embedding-ada-002", 1536, 0.4, None),
    ("openai-compatible", "nomic-embed-code", 3584, 0.15, CODE_PREFIX),
    ("gemini", "gemini-embedding-001", 3072, 0.4, None),
    ("gemini", "text-embedding-004", 3072, 0.4, None),
    ("mistral", "codestral-embed-2505", 1536, 0.4, None),
    ("vercel-ai-gateway", "openai/text-embedding-3-small", 1536, 0.4, None),
    ("vercel-ai-gateway", "openai/text-embedding-3-large", 3072, 0.4, None),
    ("vercel-ai-gateway", "openai/text-embedding-ada-002", 1536, 0.4, None),
    ("vercel-ai-gateway", "cohere/embed-v4.0", 1024, 0.4, None),
    ("vercel-ai-gateway", "google/gemini-embedding-001", 3072, 0.4, None),
    ("vercel-ai-gateway", "google/text-embedding-005", 768, 0.4, None),
    ("vercel-ai-gateway", "google/text-multilingual-embedding-002", 768, 0.4, None),
    ("vercel-ai-gateway", "amazon/titan-embed-text-v2", 1024, 0.4, None),
    ("vercel-ai-gateway", "mistral/codestral-embed", 1536, 0.4, None),
    ("vercel-ai-gateway", "mistral/mistral-embed", 1024, 0.4, None),
    ("bedrock", "amazon.titan-embed-text-v1", 1536, 0.4, None),
    ("bedrock", "amazon.titan-embed-text-v2:0", 1024, 0.4, None),
    ("bedrock", "amazon.titan-embed-image-v1", 1024, 0.4, None),
    ("bedrock", "amazon.nova-2-multimodal-embeddings-v1:0", 1024, 0.4, None),
    ("bedrock", "cohere.embed-english-v3", 1024, 0.4, None),
    ("bedrock", "cohere.embed-multilingual-v3", 1024, 0.4, None),
    ("openrouter", "openai/text-embedding-3-small", 1536, 0.4, None),
    ("openrouter", "openai/text-embedding-3-large", 3072, 0.4, None),
    ("openrouter", "openai/text-embedding-ada-002", 1536, 0.4, None),
    ("openrouter", "google/gemini-embedding-001", 3072, 0.4, None),
    ("openrouter", "mistralai/mistral-embed-2312", 1024, 0.4, None),
    ("openrouter", "mistralai/codestral-embed-2505", 1536, 0.4, None),
    ("openrouter", "qwen/qwen3-embedding-0.6b", 1024, 0.4, None),
    ("openrouter", "qwen/qwen3-embedding-4b", 2560, 0.4, None),
    ("openrouter", "qwen/qwen3-embedding-8b", 4096, 0.4, None),
)
