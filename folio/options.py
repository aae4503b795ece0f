"""Parameters of a pack run and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Results must equal them, so they are stated as they are.
INLINE_LIMIT_BYTES = 1_048_576
TEXT_LIMIT_BYTES = 8_000_000
SAMPLE_BYTES = 8192
# Above any size: texts are read whole unless a run asks for the limits above.
NO_LIMIT = 2**62
CACHE_TTL_SECONDS = 7 * 24 * 60 * 60
DISPLAY_PATH_BYTES = 60
TOP_FILES = 10
SHOW_ALL_UP_TO = 15

# Names that are skipped unless the caller asks otherwise. Entries with a
# glob character only take effect when `default_globs` is set.
DEFAULT_IGNORE = (
    ".git", ".svn", ".hg", ".bzr", ".gitignore", ".gitattributes",
    ".DS_Store", "Thumbs.db", "desktop.ini", "ehthumbs.db", "*.lnk", "*.url", ".directory",
    "node_modules", "bower_components", ".npm", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".pnpm",
    ".yarn",
    "yarn-error.log", "vendor", "composer.lock", ".pnpm-store", "npm-shrinkwrap.json", "lerna-debug.log", ".yalc",
    ".turbo",
    "dist", "build", "out", "bin", "release", "*.min.js", "*.min.css", "bundle.*", ".parcel-cache", ".next",
    ".nuxt", ".output", ".cache",
    ".rollup.cache", ".webpack", ".serverless", ".netlify", "storybook-static",
    "__pycache__", ".pytest_cache", ".coverage", "venv", "env", ".env", ".venv", "*.pyc", "*.pyo", "*.pyd",
    ".python-version",
    "*.egg-info", "*.egg", "develop-eggs",
    "target", "Cargo.lock", ".cargo",
    ".idea", ".vscode", ".vs", ".sublime-*", "*.swp", "*.swo", "*~", ".project", ".settings", ".classpath",
    ".factorypath",
    "*.iml", "*.iws", "*.ipr",
    ".cache", "tmp", "temp", "logs", ".sass-cache", ".eslintcache", "*.log", "npm-debug.log*", "yarn-debug.log*",
    "yarn-error.log*",
    ".gradle", "gradle", ".maven", ".m2", "*.class", "*.jar", "*.war", "*.ear",
    "coverage", ".nyc_output", ".next", "*.tsbuildinfo", ".nuxt", ".output",
    "bin", "obj", "Debug", "Release", "packages", "*.suo", "*.user", "*.pubxml", "*.pubxml.user",
    "_site", ".jekyll-cache", ".docusaurus",
    ".gradle", "build", "xcuserdata", "*.xcworkspace", "Pods/", ".expo",
    "*.sqlite", "*.sqlite3", "*.db",
    "*.zip", "*.tar.gz", "*.tgz", "*.rar",
    ".kube", "*.kubeconfig",
    ".terraform", "*.tfstate", "*.tfvars",
    "*.retry",
)

# Name, model id, provider, context window.
MODELS = [
    ("Sonnet35", "claude-3-5-sonnet-latest", "anthropic", 200_000),
    ("Sonnet37", "claude-3-7-sonnet-latest", "anthropic", 200_000),
    ("Gpt4", "gpt-4", "openai", 8_192),
    ("Gpt4Turbo", "gpt-4-0125-preview", "openai", 128_000),
    ("Gpt4o", "gpt-4o", "openai", 8_192),
    ("Llama2_7b", "meta-llama/Llama-2-7b-hf", "huggingface", 4_096),
    ("Llama3_8b", "meta-llama/Llama-3-8b-hf", "huggingface", 8_192),
    ("MistralSmall24B", "mistralai/Mistral-Small-3.1-24B-Base-2503", "huggingface", 128_000),
    ("MistralLargeInstruct", "mistralai/Mistral-Large-Instruct-2411", "huggingface", 128_000),
    ("Pixtral12B", "mistralai/Pixtral-12B-Base-2409", "huggingface", 128_000),
    ("MistralSmall", "mistralai/Mistral-Small-Instruct-2409", "huggingface", 32_000),
]

FORMATS = ("txt", "xml")
# Formats of the caller's own, by name; see `folio.operators.writers`.
WRITERS: dict = {}


@dataclass(frozen=True)
class PackOptions:
    """What to keep, how to read it and how to print it."""

    format: str = "txt"
    output_file: str | None = None
    ignore_patterns: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    include_dirs: bool = False  # True: include globs must match directories as well
    default_globs: bool = False
    respect_gitignore: bool = True
    custom_ignore_name: str | None = None
    record_symlinks: bool = False
    include_metadata: bool = False
    inline_limit: int = NO_LIMIT
    text_limit: int = NO_LIMIT
    sample_bytes: int = SAMPLE_BYTES
    trim_partial_char: bool = False
    model_id: str | None = None
    counter: str = "pieces"
    now_s: int = 0
    timestamp: str = "1970-01-01T00:00:00+00:00"
    hostname: str = "unknown"
    os: str = "linux"
    kernel: str = "unix"

    def __post_init__(self):
        known = (*FORMATS, *WRITERS)
        if self.format not in known:
            raise ValueError(f"format must be one of {known}, not {self.format!r}")

    @property
    def output_name(self) -> str:
        """Name of the pack file, by format unless given."""
        return self.output_file or {"txt": ".context.md"}.get(self.format, f".context.{self.format}")
