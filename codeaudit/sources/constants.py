"""Names, patterns, thresholds and lookup tables the results depend on."""

from __future__ import annotations

# --- files -----------------------------------------------------------------

SOURCE_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".sh", ".bash", ".sql", ".yml", ".yaml",
)
COMMAND_LINE_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx")

SKIP_DIRS = (
    "node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build",
    ".eggs", ".tox", ".mypy_cache",
)
SKIP_DIR_SUFFIX = ".egg-info"

LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".sh": "bash",
    ".bash": "bash",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".sql": "generic",
}

# --- detector --------------------------------------------------------------

SIGNAL_WEIGHTS = {"comments": 0.30, "structure": 0.35, "tokens": 0.35}
AI_THRESHOLD = 0.6
MEDIUM_THRESHOLD = 0.3

STOCK_NAMES = (
    "user_id", "user_name", "username", "is_valid", "is_active", "response",
    "response_data", "result", "data", "payload", "token", "config", "settings",
    "handler", "manager", "service", "repository", "client", "session", "context",
    "logger", "db", "conn", "cursor", "error", "err", "success", "status",
    "message", "output", "value",
)

SECTION_HEADING = r"(?m)^\s+(Args:|Returns:|Raises:)\s*$"
PARAMETER_UNDERLINE = r"(?m)^\s+Parameters\s*\n\s*-{4,}\s*$"
FEATURE_TODO = (
    r"(?i)#\s*TODO[:\s].*"
    r"(implement|add|create|support|handle|integrate|build|extend|allow|enable)"
)
SWALLOWED_EXCEPTION = r"(?m)except\s+Exception\s+as\s+\w+:\s*\n\s*(pass|\.\.\.)"
STAR_IMPORT = r"(?m)^\s*from\s+([\w.]+)\s+import\s+\*\s*$"
NAMED_IMPORT = r"(?m)^\s*from\s+([\w.]+)\s+import\s+([\w,\s]+)\s*$"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"

# --- severities and score --------------------------------------------------

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
DEDUCTIONS = {"CRITICAL": 25, "HIGH": 10, "MEDIUM": 3, "LOW": 1}
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"), (0, "F"))
GRADE_COLORS = {
    "A": "brightgreen", "B": "green", "C": "yellow", "D": "orange", "F": "red",
}
REPORT_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
MATCHER_SEVERITIES = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}

# --- secrets, env files, agent configs --------------------------------------

SECRET_NAME = (
    r"(?i)(password|passwd|pwd|secret|api_key|apikey|token|"
    r"auth_token|access_token|private_key|client_secret|"
    r"credentials|stripe|sendgrid|twilio|aws|jwt|database_url|"
    r"mongo|redis|smtp|mailgun|slack|discord|webhook)"
)
PLACEHOLDER = r"(?i)(YOUR_|<|>|XXXX|example|placeholder|changeme|todo|fixme|replace)"

ENV_FILES = (".env", ".env.local", ".env.production", ".env.staging", ".env.development")
ENV_ENTRY = r"^([A-Za-z_][A-Za-z0-9_]*)=(.*)"
ENTROPY_LIMIT = 3.5
TOKEN_ENTROPY_LIMIT = 4.5

AGENT_CONFIG_PATHS = (
    ".claude/settings.json", ".cursor/mcp.json", "mcp.config.json",
    ".mcp/config.json", ".mcp.json", "claude_desktop_config.json",
)

# --- prompt injection --------------------------------------------------------

INJECTION_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml")
INJECTION_PATTERNS = (
    r"ignore\s+(previous|all|above|prior)\s+instructions?",
    r"forget\s+everything\s+(you\s+)?(know|learned)",
    r"disregard\s+(previous|all|prior)\s+(instructions?|context)",
    r"you\s+are\s+now\s+(a\s+)?different",
    r"new\s+system\s+prompt",
    r"this\s+code\s+is\s+(legit|safe|secure|tested|approved)",
    r"(do\s+not|don't)\s+(flag|report|scan|analyze)\s+this",
    r"skip\s+(security|this)\s+(check|scan|analysis)",
    r"(sandbox|internal|verified)\s+environment",
    r"security\s+(approved|reviewed|cleared)",
    r"print\s+(your\s+)?(system\s+)?prompt",
    r"reveal\s+(your\s+)?(instructions?|system)",
    r"what\s+(are|were)\s+your\s+instructions",
)

# --- dependencies ------------------------------------------------------------

DEPENDENCY_FILES = {
    "requirements.txt": "python",
    "requirements-dev.txt": "python",
    "requirements-test.txt": "python",
    "setup.py": "python",
    "setup.cfg": "python",
    "Pipfile": "python",
    "pyproject.toml": "python",
    "package.json": "npm",
    "package-lock.json": "npm",
    "yarn.lock": "npm",
    "go.mod": "go",
    "Cargo.toml": "rust",
}
LOCK_FILES = {
    "requirements.txt": ("requirements.txt.lock", "Pipfile.lock", "poetry.lock"),
    "Pipfile": ("Pipfile.lock",),
    "pyproject.toml": ("poetry.lock", "pdm.lock", "uv.lock"),
    "package.json": ("package-lock.json", "yarn.lock", "pnpm-lock.yaml"),
}
REQUIREMENT = (
    r"^([A-Za-z0-9][-A-Za-z0-9_.]*)"
    r"(?:\[.*?\])?"
    r"(?:\s*(==|>=|<=|~=|!=|>|<)\s*([A-Za-z0-9][-A-Za-z0-9_.]*))?"
)
NPM_VERSION = r"(\d+\.\d+\.\d+)"
REGISTRY_ECOSYSTEMS = ("python", "npm")

BAD_PACKAGES = {
    "python": (
        "huggingface-cli", "langchain-community-tools", "openai-tools", "fastjson-secure",
        "flask-auth-utils", "django-security-utils", "python-jwt-utils", "requests-auth",
        "fastapi-security", "sqlalchemy-utils-secure", "crypto-utils", "hash-utils",
        "password-utils", "secure-random", "python-dotenv-utils", "env-utils",
        "config-loader", "flask-login-utils", "django-rest-utils", "celery-utils",
        "redis-utils", "mongodb-utils", "postgres-utils", "database-utils", "api-utils",
        "http-utils", "json-utils", "file-utils", "string-utils", "date-utils",
        "math-utils", "validation-utils", "serializer-utils", "logger-utils", "cache-utils",
    ),
    "npm": (
        "react-codeshift", "express-auth-utils", "node-security", "jwt-utils",
        "bcrypt-utils", "crypto-helper", "validation-helper", "express-validator-utils",
        "react-auth", "next-auth-utils", "prisma-utils", "mongoose-utils", "axios-utils",
        "fetch-utils", "date-helper", "string-helper", "array-helper", "object-helper",
        "error-handler", "middleware-utils", "logger-helper", "config-helper",
        "env-helper", "api-helper", "http-helper",
    ),
}

# (ecosystem, package, first safe version, known advisories, severity)
VULNERABILITIES = (
    ("python", "pillow", "10.3.0", ("CVE-2024-28219", "CVE-2023-50447"), "HIGH"),
    ("python", "cryptography", "42.0.4", ("CVE-2024-26130",), "HIGH"),
    ("python", "pyyaml", "6.0.1", ("CVE-2023-6395",), "HIGH"),
    ("python", "requests", "2.31.0", ("CVE-2023-32681",), "MEDIUM"),
    ("python", "urllib3", "2.0.7", ("CVE-2023-45803", "CVE-2023-43804"), "HIGH"),
    ("python", "werkzeug", "3.0.3", ("CVE-2024-34069",), "HIGH"),
    ("python", "aiohttp", "3.9.4", ("CVE-2024-23334",), "HIGH"),
    ("python", "sqlalchemy", "2.0.0", ("CVE-2023-30608",), "MEDIUM"),
    ("python", "paramiko", "3.4.0", ("CVE-2023-48795",), "MEDIUM"),
    ("python", "jinja2", "3.1.4", ("CVE-2024-34064",), "MEDIUM"),
    ("npm", "axios", "1.7.4", ("CVE-2024-39338",), "HIGH"),
    ("npm", "lodash", "4.17.21", ("CVE-2021-23337", "CVE-2020-8203"), "HIGH"),
    ("npm", "minimist", "1.2.8", ("CVE-2021-44906",), "CRITICAL"),
    ("npm", "tough-cookie", "4.1.3", ("CVE-2023-26136",), "CRITICAL"),
    ("npm", "semver", "7.5.2", ("CVE-2022-25883",), "HIGH"),
)
