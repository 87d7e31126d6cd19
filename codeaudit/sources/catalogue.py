"""The rule catalogue: one row per rule, held as data.

``tiers`` is the narrowest scan depth a rule belongs to: ``F`` runs in FULL
only, ``FM`` also in MEDIUM, ``FMC`` in every tier.  ``scope`` names the text a
rule looks at: ``L`` a logical statement (physical line outside Python, JS and
TS), ``S`` a piece of text between semicolons, ``F`` the whole file, ``B`` a
statement plus a condition on the lines around it.  ``keyword`` is a literal
that every match must contain; it is tested before the pattern.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: str
    pack: str
    severity: str
    category: str
    cwe: str
    tiers: str
    scope: str
    positive: str
    negative: str
    keyword: str
    message: str

    @property
    def languages(self) -> tuple[str, ...]:
        return PACK_LANGUAGES.get(self.pack.split("/")[0], ())

    @property
    def tier_names(self) -> tuple[str, ...]:
        return TIER_NAMES[: len(self.tiers)]


TIER_NAMES = ("FULL", "MEDIUM", "CRITICAL_ONLY")

PACK_LANGUAGES = {
    "dockerfile": ("dockerfile",),
    "github-actions": ("yaml",),
    "javascript": ("javascript", "typescript"),
    "kubernetes": ("yaml",),
    "python": ("python",),
    "shell": ("bash",),
    "sql": ("generic",),
    "typescript": ("typescript",),
}

# Rule ids, packs, severities, categories, CWE numbers, tiers and patterns.
_ROWS = [
    ("dockerfile-curl-pipe-bash", "dockerfile/curl-pipe-bash", "CRITICAL", "supply_chain", "CWE-494", "F", "F",
     r"(?im)^RUN\s+.*(curl|wget)[^|]*\|\s*(bash|sh)",
     "", "",
     "An image build step pipes a download into a shell"),
    ("dockerfile-missing-user", "dockerfile/missing-user", "HIGH", "container_security", "CWE-250", "FM", "F",
     r"(?s)\A.+",
     "", "",
     "The image runs as root because no other user is set"),
    ("gha-unpinned-action", "github-actions/unpinned-action", "HIGH", "supply_chain", "CWE-1357", "F", "L",
     r"^\s*uses:\s+[^@\n]+@.+",
     r"^\s*uses:\s+[^@\n]+@[0-9a-fA-F]{40}\b", "uses:",
     "A workflow step uses an action that is not pinned to a commit"),
    ("js-client-side-auth", "javascript/client-side-auth", "CRITICAL", "authorization", "CWE-602", "FM", "F",
     r"\{\s*(isAdmin|isAuthenticated|userRole|isLoggedIn|hasPermission)\s*&&\s*<",
     "", "&&",
     "Access is decided in the browser by a rendering flag"),
    ("js-client-side-pricing", "javascript/client-side-pricing", "CRITICAL", "business_logic", "CWE-602", "FM", "F",
     r"(?s)(price|total|amount|cost|subtotal)\s*=.*(fetch|axios\.post)\s*\(",
     "", "(",
     "A price computed in the browser is sent to the server"),
    ("js-crlf-injection", "javascript/crlf-injection", "HIGH", "header_injection", "CWE-113", "F", "L",
     r"\b(res\.setHeader|res\.header|response\.set)\([^,]+,\s*req\.query\.\w+\s*\)",
     "", "req.query",
     "A query parameter reaches a response header"),
    ("js-csrf-missing-token-fetch", "javascript/csrf", "MEDIUM", "csrf", "CWE-352", "F", "S",
     r"""(?s)\bfetch\([^;]*method\s*:\s*["']POST["'][^;]*body\s*:""",
     r"""["'](X-CSRF-Token|x-csrf-token|X-XSRF-TOKEN)["']""", "fetch(",
     "A POST by fetch carries no anti-forgery token"),
    ("js-csrf-missing-token-axios", "javascript/csrf", "MEDIUM", "csrf", "CWE-352", "F", "S",
     r"(?s)\baxios\.post\([^,;]+,[^;]*",
     r"""["'](X-CSRF-Token|x-csrf-token|X-XSRF-TOKEN)["']""", "axios.post(",
     "A POST by axios carries no anti-forgery token"),
    ("js-ecb-mode", "javascript/ecb-mode", "CRITICAL", "crypto", "CWE-327", "F", "F",
     r"""createCipher(iv)?\(\s*['"][^'"]*ecb[^'"]*['"]""",
     "", "createCipher",
     "A block cipher runs in ECB mode"),
    ("js-eval-user-input", "javascript/eval", "CRITICAL", "eval", "CWE-95", "FM", "L",
     r"""(^|[^.\w])(eval|setTimeout)\(\s*[^"'\s)]|\bnew\s+Function\(\s*[^"'\s)]""",
     "", "(",
     "Text that is not a literal is run as code"),
    ("js-graphql-injection", "javascript/graphql-injection", "CRITICAL", "graphql_injection", "CWE-89", "F", "F",
     r"(query|mutation|subscription)\s*\{[^`]*\$\{[^}]+\}",
     "", "${",
     "A GraphQL document is built from a template value"),
    ("js-log-injection", "javascript/log-injection", "HIGH", "log_injection", "CWE-117", "F", "L",
     r"\b(console\.log|logger\.\w+|req\.log\.\w+)\(\s*`[^`]*\$\{",
     "", "${",
     "Unescaped values are written to the log"),
    ("js-math-random-security", "javascript/math-random-security", "CRITICAL", "crypto", "CWE-338", "F", "L",
     r"\bconst\s+\w*(?i:token|otp|code|pin|key|nonce|csrf|reset|verify)\w*\s*=\s*Math\.random\(\)",
     "", "Math.random()",
     "A security value comes from Math.random"),
    ("js-missing-helmet", "javascript/missing-helmet", "MEDIUM", "security_headers", "CWE-16", "F", "F",
     r"\w+\s*=\s*express\(\)",
     r"\.use\(\s*helmet\(", "express()",
     "An express application sets no security headers"),
    ("js-nosql-injection", "javascript/nosql-injection", "CRITICAL", "nosql_injection", "CWE-943", "F", "L",
     r"\.(find|findOne|deleteOne)\(\s*req\.body\s*\)|\.updateOne\(\s*req\.body\s*,|\.(find|findOne)\(\s*req\.query\s*\)",
     "", "req.",
     "A request body is used as a database filter"),
    ("js-open-redirect", "javascript/open-redirect", "HIGH", "open_redirect", "CWE-601", "F", "L",
     r"\bres\.redirect\(\s*req\.query\.(next|redirect)\s*\)|return\s+NextResponse\.redirect\(\s*[^,)]+\)",
     "", "redirect(",
     "A redirect target comes from the request"),
    ("js-pii-in-logs", "javascript/pii-in-logs", "HIGH", "privacy", "CWE-532", "F", "L",
     r"(console\.log|logger\.(info|warn|error|debug)).*(email|phone|ssn|dob|address|passport|tax_id|credit_card|card_number|ip_address)",
     "", "",
     "Personal data is written to the log"),
    ("js-prototype-pollution-proto-assignment", "javascript/prototype_pollution", "HIGH", "prototype_pollution", "CWE-1321", "F", "L",
     r'(\["__proto__"\]|\.__proto__)\[[^\]]+\]\s*=[^=]',
     "", "__proto__",
     "An assignment writes through the object prototype"),
    ("js-prototype-pollution-unsafe-assign", "javascript/prototype_pollution", "HIGH", "prototype_pollution", "CWE-1321", "F", "S",
     r"\bObject\.assign\(\s*[^,]+,\s*(\w+\.body|\w+)\s*\)",
     "", "Object.assign(",
     "Outside data is merged into an object"),
    ("js-sqli-template-literal", "javascript/sqli", "CRITICAL", "sqli", "CWE-89", "FMC", "L",
     r"""\w\.(query|execute|run|raw)\(\s*(`[^`]*\$\{|"[^"]*"\s*\+|'[^']*'\s*\+)""",
     "", "(",
     "SQL is built from a template or concatenated text"),
    ("js-supabase-service-role", "javascript/supabase-service-role", "CRITICAL", "secrets", "CWE-798", "FMC", "L",
     r"\bcreateClient\([^,]+,\s*process\.env\.\w*(?i:SERVICE_ROLE|SUPABASE_SERVICE)\w*",
     "", "createClient(",
     "A client is created with the service-role key"),
    ("js-xss-inner-html", "javascript/xss", "HIGH", "xss", "CWE-79", "F", "L",
     r"""\.innerHTML\s*=\s*[^"'=\s]""",
     "", "innerHTML",
     "A value is written to innerHTML"),
    ("js-xss-dangerously-set-inner-html", "javascript/xss", "HIGH", "xss", "CWE-79", "F", "L",
     r"""dangerouslySetInnerHTML=\{\{\s*__html\s*:\s*[^"'\s]""",
     "", "dangerouslySetInnerHTML",
     "A value is rendered as raw HTML"),
    ("k8s-rbac-cluster-admin", "kubernetes/rbac-cluster-admin", "CRITICAL", "authorization", "CWE-269", "F", "F",
     r'(?is)(roleRef:\s*.*name:\s*cluster-admin|verbs:\s*\[\s*"\*"\s*\]|resources:\s*\[\s*"\*"\s*\])',
     "", ":",
     "A role grants cluster-wide administration"),
    ("python-auth-jwt-verify-disabled", "python/auth", "CRITICAL", "auth", "CWE-347", "F", "L",
     r"""jwt\.decode\(.*(verify\s*=\s*False|["']verify_signature["']\s*:\s*False)""",
     "", "jwt.decode(",
     "A token is decoded without checking its signature"),
    ("python-auth-timing-unsafe-compare", "python/auth", "HIGH", "auth", "CWE-208", "F", "L",
     r"(?i)(token|secret|key|password|passwd|pwd|credential|hash|digest|signature|nonce)\w*\s*==|==\s*[\w.]*(token|secret|key|password|passwd|pwd|credential|hash|digest|signature|nonce)",
     "", "==",
     "A secret is compared with == and leaks timing"),
    ("python-cmdi-shell-true", "python/cmdi", "HIGH", "cmdi", "CWE-78", "FM", "L",
     r"""subprocess\.\w+\(\s*(f["']|"[^"]*"\s*[+%]|'[^']*'\s*[+%]).*shell\s*=\s*True""",
     "", "subprocess.",
     "A shell command is built from variable text"),
    ("python-cors-wildcard-string", "python/cors", "MEDIUM", "cors", "CWE-942", "F", "L",
     r"""\bCORS\([^,)]+,\s*origins\s*=\s*(\[\s*)?["']\*["']""",
     "", "CORS(",
     "Cross-origin access is open to every site"),
    ("python-cors-wildcard-header", "python/cors", "MEDIUM", "cors", "CWE-942", "F", "L",
     r"""\.headers\[["']Access-Control-Allow-Origin["']\]\s*=\s*["']\*["']""",
     "", "Access-Control-Allow-Origin",
     "A header opens cross-origin access to every site"),
    ("python-crlf-injection", "python/crlf-injection", "HIGH", "header_injection", "CWE-113", "F", "B",
     r"(?i)response\.headers\[[^\]]+\]\s*=\s*.*(request\.(args|form|get|json)|params|input|user_)",
     r"""\.replace\(["']\\r["']""", "",
     "Request data reaches a response header"),
    ("python-debug-mode-enabled", "python/debug-mode", "CRITICAL", "debug_mode", "CWE-94", "FMC", "L",
     r"\bapp\.run\(.*debug\s*=\s*True",
     "", "app.run(",
     "The application starts in debug mode"),
    ("python-debug-mode-outside-main-guard", "python/debug-mode", "CRITICAL", "debug_mode", "CWE-94", "FMC", "B",
     r"\bapp\.run\(.*debug\s*=\s*True",
     r"""^if\s+__name__\s*==\s*["']__main__["']\s*:""", "app.run(",
     "Debug mode starts on import, outside the main guard"),
    ("python-deserial-pickle-loads", "python/deserial", "CRITICAL", "deserial", "CWE-502", "F", "L",
     r"\bpickle\.loads\([^,)]+\)",
     "", "pickle.loads(",
     "Bytes are unpickled"),
    ("python-deserial-pickle-load", "python/deserial", "CRITICAL", "deserial", "CWE-502", "F", "L",
     r"\bpickle\.load\([^,)]+\)",
     "", "pickle.load(",
     "A file is unpickled"),
    ("python-deserial-yaml-unsafe", "python/deserial", "CRITICAL", "deserial", "CWE-502", "F", "L",
     r"\byaml\.load\([^,)]+\)",
     r"Loader\s*=", "yaml.load(",
     "YAML is loaded without a safe loader"),
    ("python-deserial-eval-exec", "python/deserial", "CRITICAL", "deserial", "CWE-502", "F", "L",
     r"""(^|[^.\w])(eval|exec)\(\s*[^"'\s)]""",
     "", "(",
     "Text that is not a literal is evaluated"),
    ("python-ecb-mode", "python/ecb-mode", "CRITICAL", "crypto", "CWE-327", "F", "L",
     r"\bAES\.new\([^,]+,\s*AES\.MODE_ECB|\bCipher\.new\([^,]+,\s*[^,)]*ECB",
     "", "ECB",
     "A block cipher runs in ECB mode"),
    ("python-verbose-error-jsonify", "python/error_exposure", "MEDIUM", "error_exposure", "CWE-209", "F", "L",
     r"""return\s+jsonify\(\{\s*["']error["']\s*:\s*str\(\w+\)\s*\}\)""",
     "", "jsonify(",
     "An exception text is returned to the caller"),
    ("python-verbose-error-traceback", "python/error_exposure", "MEDIUM", "error_exposure", "CWE-209", "F", "L",
     r"""return\s+jsonify\(\{.*["']traceback["']\s*:\s*traceback\.format_exc\(\)""",
     "", "traceback",
     "A traceback is returned to the caller"),
    ("python-verbose-error-fastapi", "python/error_exposure", "MEDIUM", "error_exposure", "CWE-209", "F", "L",
     r"""return\s+\{\s*["']detail["']\s*:\s*str\(\w+\)\s*\}""",
     "", "detail",
     "An exception text is returned as detail"),
    ("python-graphql-injection", "python/graphql-injection", "CRITICAL", "graphql_injection", "CWE-89", "F", "L",
     r"""(execute|query)\(\s*f["'].*(query|mutation|subscription)\s*\{.*\{[^}]+\}.*["']""",
     "", "(",
     "A GraphQL document is built by an f-string"),
    ("python-html-injection", "python/html-injection", "HIGH", "html_injection", "CWE-80", "F", "L",
     r"""return\s+f["']<\w+[^>]*>\{[^}]+\}</\w+>["']""",
     r"\{\s*escape\(", "return",
     "HTML is built from an unescaped value"),
    ("python-idor", "python/idor", "CRITICAL", "idor", "CWE-639", "FMC", "B",
     r"\bdb\.query\((\w+)\)\.filter\((\w+)\.id\s*==\s*([\w.]*id[\w.]*)\)",
     r"""^\s*if\s+(current_user\.id|session\[["']user_id["']\])\s*==""", "db.query(",
     "A record is read by id without an owner check"),
    ("python-insecure-random", "python/insecure-random", "CRITICAL", "crypto", "CWE-338", "FM", "L",
     r"^\s*[\w.]*(?i:token|otp|code|pin|key|nonce|salt|iv)[\w.]*\s*=\s*random\.(randint\(|randrange\(|choice\(|choices\(|random\(\)|sample\()",
     "", "random.",
     "A security value comes from the plain random module"),
    ("python-log-injection", "python/log-injection", "HIGH", "log_injection", "CWE-117", "F", "L",
     r"""\b(logger|logging)\.\w+\(\s*f["'].*\{[^}]+\}""",
     "", "logg",
     "Unescaped values are written to the log"),
    ("python-mass-assignment-create", "python/mass_assign", "HIGH", "mass_assign", "CWE-915", "F", "L",
     r"\b\w+\(\s*\*\*request\.(json|get_json\(\)|form)\s*\)",
     "", "**request.",
     "A model is created from the whole request"),
    ("python-mass-assignment-update", "python/mass_assign", "HIGH", "mass_assign", "CWE-915", "F", "L",
     r"\.__dict__\.update\(\s*request\.(json|get_json\(\))\s*\)|\.update\(\s*\*\*request\.(json|get_json\(\))\s*\)",
     "", "update(",
     "A model is updated from the whole request"),
    ("python-missing-rate-limit", "python/missing-rate-limit", "HIGH", "rate_limit", "CWE-307", "F", "B",
     r"(?i)^\s*def\s+(login|signin|authenticate|reset_password|verify_otp|forgot_password)\w*\(",
     r"^\s*@limiter\.limit\(", "",
     "A login-like route has no rate limit"),
    ("python-missing-security-headers-flask", "python/missing-security-headers", "MEDIUM", "security_headers", "CWE-16", "F", "F",
     r"=\s*Flask\(__name__\)",
     r"\bTalisman\(", "Flask(__name__)",
     "A Flask application sets no security headers"),
    ("python-missing-security-headers-fastapi", "python/missing-security-headers", "MEDIUM", "security_headers", "CWE-16", "F", "F",
     r"=\s*FastAPI\(",
     r"\.add_middleware\(\s*HTTPSRedirectMiddleware", "FastAPI(",
     "A FastAPI application does not redirect to TLS"),
    ("python-nosql-injection", "python/nosql-injection", "CRITICAL", "nosql_injection", "CWE-943", "F", "L",
     r"""\.(find|find_one|delete_one)\(\s*request\.json\s*\)|\.update_one\(\s*request\.json\s*,|\.(find|find_one)\(\s*request\.form\s*\)|\.(find|find_one)\(\s*\{\s*["']\$\w+["']\s*:""",
     "", "(",
     "A request body is used as a database filter"),
    ("python-open-redirect", "python/open-redirect", "HIGH", "open_redirect", "CWE-601", "F", "L",
     r"(?i)\bredirect\(\s*[^)]*(next|redirect_to|return_url|url|destination|request\.(args|form|json))",
     "", "",
     "A redirect target comes from the request"),
    ("python-path-traversal-unsanitized", "python/path_traversal", "HIGH", "path_traversal", "CWE-22", "FM", "L",
     r"""\bopen\(\s*(f["']|"[^"]*"\s*\+|'[^']*'\s*\+)|\bsend_file\(\s*f["']""",
     "", "(",
     "A file path is built from variable text"),
    ("python-pii-in-logs", "python/pii-in-logs", "HIGH", "privacy", "CWE-532", "F", "L",
     r"""(?i)\b(logger|logging)\.\w+\(\s*f["'].*\{[^}]*(email|phone|ssn|dob|birth|address|credit_card|card_number|national_id|passport|tax_id|ip_address)[^}]*\}""",
     "", "",
     "Personal data is written to the log"),
    ("python-plaintext-sensitive-fields", "python/plaintext-sensitive-fields", "HIGH", "data_protection", "CWE-312", "F", "L",
     r"^\s*\w*(?i:ssn|social_security|credit_card|card_number|cvv|bank_account|routing_number|medical_record|health_data|biometric)\w*\s*=\s*Column\(\s*(String|Text)\b",
     "", "Column(",
     "A sensitive field is stored as plain text"),
    ("python-race-condition-balance", "python/race-condition-balance", "CRITICAL", "race_condition", "CWE-362", "F", "B",
     r"""^\s*if\s+[\w.\[\]"']+\s*>=\s*[\w.\[\]"']+\s*:""",
     r"^\s*with\s+(db\.transaction|session\.begin|conn\.cursor)\(", ">=",
     "A check and its update can race"),
    ("python-redos-catastrophic-regex", "python/redos", "HIGH", "redos", "CWE-1333", "F", "L",
     r"\bre\.compile\(\s*(request\.(args|form)\.get\(|(?i:\w*(regex|pattern|expr|expression|input)\w*)\s*\))",
     "", "re.compile(",
     "A pattern from outside is compiled"),
    ("python-sqli-fstring", "python/sqli", "CRITICAL", "sqli", "CWE-89", "FMC", "L",
     r"""\.execute\(\s*(f["']|"[^"]*"\s*[%+]|'[^']*'\s*[%+])""",
     "", ".execute(",
     "SQL is built from an f-string or concatenated text"),
    ("python-ssrf-user-controlled-url", "python/ssrf", "HIGH", "ssrf", "CWE-918", "FM", "L",
     r"""\b(requests|httpx)\.\w+\(\s*[^"'\s)]|\burllib\.request\.urlopen\(\s*[^"'\s)]""",
     "", "(",
     "A request goes to a URL that is not a literal"),
    ("python-ssti-render-template-string", "python/ssti", "CRITICAL", "ssti", "CWE-94", "F", "L",
     r"""\brender_template_string\(\s*[^"'\s),]+\s*\)""",
     "", "render_template_string(",
     "A template is rendered from a variable"),
    ("python-ssti-jinja-from-string", "python/ssti", "CRITICAL", "ssti", "CWE-94", "F", "L",
     r"\bEnvironment\([^)]*\)\.from_string\(\s*[^)]+\)",
     "", "from_string(",
     "A template is built from a variable"),
    ("python-token-in-url", "python/token-in-url", "HIGH", "token_exposure", "CWE-598", "F", "L",
     r"""(?i)f["'][^"']*\?[^"']*=\{[^}]*(token|key|password|secret|reset|verify|confirm)[^}]*\}""",
     "", "{",
     "A secret travels in a URL parameter"),
    ("python-weak-password-hash", "python/weak-password-hash", "CRITICAL", "password_hash", "CWE-916", "FM", "L",
     r"\bhashlib\.(md5|sha1|sha256|sha512)\(\s*[\w.]*(?i:password|passwd|pwd|secret|credential)[\w.]*\.encode\(\)\s*\)\.hexdigest\(\)",
     "", "hashlib.",
     "A password is hashed with a fast digest"),
    ("python-weak-session-token", "python/weak-session", "HIGH", "session_security", "CWE-330", "F", "L",
     r"^\s*[\w.]*(?i:token|session|key|secret)[\w.]*\s*=\s*(uuid\.uuid4\(\)|random\.random\(\)|random\.randint\(|random\.randrange\()",
     "", "=",
     "A session value is predictable"),
    ("python-xxe-elementtree-parse", "python/xxe", "CRITICAL", "xxe", "CWE-611", "F", "L",
     r"""\b(xml\.etree\.ElementTree|ElementTree|ET)\.parse\(\s*[^"'\s),]+\s*\)""",
     "", ".parse(",
     "XML is parsed with entity expansion enabled"),
    ("python-xxe-lxml-parse", "python/xxe", "CRITICAL", "xxe", "CWE-611", "F", "L",
     r"\betree\.parse\(\s*[^),]+\)",
     "", "etree.parse(",
     "XML is parsed by lxml with entities enabled"),
    ("python-xxe-minidom-parse", "python/xxe", "CRITICAL", "xxe", "CWE-611", "F", "L",
     r"\bminidom\.parse\(\s*[^),]+\)",
     "", "minidom.parse(",
     "XML is parsed by minidom with entities enabled"),
    ("python-zip-slip-zipfile", "python/zip-slip", "CRITICAL", "path_traversal", "CWE-22", "F", "L",
     r"\bzipfile\.ZipFile\([^)]*\)\.extractall\([^)]+\)",
     "", "extractall(",
     "A zip archive is extracted without path checks"),
    ("python-zip-slip-tarfile", "python/zip-slip", "CRITICAL", "path_traversal", "CWE-22", "F", "L",
     r"\btarfile\.open\([^)]*\)\.extractall\([^)]+\)",
     "", "extractall(",
     "A tar archive is extracted without path checks"),
    ("shell-curl-pipe-bash", "shell/curl-pipe-bash", "CRITICAL", "supply_chain", "CWE-494", "FMC", "L",
     r"(?i)(curl|wget)[^\n|]*\|\s*(bash|sh)",
     "", "|",
     "A download is piped into a shell"),
    ("shell-missing-errexit", "shell/missing-errexit", "HIGH", "script_hardening", "CWE-390", "F", "F",
     r"(?m)^#!\s*/bin/(bash|sh)",
     r"(?m)^set\s+-e(\s|$)|^set\s+-euo\s+pipefail", "#!",
     "A script goes on after a failed command"),
    ("shell-chmod-777", "shell/overpermissive-chmod", "MEDIUM", "permissions", "CWE-732", "F", "L",
     r"chmod\s+(777|666|a\+rwx|o\+w)\b",
     "", "chmod",
     "File permissions are open to everyone"),
    ("sql-missing-rls", "sql/missing-rls", "CRITICAL", "authorization", "CWE-284", "F", "B",
     r"(?i)CREATE\s+TABLE",
     r"(?i)ENABLE\s+ROW\s+LEVEL\s+SECURITY", "",
     "A table is created without row-level security"),
    ("ts-client-side-auth", "typescript/client-side-auth", "CRITICAL", "authorization", "CWE-602", "F", "F",
     r"\{\s*(isAdmin|isAuthenticated|userRole|isLoggedIn|hasPermission)\s*&&\s*<",
     "", "&&",
     "Access is decided in the browser by a rendering flag"),
    ("ts-missing-server-validation", "typescript/missing-server-validation", "HIGH", "input_validation", "CWE-20", "F", "F",
     r'(?s)"use server".*async\s+function\s+\w+\s*\([^)]*(FormData|Request)[^)]*\)',
     r"\.(parse|safeParse)\s*\(", "use server",
     "A server action does not validate its input"),
    ("ts-sqli-template-literal", "typescript/sqli", "CRITICAL", "sqli", "CWE-89", "FM", "L",
     r"\bgetRepository\([^)]*\)\.query\(\s*`[^`]*\$\{|\bprisma\.\$executeRawUnsafe\(\s*`[^`]*\$\{|\w\.execute\(\s*sql`[^`]*\$\{",
     "", "`",
     "SQL is built from a template literal"),
    ("ts-type-assertion-bypass", "typescript/type_assertion_bypass", "MEDIUM", "type_assertion_bypass", "CWE-704", "F", "L",
     r"\b(execute|query|run|open|readFile|fetch|request|eval)\(\s*[\w.]+\s+as\s+any\b",
     "", "any",
     "A type assertion hides the type of outside data"),
    # Rules known by their contract only; predicates are our own.
    ("python-hardcoded-secret", "python/secrets", "CRITICAL", "secrets", "CWE-798", "FMC", "L",
     r"""^\s*[\w.]*(?i:password|passwd|pwd|secret|api_key|apikey|token|private_key|credentials|stripe|sendgrid|twilio|aws|jwt|database_url|mongo|redis|smtp|mailgun|slack|discord|webhook)\w*\s*(:\s*\w+\s*)?=\s*["'][^"']{8,}["']""",
     r"(?i)(YOUR_|<|>|XXXX|example|placeholder|changeme|todo|fixme|replace)", "=",
     "A credential is written in the source"),
    ("js-hardcoded-secret", "javascript/secrets", "CRITICAL", "secrets", "CWE-798", "FMC", "L",
     r"""(?i)\b(const|let|var)\s+\w*(password|passwd|pwd|secret|api_key|apikey|token|private_key|credentials|stripe|sendgrid|twilio|aws|jwt|database_url|mongo|redis|smtp|mailgun|slack|discord|webhook)\w*\s*(:\s*\w+\s*)?=\s*["'`][^"'`]{8,}["'`]""",
     r"(?i)(YOUR_|<|>|XXXX|example|placeholder|changeme|todo|fixme|replace)", "=",
     "A credential is written in the source"),
    ("python-default-credentials", "python/default-credentials", "HIGH", "secrets", "CWE-1392", "F", "L",
     r"""(?i)password\s*=\s*["'](admin|password|root|test)\w*["']""",
     "", "=", "A default password is written in the source"),
    ("gha-secret-echo", "github-actions/secret-echo", "CRITICAL", "secrets", "CWE-532", "FM", "L",
     r"echo .*\$\{\{\s*secrets\.", "", "secrets.", "A workflow step prints a secret"),
    ("python-permissive-chmod", "python/permissive-chmod", "MEDIUM", "permissions", "CWE-732", "F", "L",
     r"\bos\.chmod\([^,]+,\s*0o?777\b", "", "os.chmod(", "File permissions are open to everyone"),
    ("python-weak-digest", "python/weak-digest", "MEDIUM", "crypto", "CWE-328", "F", "L",
     r"\bhashlib\.md5\(", "", "hashlib.md5(", "MD5 is used as a digest"),
    ("python-missing-tls", "python/missing-tls", "MEDIUM", "transport", "CWE-319", "F", "B",
     r"\bapp\.run\(", r"ssl_context", "app.run(", "An application with a login route starts without TLS"),
]

RULES = [Rule(*row) for row in _ROWS]

# Advice by category, in our own words.
FIX_GUIDANCE = {
    "supply_chain": "Pin what is downloaded and check it before it runs",
    "container_security": "Add a USER line with an unprivileged account",
    "authorization": "Decide access on the server with the narrowest grant",
    "business_logic": "Compute amounts on the server",
    "header_injection": "Strip line breaks before a value reaches a header",
    "csrf": "Send an anti-forgery token with each state change",
    "crypto": "Use an authenticated mode and a cryptographic random source",
    "eval": "Parse the input instead of running it",
    "graphql_injection": "Pass values as query variables",
    "log_injection": "Log values as parameters after escaping line breaks",
    "security_headers": "Install the middleware that sets security headers",
    "nosql_injection": "Read single fields of the request and check their types",
    "open_redirect": "Redirect only to targets on an allow list",
    "privacy": "Keep personal data out of log lines",
    "prototype_pollution": "Copy only known keys",
    "sqli": "Use bound parameters",
    "secrets": "Read credentials from the environment or a vault and rotate this one",
    "xss": "Escape the value or set text content",
    "auth": "Verify signatures and compare secrets in constant time",
    "cmdi": "Pass an argument list without a shell",
    "cors": "List the allowed origins",
    "debug_mode": "Turn debug off outside development",
    "deserial": "Use a data-only format",
    "error_exposure": "Return a generic error and log the detail",
    "html_injection": "Escape the value or render a template",
    "idor": "Check that the record belongs to the caller",
    "mass_assign": "Name the fields that may be set",
    "rate_limit": "Limit attempts per client",
    "path_traversal": "Resolve the path and check that it stays in its folder",
    "data_protection": "Encrypt the field",
    "race_condition": "Do the check and the update in one transaction",
    "redos": "Use fixed patterns or a linear-time engine",
    "ssrf": "Check the host against an allow list",
    "ssti": "Render template files, pass values as context",
    "token_exposure": "Send the value in a header or body",
    "password_hash": "Use a slow password hash",
    "session_security": "Use a cryptographic token generator",
    "xxe": "Use a parser that refuses entities",
    "script_hardening": "Start the script with set -euo pipefail",
    "permissions": "Grant the narrowest mode",
    "input_validation": "Validate input with a schema on the server",
    "type_assertion_bypass": "Narrow the type with a check",
    "transport": "Serve over TLS",
    "prompt_injection": "Remove the text and report the package it came with",
}
