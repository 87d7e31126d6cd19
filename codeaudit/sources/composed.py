"""Rules with the reference's composition, given as rows: alternatives, captures, places around."""

from __future__ import annotations

from codeaudit.operators.patterns import Description, Node

_SIDE = r"[\w.\[\]\"']+"

COMPOSED = [
    Node("composed-timing-unsafe-compare", 0, None, "all"),
    Node("composed-timing-unsafe-compare", 1, 0, "any"),
    Node("composed-timing-unsafe-compare", 2, 1, "regex", rf"(?<TOKEN>{_SIDE})[ \t]*==[ \t]*(?<INPUT>{_SIDE})",
         keyword="=="),
    Node("composed-timing-unsafe-compare", 3, 1, "regex", rf"(?<INPUT>{_SIDE})[ \t]*==[ \t]*(?<TOKEN>{_SIDE})",
         keyword="=="),
    Node("composed-timing-unsafe-compare", 4, 0, "where",
         "(?i)token|secret|key|password|passwd|pwd|auth|credential|hash|digest|signature|nonce", capture="TOKEN"),
    Node("composed-idor", 0, None, "all"),
    Node("composed-idor", 1, 0, "regex",
         r"db\.query\((?<MODEL>\w+)\)\.filter\(\k<MODEL>\.id[ \t]*==[ \t]*(?<ID>\w+)\)", keyword="db.query("),
    Node("composed-idor", 2, 0, "where", "(?i)id", capture="ID"),
    Node("composed-idor", 3, 0, "indented", r"if[ \t]+current_user\.id[ \t]*==[ \t]*(?<ID>\w+)[ \t]*:", "not-inside",
         keyword="current_user.id"),
    Node("composed-idor", 4, 0, "indented", r"""if[ \t]+session\["user_id"\][ \t]*==[ \t]*(?<ID>\w+)[ \t]*:""", "not-inside",
         keyword="user_id"),
    Node("composed-object-assign", 0, None, "any"),
    Node("composed-object-assign", 1, 0, "regex", r"Object\.assign\(\s*[^,()]+,\s*\w+\.body\s*\)", keyword="Object.assign("),
    Node("composed-object-assign", 2, 0, "all"),
    Node("composed-object-assign", 3, 2, "regex", r"Object\.assign\(\s*[^,()]+,\s*(?<DATA>\w+)\s*\)", keyword="Object.assign("),
    Node("composed-object-assign", 4, 2, "braced", r"function\s*\w*\s*\((?<DATAList>[^)]*)\)\s*\{", "inside",
         keyword="function"),
    Node("composed-object-assign", 5, 0, "all"),
    Node("composed-object-assign", 6, 5, "regex", r"Object\.assign\(\s*[^,()]+,\s*(?<DATA>\w+)\s*\)", keyword="Object.assign("),
    Node("composed-object-assign", 7, 5, "braced", r"\((?<DATA>\w+)\)\s*=>\s*\{", "inside", keyword="=>"),
]

DESCRIPTIONS = [
    Description("composed-timing-unsafe-compare", ("python",), "MEDIUM", "auth", "CWE-208",
                "A secret is compared with ==", "Compare with hmac.compare_digest"),
    Description("composed-idor", ("python",), "CRITICAL", "idor", "CWE-639",
                "A record is looked up by an id without an owner check", "Check that the record belongs to the caller"),
    Description("composed-object-assign", ("javascript", "typescript"), "HIGH", "prototype_pollution", "CWE-1321",
                "Outside data is merged into an object", "Copy only known keys"),
]
