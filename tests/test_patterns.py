"""Rules given as rows: alternatives, places inside others, captures that must agree."""

from codeaudit.operators import patterns
from codeaudit.operators.patterns import Description, Node, matches
from codeaudit.plans import scan
from codeaudit.sources.composed import COMPOSED, DESCRIPTIONS

AUTH = [n for n in COMPOSED if n.rule_id == "composed-timing-unsafe-compare"]
IDOR = [n for n in COMPOSED if n.rule_id == "composed-idor"]
PROTO = [n for n in COMPOSED if n.rule_id == "composed-object-assign"]
LANGUAGES = {d.rule_id: d.languages for d in DESCRIPTIONS}


def found(make_files, name, texts, nodes):
    """The places found in each of the texts."""
    rows = matches(make_files([(f"d{i}/{name}", text) for i, text in enumerate(texts)]), nodes, LANGUAGES)
    out = [set() for _ in texts]
    for r in rows.collect():
        out[r.file_id].add((r.rule_id, r.line, r.col))
    return [sorted(places) for places in out]


PYTHON = [
    ("if api_token == given:\n    pass\n", [("composed-timing-unsafe-compare", 1, 4)]),
    ("x = 1\nok = given == api_token\n", [("composed-timing-unsafe-compare", 2, 6)]),
    ("if a == b:\n    pass\n", []),
    ("db.query(User).filter(User.id == user_id)\n", [("composed-idor", 1, 1)]),
    ("db.query(User).filter(Other.id == user_id)\n", []),
    ("db.query(User).filter(User.id == name)\n", []),
    ("if current_user.id == user_id:\n    x = 1\n\n    db.query(User).filter(User.id == user_id)\n", []),
    ("if current_user.id == other_id:\n    db.query(User).filter(User.id == user_id)\n", [("composed-idor", 2, 5)]),
    ("if current_user.id == user_id:\n    pass\ndb.query(User).filter(User.id == user_id)\n", [("composed-idor", 3, 1)]),
    ('def f():\n  if session["user_id"] == uid:\n    db.query(A).filter(A.id == uid)\n  db.query(B).filter(B.id == uid)\n',
     [("composed-idor", 4, 3)]),
]


def test_python_rules(make_files):
    texts, want = zip(*PYTHON)
    assert found(make_files, "a.py", texts, COMPOSED) == list(want)


JAVASCRIPT = [
    ("Object.assign(t, req.body)\n", [("composed-object-assign", 1, 1)]),
    ("Object.assign(t, data)\n", []),
    ("function f(t, data, x) {\n  if (x) { y(); }\n  Object.assign(t, data);\n}\n", [("composed-object-assign", 3, 3)]),
    ("function f(t, data) {\n  a();\n}\nObject.assign(t, data);\n", []),
    ("function f(t, other) {\n  Object.assign(t, data);\n}\n", []),
    ("const f = (data) => {\n  Object.assign(t, data);\n}\n", [("composed-object-assign", 2, 3)]),
    ("function f(a) { g((data) => { Object.assign(a, data) }); Object.assign(b, a); }", [("composed-object-assign", 1, 31), ("composed-object-assign", 1, 58)]),
]


def test_javascript_rules(make_files):
    texts, want = zip(*JAVASCRIPT)
    assert found(make_files, "a.js", texts, COMPOSED) == list(want)


def test_languages_gate_leaves(make_files):
    assert found(make_files, "a.js", ["if (api_token == given) {}\n"], AUTH) == [[]]


def test_not_and_a_second_match(make_files):
    nodes = [
        Node("r", 0, None, "all"), Node("r", 1, 0, "regex", r"call\((?<X>\w+)\)"),
        Node("r", 2, 0, "regex", r"call\(safe\)", "not"),
        Node("r", 3, 0, "regex", r"return call\((?<X>\w+)\);"),
    ]
    text = "call(a)\nreturn call(b);\nreturn call(safe);\n"
    rows = matches(make_files([("a.py", text)]), nodes, {}).collect()
    assert [(r.line, r.captures) for r in rows] == [(2, {"X": "b"})]


def test_covering_over_buckets(make_files, monkeypatch):
    monkeypatch.setattr(patterns, "BUCKET", 16)
    body = "".join(f"  call({i});\n" for i in range(200))
    nodes = [
        Node("r", 0, None, "all"), Node("r", 1, 0, "regex", r"call\(\d+\)"),
        Node("r", 2, 0, "braced", r"function\s+big\(\)\s*\{", "inside"),
    ]
    text = f"call(1)\nfunction big() {{\n{body}}}\nfunction small() {{ call(2) }}\n"
    rows = matches(make_files([("a.js", text)]), nodes, {}).collect()
    assert sorted(r.line for r in rows) == list(range(3, 203))


def test_as_a_detector_of_a_scan(make_files):
    described = [Description("composed-idor", ("python",), "CRITICAL", "idor", "CWE-639", "No owner check", "Check it")]
    detector = patterns.pattern_findings(IDOR, described)
    files = make_files([("a.py", "x = 1\ndb.query(User).filter(User.id == user_id)\n")])
    rows = scan.scan(files, detectors=[*scan.PROJECT_DETECTORS, detector]).where("rule_id LIKE 'composed%'").collect()
    assert [(r.rule_id, r.line, r.col, r.severity) for r in rows] == [("composed-idor", 2, 1, "CRITICAL")]


def test_files_without_a_leafs_keyword_are_passed_over(make_files):
    node = Node("r", 0, None, "regex", "a+", keyword="zz")
    rows = matches(make_files([("d0/a.py", "aaa\n"), ("d1/a.py", "b aa zz\n")]), [node], {"r": ("python",)})
    assert [(r.file_id, r.line, r.col) for r in rows.collect()] == [(1, 1, 3)]
