"""Each rule on texts it must and must not hit; conditions around statements on their own."""

import os
import re

import pytest
from pyspark.sql import functions as F

from codeaudit.operators.code import with_code, with_resolved_statements, with_statements
from codeaudit.operators.rules import BLOCK_CONDITIONS, OPENINGS, listed_rules, located, rule_table, with_rule_hits
from codeaudit.plans import scan
from codeaudit.sources.catalogue import RULES, TIER_NAMES

from conftest import ROOT

FILE_FOR = {
    "dockerfile": "Dockerfile", "github-actions": "a.yml", "javascript": "a.js",
    "kubernetes": "a.yaml", "python": "a.py", "shell": "a.sh", "sql": "a.sql", "typescript": "a.ts",
}
BY_ID = {r.rule_id: r for r in RULES}
# Rules whose hit also depends on the lines around it have cases of their own below.
AROUND = set(BLOCK_CONDITIONS) | {"js-prototype-pollution-unsafe-assign"}


def probes():
    """(rule, text, expected) from the table of probe texts."""
    out = []
    section = open(os.path.join(ROOT, "FIXTURES.md")).read().split("## C.")[1]
    for line in section.splitlines():
        cells = re.split(r"(?<!\\) \| |^\| | \|$", line)
        cells = [c for c in cells if c]
        if len(cells) != 3 or cells[0] not in BY_ID or cells[0] in AROUND:
            continue
        for cell, expected in ((cells[1], True), (cells[2], False)):
            for item in cell.split(" <br> "):
                m = re.fullmatch(r"`` (.*) ``|`(.*)`", item.strip())
                text = (m.group(1) or m.group(2)).replace("⏎", "\n").replace(r"\|", "|")
                out.append((cells[0], text.replace("<40 hex>", "a" * 40) + "\n", expected))
    return out


PROBES = probes()

CONTEXT = [
    ("python-crlf-injection", 'response.headers["A"] = request.args.get("v")\n', True),
    ("python-crlf-injection", 'v = v.replace("\\r", "")\nresponse.headers["A"] = request.args.get("v")\n', False),
    ("python-debug-mode-outside-main-guard", "app.run(debug=True)\n", True),
    ("python-debug-mode-outside-main-guard", 'if __name__ == "__main__":\n    app.run(debug=True)\n', False),
    ("python-debug-mode-outside-main-guard", "def main():\n    app.run(debug=True)\n", True),
    ("python-idor", "db.query(User).filter(User.id == user_id)\n", True),
    ("python-idor", "db.query(User).filter(Other.id == user_id)\n", False),
    ("python-idor", "if current_user.id == user_id:\n    db.query(User).filter(User.id == user_id)\n", False),
    ("python-idor", "if current_user.id == other_id:\n    db.query(User).filter(User.id == user_id)\n", True),
    ("python-missing-rate-limit", '@app.route("/l")\ndef login():\n    pass\n', True),
    ("python-missing-rate-limit", '@app.route("/l")\n@limiter.limit("5/m")\ndef login():\n    pass\n', False),
    ("python-missing-rate-limit", '@app.route("/l")\ndef other():\n    pass\n\ndef login():\n    pass\n', False),
    ("python-race-condition-balance", "if a.balance >= n:\n    a.withdraw(n)\n", True),
    ("python-race-condition-balance", "if a.balance >= n:\n    return n\na.withdraw(n)\n", False),
    ("python-race-condition-balance", "with db.transaction():\n    if a.balance >= n:\n        a.withdraw(n)\n", False),
    ("python-race-condition-balance", "with db.transaction():\n    pass\nif a.balance >= n:\n    a.withdraw(n)\n", True),
    ("sql-missing-rls", "CREATE TABLE t (id int);\n", True),
    ("sql-missing-rls", "CREATE TABLE t (id int);\nALTER TABLE t ENABLE ROW LEVEL SECURITY;\n", False),
    ("sql-missing-rls", "ALTER TABLE s ENABLE ROW LEVEL SECURITY;\nCREATE TABLE t (id int);\n", True),
    ("python-missing-tls", '@app.route("/login")\ndef a():\n    pass\napp.run(port=1)\n', True),
    ("python-missing-tls", '@app.route("/login")\ndef a():\n    pass\napp.run(ssl_context=c)\n', False),
    ("python-missing-tls", "app.run(port=1)\n", False),
    ("js-prototype-pollution-unsafe-assign", "Object.assign(t, req.body);\n", True),
    ("js-prototype-pollution-unsafe-assign", "Object.assign(t, data);\n", False),
    ("js-prototype-pollution-unsafe-assign", "function f(t, data) { Object.assign(t, data); }\n", True),
    ("js-prototype-pollution-unsafe-assign", "const f = data => Object.assign(t, data);\n", True),
    ("dockerfile-missing-user", "FROM a\n", True),
    ("dockerfile-missing-user", "FROM a\nUSER root\n", True),
    ("dockerfile-missing-user", "FROM a\nuser app\n", False),
    ("dockerfile-curl-pipe-bash", "FROM a\nrun curl u | sh\n", True),
    ("python-log-injection", 'logger.info(f"start {VERSION}")\n', False),
    ("python-hardcoded-secret", 'API_KEY = "abcd1234efgh"\n', True),
    ("python-hardcoded-secret", 'API_KEY = "YOUR_API_KEY_HERE"\n', False),
    ("python-hardcoded-secret", 'api_key = os.environ["API_KEY"]\n', False),
    ("js-hardcoded-secret", "const jwtSecret = 'abcd1234efgh';\n", True),
    ("js-hardcoded-secret", "const name = 'abcd1234efgh';\n", False),
    ("python-default-credentials", 'password = "admin123"\n', True),
    ("python-default-credentials", 'password = read()\n', False),
    ("gha-secret-echo", "  - run: echo ${{ secrets.KEY }}\n", True),
    ("gha-secret-echo", "  - run: echo done\n", False),
    ("python-permissive-chmod", "os.chmod(p, 0o777)\n", True),
    ("python-permissive-chmod", "os.chmod(p, 0o640)\n", False),
    ("python-weak-digest", "hashlib.md5(b)\n", True),
    ("python-weak-digest", "hashlib.sha256(b)\n", False),
    ("python-sqli-fstring", '# c.execute(f"SELECT {x}")\n', False),
    ("python-ssrf-user-controlled-url", "import requests as r\nr.get(url)\n", True),
]


@pytest.fixture(scope="module")
def hit_ids(spark, make_files):
    cases = PROBES + CONTEXT
    rows = [
        (f"d{i}/{FILE_FOR[BY_ID[rule].pack.split('/')[0]]}", text)
        for i, (rule, text, _) in enumerate(cases)
    ]
    model = with_resolved_statements(with_statements(with_code(make_files(rows))))
    got = with_rule_hits(model).select("file_id", F.explode("rule_hits.rule_id").alias("r")).collect()
    hits = {i: set() for i in range(len(cases))}
    for r in got:
        hits[r.file_id].add(r.r)
    return hits


@pytest.fixture(scope="module")
def probe_rows(spark, make_files):
    """rule -> {case: (places, text)} of the cases made for that rule."""
    cases = PROBES + CONTEXT
    rows = [
        (f"d{i}/{FILE_FOR[BY_ID[rule].pack.split('/')[0]]}", text)
        for i, (rule, text, _) in enumerate(cases)
    ]
    model = with_rule_hits(with_resolved_statements(with_statements(with_code(make_files(rows)))))
    out = {}
    for r in located(model.select("file_id", "rule_hits"), spark).collect():
        if cases[r.file_id][0] == r.rule_id:
            places = out.setdefault(r.rule_id, {}).setdefault(r.file_id, ([], cases[r.file_id][1]))
            places[0].append((r.line, r.col))
    return out


def test_probe_table_is_read():
    assert len(PROBES) >= 180
    assert len({p[0] for p in PROBES + CONTEXT}) == len(RULES)


@pytest.mark.parametrize(
    "i", range(len(PROBES + CONTEXT)), ids=[f"{c[0]}-{i}" for i, c in enumerate(PROBES + CONTEXT)]
)
def test_rule(hit_ids, i):
    rule, text, expected = (PROBES + CONTEXT)[i]
    assert (rule in hit_ids[i]) == expected, text


def test_each_rule_has_a_hit_and_a_miss():
    for expected in (True, False):
        covered = {rule for rule, _, e in PROBES + CONTEXT if e is expected}
        assert covered == set(BY_ID), set(BY_ID) - covered


def test_keywords_never_hide_a_case_insensitive_match():
    for r in RULES:
        if r.positive.startswith("(?i"):
            assert r.keyword.lower() == r.keyword.upper(), r.rule_id


def test_position_and_snippet(spark, make_files):
    text = "import x\n\ncursor.execute(\n    f\"SELECT {a}\"\n)\nif True:\n    app.run(\n        debug=True)\n"
    files = make_files([("a.py", text)])
    model = with_rule_hits(with_resolved_statements(with_statements(with_code(files))))
    rows = {
        r.rule_id: (r.line, r.col, r.snippet)
        for r in located(model.select("file_id", "rule_hits"), spark).collect()
    }
    assert rows["python-sqli-fstring"] == (3, 7, '.execute(\n    f"')
    assert rows["python-debug-mode-enabled"][:2] == (7, 5)


def test_places_are_found_in_linear_time(spark):
    """Ten thousand matches in one text, over lines and within them."""
    import time

    from codeaudit.operators.rules import _matches_in

    unit = "ab xx\n\nxxy xx é"
    text = unit * 5000
    df = spark.createDataFrame([(text, "x+"), ("none", "x+"), ("", "x"), ("xx", "x*?"), ("a\neval(b)", r"(^|[^.\w])eval\(")], "t string, p string")
    places = df.select("p", F.explode(_matches_in(F.col("t"), F.col("p"))).alias("m"))
    places.count()
    began = time.time()
    got = [(r.p, r.m.breaks, r.m.col, r.m.match) for r in places.collect()]
    assert time.time() - began < 2
    want = []
    for m in re.finditer("x+", text):
        before = text[: m.start()]
        want.append(("x+", before.count("\n"), len(before) - before.rfind("\n"), m[0]))
    assert [g for g in got if g[0] == "x+"] == want and len(want) == 15_000
    assert (r"(^|[^.\w])eval\(", 1, 1, "eval(") in got


@pytest.mark.parametrize("rule", sorted(BY_ID))
def test_one_row_for_one_hit(probe_rows, rule):
    """As many rows as Python's own matcher finds places, and one for a rule on the whole file."""
    rows, wanted = probe_rows.get(rule, {}), 0
    for place, (lines, text) in rows.items():
        assert len(lines) == len(set(lines)), (rule, text)
        assert len(lines) <= max(1, text.count("\n") + text.count("(") + text.count("=") + 1), (rule, text)
        wanted += len(lines)
        if rule == "dockerfile-missing-user":
            assert lines == [(1, 1)]
    assert wanted


def test_tiers_contain_each_other():
    packs = {t: {r.pack for r in RULES if t in r.tier_names} for t in TIER_NAMES}
    assert packs["CRITICAL_ONLY"] < packs["MEDIUM"] < packs["FULL"]
    assert len(packs["MEDIUM"]) == 19 and len(packs["CRITICAL_ONLY"]) == 8


def test_tier_gates_rules(spark, make_files):
    text = "pickle.loads(data)\nsubprocess.run(f\"ls {d}\", shell=True)\nc.execute(f\"S {x}\")\n"
    files = make_files([("a.py", text)])

    def ids(threshold):
        return {r.rule_id for r in scan.rule_findings(files, threshold).collect()}

    assert ids(0.6) == {"python-sqli-fstring"}
    assert ids(0.0) == {"python-sqli-fstring", "python-cmdi-shell-true", "python-deserial-pickle-loads"}


def test_catalogue_filters(spark):
    table = rule_table(spark)
    assert listed_rules(table).count() == len(RULES)
    assert listed_rules(table, language="TypeScript", severity="critical", category="SQLI").count() == 2
    assert all(len(r.description) <= 60 for r in listed_rules(table).collect())


OPENED = {
    "js-pii-in-logs": "console.log(user.email)",
    "python-crlf-injection": 'response.headers["X"] = request.args["a"]',
    "python-missing-rate-limit": "def login():",
    "python-open-redirect": "return redirect(request.args.get('next'))",
    "python-pii-in-logs": 'logger.info(f"{user.email}")',
    "sql-missing-rls": "CREATE  TABLE t (a int);",
}


def test_rules_without_a_keyword_have_an_opening_that_their_matches_hold():
    assert set(OPENINGS) == {r.rule_id for r in RULES if r.scope in "LB" and not r.keyword} == set(OPENED)
    for rule_id, text in OPENED.items():
        assert re.search(BY_ID[rule_id].positive, text) and re.search(OPENINGS[rule_id], text)
