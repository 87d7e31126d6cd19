"""Signals on literal sources, and against brute force over Python's parser."""

import ast
import statistics

import pytest
from pyspark.sql import functions as F

from codeaudit.operators import signals
from codeaudit.plans import scan
from codeaudit.sources.constants import STOCK_NAMES
from codeaudit.sources.snippets import REGULAR_SERVICE, SNIPPETS

from test_code import EXTRA, PYTHON

CASES = [
    ("heading", "def f():\n    '''x\n\n    Args:\n    '''\n", "c_headings", 0.25),
    ("underline", "def f():\n    '''x\n\n    Parameters\n    ----------\n    '''\n", "c_underline", 0.20),
    ("todo", "# TODO: implement the rest\n", "c_todo", 0.20),
    ("no_todo", "# TODO: think\n", "c_todo", 0.0),
    ("density", "# a\nx = 1\n", "c_density", 0.10),
    ("thin", "# a\nx = 1\ny = 2\nz = 3\n", "c_density", 0.0),
    ("restating", "# add the order total value to result now\ntotal = order + value\nresult = total\n",
     "c_restating", 0.05),
    ("restating_far", "# add the order total value to result now\n\n\n\ntotal = order + value\n",
     "c_restating", 0.0),
    ("swallow", "try:\n    f()\nexcept Exception as e:\n    pass\n", "t_swallowed", 0.25),
    ("swallow_in_text", "x = 'except Exception as e:'\n", "t_swallowed", 0.0),
    ("assign_return", "def f(a):\n    b = a + 1\n    return b\n", "t_assign_return", 0.15),
    ("assign_reused", "def f(a):\n    b = 0\n    b = b + a\n    return b\n", "t_assign_return", 0.0),
    ("guards", "def f(a, b):\n    if not isinstance(a, int):\n        raise X\n    if not isinstance(b, int):\n        raise X\n    return a\n",
     "t_guards", 0.15),
    ("late_guards", "def f(a, b):\n    x = 1\n    y = 2\n    z = 3\n    isinstance(a, int)\n    isinstance(b, int)\n    return x\n",
     "t_guards", 0.0),
    ("double_import", "from m import *\nfrom m import a, b\n", "t_double_import", 0.15),
    ("single_import", "from m import *\nfrom n import a\n", "t_double_import", 0.0),
    ("gets", "def f(d):\n    return d.get(1), d.get(2), d.get(3)\n", "t_gets", 0.10),
    ("gets_and_subscript", "def f(d):\n    return d.get(1), d.get(2), d.get(3), d['x']\n", "t_gets", 0.0),
    ("annotated", "def f(a: int, b: dict[str, int]):\n    x: int = a\n    return x\n", "t_annotated", 0.05),
    ("half_annotated", "def f(a: int, b):\n    x: int = a\n    return x\n", "t_annotated", 0.0),
    ("stock", "data = 1\nresult = 2\nresponse = 3\nconfig, token = 4, 5\n", "s_stock", 0.25),
    ("keyword_arguments", "f(\n    data=1,\n    result=2,\n)\n", "s_stock", 0.0),
    ("uniform", "class A:\n    def a(self): pass\n\nclass B:\n    def b(self): pass\n", "s_uniform", 0.25),
]


@pytest.fixture(scope="module")
def scored(spark, make_files):
    rows = [(f"{name}.py", text) for name, text, _, _ in CASES]
    df = signals.with_features(signals.code_model(make_files(rows)))
    names = [c for c in df.columns if c[:2] in ("c_", "s_", "t_")]
    return {r.rel_path[:-3]: r for r in df.select("rel_path", *names).collect()}


@pytest.mark.parametrize("name,text,feature,expected", CASES, ids=[c[0] for c in CASES])
def test_feature(scored, name, text, feature, expected):
    assert scored[name][feature] == expected


def test_empty_and_other_languages(make_files):
    files = make_files([("a.py", ""), ("b.py", "  \n"), ("c.js", "function f(a, b) { }\n"), ("d.py", "def (:\n")])
    for r in signals.detect(files).collect():
        assert (r.confidence, r.scan_tier, r.is_ai) == (0.0, "CRITICAL_ONLY", False)


def test_regular_and_irregular_modules(make_files):
    irregular = next(c for _, n, _, c in SNIPPETS if n == "legacy.py")
    rows = signals.detect(make_files([("a.py", REGULAR_SERVICE), ("b.py", irregular)]))
    got = {r.path[-4:]: (r.confidence, r.scan_tier) for r in rows.collect()}
    assert got["a.py"][0] >= 0.55 and got["a.py"][1] == "FULL"
    assert got["b.py"][0] <= 0.40 and got["b.py"][1] == "CRITICAL_ONLY"


def test_tier_thresholds(spark):
    df = spark.createDataFrame([(0.6,), (0.59,), (0.3,), (0.29,)], "c double")
    tiers = [r.t for r in df.select(signals.scan_tier(F.col("c")).alias("t")).collect()]
    assert tiers == ["FULL", "MEDIUM", "MEDIUM", "CRITICAL_ONLY"]
    low = df.select(signals.scan_tier(F.col("c"), 0.25).alias("t")).collect()
    assert {r.t for r in low} == {"FULL"}


def brute_force(text):
    tree = ast.parse(text)
    functions = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    span = {id(f): f.end_lineno - f.lineno + 1 for f in functions}
    lengths = [span[id(f)] for f in functions if span[id(f)] > 3]
    variation = (
        statistics.pstdev(lengths) / statistics.fmean(lengths) if len(lengths) >= 3 else None
    )
    public = [f for f in functions if not f.name.startswith("_") and span[id(f)] > 5]
    share = (
        sum(ast.get_docstring(f) is not None for f in public) / len(public)
        if len(public) >= 2 else None
    )
    stock = 0
    for node in ast.walk(tree):
        targets = []
        if isinstance(node, ast.Assign):
            targets = node.targets
        elif isinstance(node, ast.AnnAssign):
            targets = [node.target]
        for t in targets:
            names = t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]
            stock += sum(isinstance(n, ast.Name) and n.id in STOCK_NAMES for n in names)
    counts = [
        sum(isinstance(s, ast.FunctionDef) for s in c.body)
        for c in ast.walk(tree) if isinstance(c, ast.ClassDef)
    ]
    return variation, share, stock, sorted(counts)


def test_structure_equals_brute_force(make_files):
    cases = [c for c in PYTHON + EXTRA if c[1]]
    df = signals.code_model(make_files(cases)).select(
        "file_id",
        signals.length_variation(signals.function_lengths()).alias("variation"),
        signals.documented_share().alias("share"),
        signals.stock_name_count().alias("stock"),
        F.sort_array(signals.class_method_counts()).alias("counts"),
    )
    got = {r.file_id: r for r in df.collect()}
    for i, (path, text) in enumerate(cases):
        variation, share, stock, counts = brute_force(text)
        r = got[i]
        assert (r.variation is None) == (variation is None), path
        assert variation is None or abs(r.variation - variation) < 1e-5, path
        assert (r.share is None) == (share is None), path
        assert share is None or abs(r.share - share) < 1e-5, path
        assert (r.stock, r.counts) == (stock, counts), path


def test_signals_of_the_callers_own(spark, make_files):
    files = make_files([("a.py", "x = 1  # robot\n"), ("b.py", "x = 1\n")])
    own = [
        signals.Signal("robot", "comments", lambda: F.when(F.col("content").contains("robot"), 0.9)),
        signals.Signal("long", "tokens", lambda: F.size("raw") * 5.0),
    ]
    plain = {r.path: r for r in signals.detect(files).collect()}
    got = {r.path: r for r in signals.detect(files, own=own).collect()}
    assert {p: (r.comments, r.tokens) for p, r in got.items()} == {
        "r/p/a.py": (0.9, 1.0), "r/p/b.py": (0.0, 1.0)}
    assert got["r/p/a.py"].confidence > got["r/p/b.py"].confidence > plain["r/p/b.py"].confidence
    results, _ = scan.scanned(files, signals=own)
    assert {r.path: r.confidence for r in results.collect()} == {p: r.confidence for p, r in got.items()}


def test_signal_of_an_unknown_kind():
    with pytest.raises(ValueError):
        signals.Signal("x", "taste", lambda: F.lit(1.0))
