"""Unified diffs of line replacements against the standard library's."""

import difflib

from codeaudit.operators import findings as fx

TEN = [f"line {i}" for i in range(1, 31)]
CASES = [
    (TEN, {5: "new"}),
    (TEN, {1: "new", 30: "last"}),
    (TEN, {5: "a", 12: "b"}),
    (TEN, {5: "a", 13: "b"}),
    (TEN, {5: "a", 6: "b", 7: "c"}),
    (TEN, {5: "a\nb\nc", 20: "d"}),
    (TEN, {5: "import x\nline 5"}),
    (TEN, {5: "line 5\nafter", 6: "z"}),
    (TEN, {3: "", 25: "x\ny"}),
    (["only"], {1: "other"}),
    (["a", "b"], {2: "c\nd"}),
    (TEN, {5: "line 5", 99: "x", 0: "y"}),
]


def test_diffs_equal_the_standard_ones(spark, make_files):
    files = make_files([(f"f{i}.py", "\n".join(lines) + "\n") for i, (lines, _) in enumerate(CASES)])
    fixes = [(f"r/p/f{i}.py", n, text) for i, (_, fix) in enumerate(CASES) for n, text in fix.items()]
    table = spark.createDataFrame(fixes, "file_path string, line int, new_text string")
    got = {r.file_path: r["diff"] for r in fx.fix_diffs(files, table).collect()}
    for i, (lines, fix) in enumerate(CASES):
        path, new = f"r/p/f{i}.py", []
        for n, line in enumerate(lines, 1):
            new += fix.get(n, line).split("\n")
        old = [x + "\n" for x in lines]
        want = "".join(difflib.unified_diff(old, [x + "\n" for x in new], f"a/{path}", f"b/{path}", n=3))
        assert got.get(path, "") == want, (i, got.get(path), want)
    assert len(got) == len(CASES) - 1
    assert fx.fix_diffs(files, table.limit(0)).count() == 0
