"""Folder trees with hidden names: what Spark's readers see and what they pass over."""

import os

import pytest
from pyspark.sql import functions as F

from codeaudit.operators import envfiles
from codeaudit.plans import scan
from codeaudit.sources.corpus import hidden_files, scan_tree
from codeaudit.sources.tree import TreeReader, is_hidden, tree_reader

FILES = {
    "app.py": b"import os\n",
    ".env": b"API_KEY=q8Zr41nnBd77xwPs02LmTt\nDEBUG=1\n",
    ".env.local": b"DB_PASSWORD='zX9wQ2mN5vB8kL1pR4tY7uI0'\n",
    ".gitignore": b"# nothing\n*.pyc\n.env.local\n",
    ".github/workflows/ci.yml": b"steps:\n  - uses: a/b@v1\n",
    "_private/mod.py": b"eval(x)\n",
    "pkg/_init.py": b"exec(y)\n",
    "pkg/deep/.claude/settings.json": b'{"token": "caf\xe9"}',
    "pkg/plain.js": b"a\n",
    ".git/config": b"[core]\n",
    "node_modules/x/.env": b"A=b\n",
    "lib.egg-info/.hidden": b"x\n",
    "empty/.keep": b"",
}


@pytest.fixture
def tree(tmp_path):
    for name, content in FILES.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(content)
    os.symlink(tmp_path / "r", tmp_path / "r" / "pkg" / ".loop")
    return str(tmp_path / "r")


SEEN = {n for n in FILES if not n.startswith((".git/", "node_modules", "lib.egg-info"))}


def test_whole_tree(spark, tree):
    files = scan_tree(spark, tree).collect()
    assert {f.rel_path for f in files} == SEEN and len(files) == len(SEEN)
    assert len({f.file_id for f in files}) == len(files)
    by_path = {f.rel_path: f for f in files}
    assert by_path["pkg/deep/.claude/settings.json"].content == '{"token": "caf�"}'
    assert by_path["empty/.keep"].content == "" and by_path["app.py"].language == "python"
    plain = {f.rel_path for f in scan_tree(spark, tree, hidden=False).collect()}
    assert plain == {"app.py", "pkg/plain.js"}


def test_environment_files_of_a_tree(spark, tree):
    files = scan_tree(spark, tree)
    secrets = {(r.path.rsplit("/", 1)[1], r.key) for r in envfiles.env_secrets(files).collect()}
    assert (".env", "API_KEY") in secrets
    assert [r.file_name for r in envfiles.env_not_ignored(files).collect()] == [".env"]
    found = {(r.rule_id, r.file_path[len(tree) + 1:]) for r in scan.scan(files, threshold=0.0, minimum_severity="LOW").collect()}
    assert ("env-exposed-secret", ".env") in found and any(p == "pkg/_init.py" for _, p in found)


def test_single_files_and_missing_roots(spark, tree, tmp_path):
    one = scan_tree(spark, f"{tree}/.env").collect()
    assert [(f.file_name, f.rel_path) for f in one] == [(".env", ".env")]
    assert hidden_files(spark, f"{tree}/app.py").count() == 0
    (tmp_path / "void").mkdir()
    assert scan_tree(spark, str(tmp_path / "void")).count() == 0


@pytest.mark.parametrize("parts", ["1", "3", "64"])
def test_every_file_once_however_many_parts(spark, tree, parts):
    rows = tree_reader(spark).option("path", tree).option("parts", parts).load().collect()
    assert sorted(r.below for r in rows) == sorted(FILES)
    assert all(r.content == FILES[r.below] and r.length == len(r.content) for r in rows)


def test_conditions_on_names_are_pushed_down(spark, tree):
    source = tree_reader(spark).option("path", tree).load()
    plan = source.where(F.col("file_name").isin(".env", ".gitignore"))
    assert sorted(r.below for r in plan.collect()) == [".env", ".gitignore", "node_modules/x/.env"]
    assert sorted(r.below for r in source.where("file_name LIKE '.env%'").collect()) == [
        ".env", ".env.local", "node_modules/x/.env"
    ]
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = TreeReader({"path": tree})
    given = [EqualTo(("file_name",), ".env"), GreaterThan(("length",), 3)]
    assert list(reader.pushFilters(given)) == given  # Spark applies them again
    assert reader.wants(".env") and not reader.wants("app.py")


def test_wide_folders_are_shared_out(tree, tmp_path):
    for i in range(30):
        (tmp_path / "w" / f"d{i}" / "s").mkdir(parents=True)
    reader = TreeReader({"path": str(tmp_path / "w"), "parts": "8"})
    parts = reader.partitions()
    assert 4 <= len(parts) <= 8 and sum(len(p.places) for p in parts) == 31


def test_hidden_names():
    assert is_hidden(".env") and is_hidden("_tmp") and is_hidden("a._COPYING_")
    assert not is_hidden("_a=b") and not is_hidden("_metadata") and not is_hidden("a.b")
