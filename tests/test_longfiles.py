"""Files in buckets give the statements and blocks of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from codeaudit.operators import longfiles
from codeaudit.operators.code import with_blocks, with_code, with_statements
from codeaudit.sources.corpus import corpus_from_documents, read_table
from conftest import DATA

BUILT = [
    ("quotes.py", 'x = """a\n(\nb """ + f(\n  1,\n  2)\ny = \'\'\'c\n\ndef f():\n\'\'\'\nz = 1\n'),
    ("open_text.py", 'x = 1\ny = """a\nb\nc'),
    ("open_text_ended.py", 'def f():\n    y = """a\nb\nc\n'),
    ("brackets.py", "a = (1,\n2,\n3,\n4,\n5,\n6\n)\nb = ))\nc = [\n1\ndef g(\n  a,\n  b\n):\n  return (\n1\n"),
    ("nested.py", "class A:\n  def f(self):\n    def g():\n      pass\n    x = [\n1,\n    ]\n\n  # c\n  def h(self):\n    pass\n\n\n\nasync def k():\n  if x:\n    class B:\n      y = 1\n\n  z = 2\n"),
    ("late.py", "def f():\n" + "    x = 1\n\n" * 12 + "def g(): pass\n" + "\n" * 9),
    ("a.js", "f(() => {\n  a(\n1,\n2);\n}\n);\nif (x) {\n  y(`a`, // (\n   2);\n}\nz = [\n1];"),
    ("b.ts", "const f = (a: number) => {\n\n  return g(a,\n    b);\n};\r\nh();\r\n"),
    ("c.sh", "a\n\n  b (\n\n c"),
    ("empty.py", ""), ("blank.py", "\n\n\n"),
]


def generated(seed):
    """A file of random pieces, many of which open or close something."""
    draw = random.Random(seed)
    pieces = ["x = 1", "", "def f(a):", "class B:", "f(", ")", "[1,", "]", '"""', "# c (", "y = '('", "    ", "'''t'''"]
    return "\n".join(" " * draw.choice((0, 0, 2, 4, 6)) + draw.choice(pieces) for _ in range(150))


def whole(files):
    model = with_blocks(with_statements(with_code(files))).cache()
    st = model.select("file_id", F.inline("statements")).select("file_id", "n", "e", "indent", "text").collect()
    bl = model.select("file_id", F.inline("blocks")).select(
        "file_id", "line", "end", "indent", "kind", "name", "parent_line", "parent_kind").collect()
    model.unpersist()
    return sorted(map(tuple, st)), sorted(map(tuple, bl))


def split(buckets):
    return tuple(
        sorted(map(tuple, rows.collect())) for rows in (longfiles.statements(buckets), longfiles.blocks(buckets))
    )


@pytest.mark.parametrize("lines", [1, 7])
def test_buckets_equal_whole_files(spark, make_files, lines):
    files = make_files(BUILT + [(f"r{i}.py", generated(i)) for i in range(30)])
    want = whole(files)
    assert want[0] and want[1]
    assert split(longfiles.buckets_of(files, lines)) == want


def test_corpus_in_buckets(spark):
    files = corpus_from_documents(read_table(spark, f"{DATA}/sf0.001", "documents"))
    want = whole(files)
    assert split(longfiles.buckets_of(files, 16)) == want


def test_null_and_empty_texts(spark, make_files):
    files = make_files([("a.py", None), ("b.py", "")])
    assert split(longfiles.buckets_of(files, 2)) == ([], [])


def test_files_read_in_splits(spark, make_files, tmp_path):
    texts = [(f"{i}.py", generated(i) + "\n") for i in range(3)]
    for name, text in texts:
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        buckets = longfiles.read_buckets(spark, str(tmp_path), 10)
        assert buckets.groupBy("file_id").count().where("count < 5").count() == 0
        named = buckets.withColumn("file_id", F.element_at(F.split("file_id", "/"), -1))
        got = split(named)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = whole(make_files(texts).withColumn("file_id", F.col("file_name")))
    assert got == want


def test_no_task_holds_a_file(spark, make_files):
    """Windows over a file read summaries or border pieces, never the lines of a bucket."""
    files = make_files([("a.py", "x = 1\n")])
    plan = longfiles.blocks(longfiles.buckets_of(files))._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and not any("raw#" in x or "code#" in x for x in windows)
