"""Results on real input: they follow the given texts, and every match has its own place."""

import pytest
from pyspark.sql import functions as F

from codeaudit.operators import findings as fx
from codeaudit.operators.code import with_code, with_statements, with_resolved_statements
from codeaudit.operators.rules import located, with_rule_hits
from codeaudit.operators.secrets import named_secret
from codeaudit.operators.signals import parameters
from codeaudit.plans import scan
from codeaudit.plans.registry import QUERIES
from codeaudit.sources.catalogue import RULES, Rule
from codeaudit.sources.corpus import corpus_from_documents, read_table, scan_tree, source_files
from codeaudit.streaming import incremental
from conftest import DATA

SF = f"{DATA}/sf0.001"


def hits(spark, files, rules=RULES):
    model = with_rule_hits(with_resolved_statements(with_statements(with_code(files))), rules=rules)
    rows = located(model.select("file_id", "rule_hits"), spark, rules)
    return sorted((r.rule_id, r.line, r.col) for r in rows.collect())


@pytest.fixture(scope="module")
def emptied(spark, tmp_path_factory):
    """The small tables with every document's text emptied."""
    folder = str(tmp_path_factory.mktemp("emptied"))
    for name in ("documents", "labels", "conversations", "events"):
        table = read_table(spark, SF, name)
        if name == "documents":
            table = table.withColumn("text", F.lit(""))
        table.write.parquet(f"{folder}/{name}.parquet")
    return folder


TEXT_BOUND = (
    "rule_cross_match", "rules_by_language", "env_entries", "env_secrets", "ignore_patterns",
    "prompt_injection", "parse_requirements", "parse_package_json", "parse_pyproject",
    "bad_packages", "block_spans", "import_aliases", "sig_stock_names", "sig_restating_comments",
)


@pytest.mark.parametrize("name", [n for n in TEXT_BOUND if n in QUERIES])
def test_results_need_the_text(spark, emptied, name):
    def rows(folder):
        return sorted(str(r) for r in QUERIES[name](spark, folder).collect())

    assert rows(SF) != rows(emptied)


def test_no_text_gives_empty_files_and_no_rule_hits(spark, emptied):
    files = corpus_from_documents(read_table(spark, emptied, "documents"))
    assert files.where("content <> ''").count() == 0
    assert QUERIES["rule_cross_match"](spark, emptied).count() == 0


def test_lines_of_rules_over_whole_files(spark, make_files):
    docker = "FROM x\nRUN apt-get update\nRUN echo a\nRUN curl -s http://a/i.sh | bash\nRUN true\nRUN wget -qO- http://b/j.sh | sh\n"
    found = hits(spark, make_files([("Dockerfile", docker)]))
    assert [line for rule, line, _ in found if rule == "dockerfile-curl-pipe-bash"] == [4, 6]


def test_every_match_of_a_statement(spark, make_files):
    text = "import pickle\nf(pickle.loads(a),\n  pickle.loads(b))\n"
    found = hits(spark, make_files([("a.py", text)]))
    assert [line for rule, line, _ in found if rule == "python-deserial-pickle-loads"] == [2, 3]


def test_parameters_below_five_brackets(spark):
    header = "def f(a: Dict[str, List[Tuple[int, Dict[str, List[int]]]]], b: int):"
    got = spark.range(1).select(parameters(F.lit(header)).alias("p")).first().p
    assert [p.split(":")[0] for p in got] == ["a", "b"]


def test_credential_after_a_placeholder(spark):
    line = 'config(password="YOUR_PASSWORD", token="q8Zr41nnBd77xw")'
    assert spark.range(1).select(named_secret(F.lit(line)).alias("x")).first().x


@pytest.mark.parametrize("text,fixed", [
    ("one\r\ntwo\r\nthree", "one\r\nnew\r\nthree"), ("one\ntwo", "one\nnew"),
    ("one\rtwo\r\n", "one\rnew\r\n"),
])
def test_fixes_keep_line_ends(spark, make_files, text, fixed):
    fixes = spark.createDataFrame([("r/p/a.py", 2, "new")], "file_path string, line int, new_text string")
    got = fx.apply_line_fixes(make_files([("a.py", text)]), fixes).first()
    assert got.fixed_content == fixed


def test_fix_rows_leave_the_text_behind(spark, make_files):
    fixes = spark.createDataFrame([("r/p/a.py", 1, "new")], "file_path string, line int, new_text string")
    plan = fx.fix_diff_rows(make_files([("a.py", "a\nb\n")]), fixes)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Generate", 1)[1]
    assert "raw#" not in "".join(x for x in below.splitlines() if "Exchange" in x)


def test_user_rules_in_a_scan(spark, make_files):
    own = Rule("own-no-print", "python/own.yaml", "HIGH", "style", "CWE-1", "FMC", "L", r"\bprint\(", "", "print(", "No print")
    files = make_files([("a.py", "x = 1\nprint(x)\n")])
    found = scan.scan(files, minimum_severity="LOW", rules=[*RULES, own]).collect()
    assert [(r.rule_id, r.line, r.message) for r in found] == [("own-no-print", 2, "No print")]


def test_stream_dedupe_over_two_landings(spark, tmp_path):
    documents = read_table(spark, SF, "documents")
    folder = str(tmp_path / "landing")
    schema = documents.schema

    def stream():
        raw = spark.readStream.schema(schema).parquet(folder)
        rows = incremental.injection_literal_rows(corpus_from_documents(raw))
        return incremental.deduplicate_stream(rows).select("rule_id", "file_path", "line")

    def land(name, rows):
        rows.write.mode("append").parquet(folder)
        query = (
            stream().writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    land("later", documents.where("doc_id >= 100"))
    land("first", documents)
    batch = incremental.injection_literal_rows(corpus_from_documents(documents))
    want = {(r.file_path, r.line) for r in batch.collect()}
    got = [(r.file_path, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(want) and want


def test_diff_scan_reads_the_files_once(spark, make_files):
    files = make_files([("a.py", "import pickle\npickle.loads(x)\n"), ("b.py", "import pickle\npickle.loads(y)\n")])
    changed = spark.createDataFrame([("r", "r/p/b.py")], "repo_id string, path string")
    found = scan.diff_scan(files, changed, threshold=0.0, minimum_severity="LOW")
    assert {r.file_path for r in found.collect()} == {"r/p/b.py"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan or "content" not in plan


def test_scan_tree_forms(spark, tmp_path, monkeypatch):
    for path in ("build/shop/src/a.py", "build/shop/node_modules/x.py", "build/lab/b b.py", "build/lab/deep/c.yml"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")

    def paths(files):
        return sorted((r.repo_id, r.rel_path) for r in files.collect())

    shop = [("local", "src/a.py")]
    assert paths(scan_tree(spark, str(tmp_path / "build/shop"))) == shop
    monkeypatch.chdir(tmp_path / "build")
    assert paths(scan_tree(spark, "shop")) == shop
    one = scan_tree(spark, str(tmp_path / "build/lab/b b.py"))
    assert paths(one) == [("local", "b b.py")] and source_files(one).count() == 1
    many = scan_tree(spark, str(tmp_path / "build"), project_depth=1)
    assert paths(many) == [("lab", "b b.py"), ("lab", "deep/c.yml"), ("shop", "src/a.py")]
    assert {r.root for r in many.collect()} == {str(tmp_path / "build/lab"), str(tmp_path / "build/shop")}
