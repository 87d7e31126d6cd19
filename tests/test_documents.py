"""Reports as one document a repository."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeaudit.plans.scan import scan_tables
from codeaudit.sinks import report
from codeaudit.sinks.document import write_documents


@pytest.fixture(scope="module")
def scanned(spark, make_files):
    bad = 'cursor.execute(f"SELECT {x}")\npickle.loads(d)\ncursor.execute(f"SELECT {y}")\n'
    one = make_files([("b.py", bad), ("a.py", bad), ("q\"uote\\.py", bad)], repo="team/one", root="team/one")
    two = make_files([("c.py", "x = 1\n")], repo="two", root="two").withColumn("file_id", F.col("file_id") + 100)
    detector, findings = scan_tables(one.unionByName(two), threshold=0.0, minimum_severity="LOW")
    return detector.cache(), findings.cache()


def test_sarif_document_of_every_repository(scanned, tmp_path):
    detector, findings = scanned
    report.get_reporter("sarif-documents")(detector, findings, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["team%2Fone.sarif", "two.sarif"]
    document = json.loads((tmp_path / "team%2Fone.sarif").read_text())
    assert document["version"] == "2.1.0" and document["$schema"].endswith("sarif-2.1.0.json")
    (run,) = document["runs"]
    rules = run["tool"]["driver"]["rules"]
    assert run["tool"]["driver"]["name"] == report.TOOL_NAME and rules
    results = run["results"]
    assert len(results) == findings.where("repo_id = 'team/one'").count() and len(results) >= 6
    for r in results:
        assert rules[r["ruleIndex"]]["id"] == r["ruleId"] and r["level"] in ("error", "warning", "note")
        place = r["locations"][0]["physicalLocation"]
        assert place["artifactLocation"]["uri"] and place["region"]["startLine"] >= 1
    places = [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"],
               r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in results]
    assert places == sorted(places)
    empty = json.loads((tmp_path / "two.sarif").read_text())
    assert empty["runs"][0]["results"] == []


def test_json_document_of_every_repository(scanned, tmp_path):
    detector, findings = scanned
    report.get_reporter("json-documents")(detector, findings, str(tmp_path))
    report.get_reporter("json-documents")(detector, findings, str(tmp_path))  # again: replaced
    document = json.loads((tmp_path / "team%2Fone.json").read_text())
    assert [f["file_path"].rsplit("/", 1)[1] for f in document["files"]] == ["a.py", "b.py", 'q"uote\\.py']
    assert len(document["findings"]) == findings.where("repo_id = 'team/one'").count()
    assert document["about"]["repository"] == "team/one"
    assert json.loads((tmp_path / "two.json").read_text())["findings"] == []


def test_failed_task_leaves_no_document(spark, tmp_path):
    rows = [(f"n{i}", 0, "1") for i in range(20)]
    good = spark.createDataFrame(rows, "name string, section int, value string")
    broken = good.withColumn("value", F.when(F.col("name") == "n7", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        write_documents(broken, str(tmp_path / "out"), ["[", "]"])
    assert not (tmp_path / "out").exists() or not [
        name for _, _, names in os.walk(tmp_path / "out") for name in names
    ]
    write_documents(good, str(tmp_path / "out"), ["[", "]"])
    assert len(os.listdir(tmp_path / "out")) == 20
    assert json.loads((tmp_path / "out" / "n7.json").read_text()) == [1]


def test_sections_and_empty_tables(spark, tmp_path):
    rows = [("a", 2, "3", "x"), ("a", 0, "1", "x"), ("a", 0, "2", "y"), (None, 1, "7", "x"), ("b", 0, None, "x")]
    parts = spark.createDataFrame(rows, "name string, section int, value string, position string")
    write_documents(parts, str(tmp_path / "out"), ['{"p":[', '],"q":[', '],"r":[', "]}"])

    def read(name):
        return json.loads((tmp_path / "out" / f"{name}.json").read_text())

    assert read("a") == {"p": [1, 2], "q": [], "r": [3]}
    assert read("") == {"p": [], "q": [7], "r": []} and read("b") == {"p": [], "q": [], "r": []}
    write_documents(parts.limit(0), str(tmp_path / "none"), ["[", "]"])
    assert os.listdir(tmp_path / "none") == []
