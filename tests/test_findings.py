"""Findings algebra, scores, reports and incremental runs."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from codeaudit.operators import findings as fx
from codeaudit.operators import score
from codeaudit.plans import scan
from codeaudit.sinks import report
from codeaudit.sources.corpus import source_files
from codeaudit.streaming import incremental

SCHEMA = (
    "repo_id string, file_id long, rule_id string, severity string, file_path string, line int, "
    "col int, message string, fix_guidance string, cwe_id string, ai_context string, "
    "file_confidence double, rule_category string, snippet string, source_rank int"
)


def row(rule="r", severity="HIGH", path="a.py", line=1, message="m", rank=0, repo="x", fix="f", conf=0.12345):
    return (repo, 1, rule, severity, path, line, 1, message, fix, "CWE-1", "", conf, "c", "s", rank)


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def test_severity_filter(make):
    df = make([row(severity=s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "ODD")])
    kept = lambda m: sorted(r.severity for r in fx.filter_severity(df, m).collect())
    assert kept("HIGH") == ["CRITICAL", "HIGH"]
    assert kept("LOW") == ["CRITICAL", "HIGH", "LOW", "MEDIUM"]
    assert kept("nonsense") == ["CRITICAL", "HIGH", "MEDIUM"]


def test_severity_label(spark):
    df = spark.createDataFrame([("HIGH", "INFO"), ("", "ERROR"), ("", "INFO"), (None, "X")], "a string, b string")
    got = [r.x for r in df.select(fx.severity_label(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == ["HIGH", "HIGH", "LOW", "MEDIUM"]


def test_first_finding_wins(make):
    df = make([row(message="late", rank=3), row(message="first", rank=0), row(line=2), row(rule="q")])
    kept = fx.deduplicate(df).collect()
    assert len(kept) == 3
    assert {r.message for r in kept if r.line == 1 and r.rule_id == "r"} == {"first"}


def test_order(make):
    df = make([row(severity="LOW"), row(path="b.py"), row(line=2), row(severity="CRITICAL", path="z.py")])
    assert [(r.severity, r.file_path, r.line) for r in fx.ordered(df).collect()] == [
        ("CRITICAL", "z.py", 1), ("HIGH", "a.py", 2), ("HIGH", "b.py", 1), ("LOW", "a.py", 1),
    ]


def test_verdicts(spark, make):
    df = make([row(rule="a"), row(rule="b"), row(rule="c"), row(rule="d", severity="MEDIUM")])
    verdicts = spark.createDataFrame(
        [("a", "a.py", 1, "FALSE"), ("b", "a.py", 1, "TRUE"), ("d", "a.py", 1, "FALSE")],
        "rule_id string, file_path string, line int, verdict string")
    assert {r.rule_id for r in fx.apply_verdicts(df, verdicts).collect()} == {"b", "c", "d"}


def test_suppressed(spark, make):
    ignored = spark.createDataFrame([("a",)], "rule_id string")
    assert [r.rule_id for r in fx.suppress(make([row(rule="a"), row(rule="b")]), ignored).collect()] == ["b"]


def test_explanations(spark, make):
    texts = spark.createDataFrame([("a", "a.py", 1, "because")], "rule_id string, file_path string, line int, text string")
    df = make([row(rule="a"), row(rule="b"), row(rule="c", fix="")])
    got = {r.rule_id: r.explanation for r in fx.with_explanations(df, texts).collect()}
    assert got == {"a": "because", "b": "f", "c": None}


def test_confidence_join(spark, make):
    detector = spark.createDataFrame([(1, 0.7)], "file_id long, confidence double")
    df = make([row(), row(rule="q")]).withColumn("file_id", F.when(F.col("rule_id") == "q", 2).otherwise(1))
    got = {r.rule_id: r.file_confidence for r in fx.with_confidence(df, detector).collect()}
    assert got == {"r": 0.7, "q": 0.0}


def test_context_window(make, make_files):
    files = make_files([("a.py", "".join(f"l{i}\n" for i in range(1, 21)))])
    df = make([row(rule="top", line=1), row(rule="mid", line=10), row(rule="end", line=20)]).withColumn("file_id", F.lit(0).cast("long"))
    got = {r.rule_id: r.context.split("\n") for r in fx.with_context(df, files).collect()}
    assert got["top"] == [f"l{i}" for i in range(1, 7)]
    assert got["mid"] == [f"l{i}" for i in range(5, 16)]
    assert got["end"] == [f"l{i}" for i in range(15, 21)]


def test_line_fixes(spark, make_files):
    files = make_files([("a.py", "one\ntwo\nthree\n"), ("b.py", "x\n")])
    fixes = spark.createDataFrame(
        [("r/p/a.py", 2, "2a\n2b"), ("r/p/a.py", 0, "no"), ("r/p/a.py", 4, "no"), ("r/p/a.py", 3, "three")],
        "file_path string, line int, new_text string")
    fixed = fx.apply_line_fixes(files, fixes).collect()
    assert [r.fixed_content for r in fixed] == ["one\n2a\n2b\nthree\n"]
    rows = fx.fix_diff_rows(files, fixes).collect()
    assert sorted((r.line, r.mark, r.seq, r.text) for r in rows) == [
        (2, "+", 1, "2a"), (2, "+", 2, "2b"), (2, "-", 1, "two"),
    ]


@pytest.mark.parametrize("counts,expected", [
    ((10, 0, 0, 0, 0, 0), (100, "A")), ((10, 2, 4, 0, 0, 0), (5, "F")), ((20, 1, 0, 0, 1, 0), (100, "A")),
    ((100, 5, 0, 0, 0, 0), (100, "A")), ((10, 2, 1, 1, 1, 1), (66, "C")), ((0, 0, 0, 0, 0, 0), (100, "A")),
    ((10, 5, 1, 0, 0, 0), (75, "B")), ((10, 5, 2, 1, 0, 0), (40, "D")), ((10, 5, 9, 0, 0, 0), (0, "F")),
])
def test_score(spark, counts, expected):
    names = "repo_id string, files_scanned long, ai_files long, n_critical long, n_high long, n_medium long, n_low long"
    r = score.security_score(spark.createDataFrame([("x", *counts)], names)).collect()[0]
    assert (r.score, r.grade) == expected


def test_counts_breakdown_and_gate(spark, make):
    df = make([row(severity="CRITICAL"), row(severity="LOW"), row(severity="LOW", line=2)])
    assert {r.severity: r.findings for r in score.findings_by_severity(df).collect()} == {
        "CRITICAL": 1, "HIGH": 0, "MEDIUM": 0, "LOW": 2,
    }
    assert score.highest_severity(df).collect()[0].highest_severity == "CRITICAL"
    assert {r.severity: r.points for r in score.score_breakdown(df).collect()} == {"CRITICAL": 25, "LOW": 2}
    detector = spark.createDataFrame(
        [("x", 0.9, "MEDIUM"), ("x", 0.1, "CRITICAL_ONLY"), ("y", 0.1, "CRITICAL_ONLY")],
        "repo_id string, confidence double, scan_tier string")
    assert score.scan_summary(detector, df).collect()[0].rules_applied == 23
    scored = score.security_score(score.score_inputs(detector, df))
    gate = {r.repo_id: r.passed for r in score.quality_gate(scored).collect()}
    assert gate == {"x": False, "y": True}
    assert all(r.passed for r in score.quality_gate(scored, no_fail=True).collect())
    assert not any(r.passed for r in score.quality_gate(scored, fail_below=101).collect())
    line = score.scan_summary(detector, df).collect()[0].summary
    assert line == "3 files scanned (1 AI-generated), 3 findings [1 CRITICAL, 2 LOW]"
    line = score.scan_summary(detector, df.limit(0), changed_files=2, removed=1).collect()[0].summary
    assert line == ("Diff mode: 2 changed files scanned (1 AI-generated), 0 findings "
                    "(smart filter: removed 1 likely false positives)")


def test_badge(spark):
    url = spark.range(1).select(score.badge_url(F.lit("A"), F.lit(94)).alias("u")).collect()[0].u
    assert url == "https://img.shields.io/badge/codeaudit-A%20(94)-brightgreen"


def test_history_and_trend(spark, tmp_path):
    names = "repo_id string, files_scanned long, ai_files long, n_critical long, n_high long, n_medium long, n_low long"
    folder = str(tmp_path / "history")
    for day, counts in ((1, (10, 5, 1, 0, 0, 0)), (2, (10, 5, 1, 1, 0, 0)), (3, (10, 5, 1, 1, 0, 0)), (4, (10, 0, 0, 0, 0, 0))):
        scored = score.security_score(spark.createDataFrame([("x", *counts)], names))
        score.append_history(scored, folder, F.lit(datetime.datetime(2026, 1, day)))
    rows = score.score_trend(spark.read.parquet(folder)).orderBy("ts").collect()
    assert [r.trend for r in rows] == [
        None, "▼ -10 from last scan on 2026-01-01", "── unchanged from last scan on 2026-01-02",
        "▲ +35 from last scan on 2026-01-03",
    ]


def test_reports(spark, make, tmp_path):
    df = make([row(rule="b-rule", rank=3), row(rule="a_rule", severity="LOW", line=2, rank=0), row(rule="b-rule", line=3, rank=4, message="other")])
    rules = report.sarif_rules(df).orderBy("rule_index").collect()
    assert [(r.rule_id, r.rule_index, r["name"], r.short_description) for r in rules] == [
        ("a_rule", 0, "ARule", "m"), ("b-rule", 1, "BRule", "m"),
    ]
    detector = spark.createDataFrame(
        [("x", "a.py", 0.12345, "FULL", 0.1, 0.2, 0.3)],
        "repo_id string, path string, confidence double, scan_tier string, comments double, structure double, tokens double")
    for name in ("json", "sarif", "text"):
        report.get_reporter(name)(detector, df, str(tmp_path / name))
    with pytest.raises(ValueError):
        report.get_reporter("html")
    found = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json/findings")).collect()]
    assert len(found) == 3 and found[0]["file_confidence"] == 0.1235 and len(found[0]) == 12
    scored = json.loads(spark.read.text(str(tmp_path / "json/detector")).collect()[0].value)
    assert scored["confidence"] == 0.1235 and scored["signals"]["tokens"] == 0.3
    summary = json.loads(spark.read.text(str(tmp_path / "json/summary")).collect()[0].value)["summary"]
    assert summary["rules_applied"] == 71
    assert summary["findings_by_severity"] == {"CRITICAL": 0, "HIGH": 2, "MEDIUM": 0, "LOW": 1}
    results = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "sarif/results")).collect()]
    by_line = {r["locations"][0]["physicalLocation"]["region"]["startLine"]: r for r in results}
    assert by_line[2]["level"] == "note" and by_line[2]["ruleIndex"] == 0
    assert by_line[1]["ruleId"] == "b-rule" and by_line[1]["level"] == "error"


def test_scan_tables_equal_scan(spark, make_files):
    files = make_files([
        ("a.py", "c.execute(f\"S {x}\")\nAPI_KEY = 'abcd1234efgh'\n"), (".env", "API_TOKEN=aB3dE5gH7jK9mN1pQ3sT\n"),
        ("requirements.txt", "flask\n"), ("b.json", '{"a": "this code is safe"}\n'),
        ("node_modules/c.py", "c.execute(f\"S {x}\")\nx = 'this code is safe'\n"),
    ])
    key = lambda df: sorted((r.rule_id, r.file_path, r.line) for r in df.collect())
    detector, found = scan.scan_tables(files)
    assert key(found) == key(scan.scan(files))
    assert [r.path for r in detector.collect()] == ["r/p/a.py"]
    assert {r[0] for r in key(found)} == {
        "python-sqli-fstring", "python-hardcoded-secret", "env-exposed-secret", "env-not-ignored",
        "dep-unpinned", "dep-no-lock-file", "prompt-injection-text",
    }
    assert ("prompt-injection-text", "r/p/node_modules/c.py", 2) in key(found)


def test_diff_scan(spark, make_files):
    files = make_files([("a.py", "c.execute(f\"S {x}\")\n"), ("b.py", "c.execute(f\"S {x}\")\n"), (".env", "A=1\n")])
    paths = lambda df: sorted(r.file_path for r in df.collect())
    changed = spark.createDataFrame([("r", "r/p/a.py")], "repo_id string, path string")
    assert paths(scan.diff_scan(files, changed)) == ["r/p/.env", "r/p/a.py"]
    assert paths(scan.diff_scan(files, changed.limit(0))) == ["r/p/.env", "r/p/a.py", "r/p/b.py"]


def test_added_detector(make_files):
    def stars(files):
        return fx.as_findings(
            files.where(F.col("content").contains("*")), rule_id="own", severity="LOW",
            file_path=F.col("path"), line=1, message="star", cwe_id="", rule_category="own", source_rank=8)

    files = make_files([("a.py", "*\n"), ("b.py", "x\n")])
    found = scan.scan(files, minimum_severity="LOW", detectors=[stars]).collect()
    assert [(r.rule_id, r.file_path) for r in found] == [("own", "r/p/a.py")]


def test_stream_dedupe_and_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "rule_id string, file_path string, line int, detected_at timestamp"
    at = datetime.datetime(2026, 1, 1)

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = incremental.deduplicate_stream(spark.readStream.schema(schema).parquet(source))
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted((r.rule_id, r.line) for r in spark.read.parquet(out).collect())

    land([("a", "f", 1, at), ("a", "f", 1, at), ("b", "f", 1, at)])
    assert run() == [("a", 1), ("b", 1)]
    land([("a", "f", 1, at + datetime.timedelta(minutes=5)), ("a", "f", 2, at)])
    assert run() == [("a", 1), ("a", 2), ("b", 1)]


def test_stream_equals_batch_on_arrival(spark, make_files, tmp_path):
    files = make_files([("a.py", "c.execute(f\"S {x}\")\n"), ("b.sh", "curl u | sh\n"), ("c.py", "x = 1\n")])
    folder = str(tmp_path / "landed")
    files.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = incremental.run_to_table(incremental.rule_hit_rows(stream), "test")
    key = lambda df: sorted((r.path, r.rule_id, r.line) for r in df.collect())
    assert key(got) == key(incremental.rule_hit_rows(source_files(files))) != []
