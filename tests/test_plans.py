"""What the plans must and must not contain, whatever the size of the input."""

import glob
import os
import re

import pytest

from codeaudit.operators import signals
from codeaudit.plans import scan
from codeaudit.plans.registry import QUERIES
from codeaudit.sources.corpus import corpus_files, source_files

from conftest import DATA, ROOT

SF = f"{DATA}/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return len(re.findall(r"Exchange (hashpart|rangepart|SinglePart|RoundRobin)", plan))


@pytest.mark.parametrize("name", [
    "security_score", "dedupe_findings", "diff_scan", "config_not_ignored", "missing_lock",
    "unknown_packages", "sarif_rules", "scan_summary", "tier_containment",
])
def test_no_udf_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for banned in ("PythonUDF", "ArrowEval", "BatchEval", "CartesianProduct", "BroadcastNestedLoop"):
        assert banned not in plan


def test_scoring_and_rules_do_not_shuffle(spark):
    files = source_files(corpus_files(spark, SF))
    assert exchanges(plan_of(signals.detect(files))) == 0
    assert exchanges(plan_of(scan.rule_findings(files))) == 0


def test_duplicates_are_dropped_before_the_shuffle(spark):
    plan = plan_of(scan.scan(corpus_files(spark, SF)))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_contents_are_pruned_when_not_needed(spark):
    df = corpus_files(spark, SF).select("file_id", "path")
    read = re.search(r"ReadSchema: (\S+)", df._jdf.queryExecution().toString()).group(1)
    assert "text" not in read and "source" in read


def test_filters_on_results_do_not_multiply_the_plan(spark):
    df = signals.detect(source_files(corpus_files(spark, SF)))
    plain = len(plan_of(df))
    assert len(plan_of(df.where("confidence > 0.5 AND scan_tier = 'FULL'"))) < 1.2 * plain


def test_hits_with_context_do_not_carry_their_file(spark):
    df = scan.rule_findings_with_context(source_files(corpus_files(spark, SF)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate explode(rule_hits")]
    assert not re.search(r"\braw#", above)


def test_no_local_checkpoints_or_row_functions_in_the_code():
    training = os.path.join(ROOT, "codeaudit", "llm") + os.sep
    for path in glob.glob(os.path.join(ROOT, "codeaudit", "**", "*.py"), recursive=True):
        if path.startswith(training):
            continue
        text = open(path).read()
        for banned in ("localCheckpoint", "F.udf", "pandas_udf", "applyIn", "mapIn", "crossJoin", ".toPandas("):
            assert banned not in text, (path, banned)
