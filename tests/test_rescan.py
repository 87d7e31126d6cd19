"""Files that land again take back the findings of their earlier versions."""

import pytest

from codeaudit.streaming import incremental

BAD, WORSE, CLEAN = "eval(x)\n", "y = 1\nexec(x)\npickle.loads(y)\n", "x = 1\n"


@pytest.fixture
def landing(spark, make_files, tmp_path):
    folder = str(tmp_path / "landing")
    schema = None

    def put(rows, name):
        nonlocal schema
        files = make_files([(path, text or "") for path, text, _ in rows])
        versions = spark.createDataFrame(
            [(f"r/p/{path}", v, text is None) for path, text, v in rows], "path string, version int, is_deleted boolean")
        df = files.join(versions, "path").select(*files.columns, "version", "is_deleted")
        df.coalesce(1).write.mode("append").parquet(folder)
        schema = df.schema
        stream = spark.readStream.schema(schema).parquet(folder)
        incremental.land(stream, str(tmp_path / "tables"), name)

    def now(tables="tables"):
        rows = incremental.current_findings(spark, str(tmp_path / tables)).collect()
        return sorted((r.path[4:], r.rule_id, r.line) for r in rows)

    return put, now, tmp_path


def test_second_version_replaces_the_first(spark, landing):
    put, now, tmp_path = landing
    put([("a.py", BAD, 1), ("b.py", BAD, 1), ("c.py", BAD, 1), ("d.py", CLEAN, 1)], "s")
    assert [p for p, *_ in now()] == ["a.py", "b.py", "c.py"]
    put([("a.py", WORSE, 2), ("b.py", None, 2), ("d.py", BAD, 2), ("c.py", CLEAN, 0)], "s")
    got = now()
    assert {p for p, *_ in got} == {"a.py", "c.py", "d.py"}
    assert sorted(line for p, _, line in got if p == "a.py") == [2, 3]
    put([("b.py", BAD, 3), ("c.py", CLEAN, 1)], "s")  # back again; one version landed twice
    assert {p for p, *_ in now()} == {"a.py", "b.py", "d.py"}
    incremental.compact(spark, str(tmp_path / "tables"), str(tmp_path / "compacted"))
    assert now("compacted") == now()
    found = spark.read.parquet(str(tmp_path / "compacted/findings"))
    assert found.count() == len(now())


def test_a_batch_run_again_changes_nothing(spark, landing):
    put, now, tmp_path = landing
    put([("a.py", BAD, 1)], "s")
    before = now()
    stream = spark.readStream.schema(
        spark.read.parquet(str(tmp_path / "landing")).schema).parquet(str(tmp_path / "landing"))
    incremental.land(stream, str(tmp_path / "tables"), "s")  # nothing new
    assert now() == before
    incremental.land(stream, str(tmp_path / "tables"), "t")  # all of it, by another run
    assert now() == before
