import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("codeaudit-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """File table from (path below the project root, content) pairs."""
    from pyspark.sql import functions as F

    from codeaudit.functions.text import extension_of
    from codeaudit.sources.corpus import language_of

    def build(rows, repo="r", root="r/p"):
        data = [(i, repo, root, path, text) for i, (path, text) in enumerate(rows)]
        df = spark.createDataFrame(
            data, "file_id long, repo_id string, root string, rel_path string, content string"
        )
        name = F.element_at(F.split("rel_path", "/"), -1)
        ext = extension_of(name)
        return df.select(
            "file_id", "repo_id", "root",
            F.concat("root", F.lit("/"), "rel_path").alias("path"), "rel_path",
            name.alias("file_name"), ext.alias("ext"), language_of(name, ext).alias("language"),
            "content",
        )

    return build
