import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["top1", "top5", "top10", "mrr", "n_queries"]


_ALONE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert "pipeline" not in q and not any(n.startswith("op") for n in q) and set(e.oracle_sql()) <= set(q)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert q["identity_counts"](spark, "/root/testdata/sf0.001").count() > 0
"""


@pytest.mark.parametrize("gone", [("plumage/llm",), ("plumage/llm", "corpus_pipeline.py")])
def test_works_without_the_llm_subpackage(tmp_path, gone):
    root = __spark_entry__.__file__.rsplit("/", 1)[0]
    for name in ("plumage", "__spark_entry__.py", "corpus_pipeline.py"):
        copy = shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy
        if name not in gone and os.path.exists(f"{root}/{name}"):
            copy(f"{root}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "plumage/llm", ignore_errors=True)
    subprocess.run([sys.executable, "-c", _ALONE.format(root=str(tmp_path))], check=True, cwd=tmp_path, timeout=120)
