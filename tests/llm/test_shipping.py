"""Every operator and the pipeline with workers that cannot import the package."""

import os
import subprocess
import sys

import corpus_pipeline

from tests.llm.conftest import DATA

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import functions as F
from fitlens.session import get_session

spark = get_session("shipping", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": {shared!r}}})


@F.udf("boolean")
def has_package(x):
    import importlib.util
    return importlib.util.find_spec("fitlens") is not None


assert spark.range(4).select(has_package("id")).distinct().collect() == [(False,)]
for name, query in entry.queries().items():
    if name == "pipeline" or name.startswith("op"):
        print("RAN", name, query(spark, {data!r}).count())
"""


def test_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=root, shared=str(tmp_path / "shared"), data=DATA))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("RAN op") == 13 and "RAN pipeline" in done.stdout
