"""The scratch folder of a session."""

import os
import subprocess
import sys

from tonescale.session import materialize, scratch_root

ALONE = """
from tonescale import build_session
from tonescale.session import materialize, scratch_path, scratch_root
spark = build_session("alone", master="local[1]", **{"spark.ui.enabled": "false"})
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert scratch_root(spark) == scratch_root(spark) and scratch_path(spark, "x").startswith(scratch_root(spark))
assert materialize(spark.range(3), "rows").count() == 3
print("stored")
"""


def test_a_local_session_without_a_shared_folder_gets_one_of_its_own(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    unset = ("PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR")
    env = {k: v for k, v in os.environ.items() if k not in unset} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": here}
    ran = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=300)
    assert "stored" in ran.stdout, ran.stderr[-2000:]


def test_the_named_folder_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert not named or scratch_root(spark) == named
    assert sorted(r["id"] for r in materialize(spark.range(3), "rows").collect()) == [0, 1, 2]
