import os
import subprocess
import sys

from strandlake.shared import drop_stage, shared_dir, stage


def test_stage(spark):
    df = stage(spark.createDataFrame([(1, "a"), (None, None)], "k long, s string"))
    assert sorted(df.collect(), key=str) == sorted([(1, "a"), (None, None)], key=str)
    assert df._strandlake_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    drop_stage(df)
    assert not os.path.exists(df._strandlake_path)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_folder_of_its_own_only_where_unset(tmp_path):
    code = """
from pyspark.sql import SparkSession
from strandlake.shared import shared_dir, stage
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
a = shared_dir(s)
assert a == shared_dir(s) and 'strandlake-' in a
assert stage(s.range(3)).count() == 3
print('fine')
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=120)
    assert "fine" in out.stdout, out.stderr[-2000:]
