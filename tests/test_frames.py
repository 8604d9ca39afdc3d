import os
import subprocess
import sys

from foliospark.functions import frames

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from foliospark.plans import catalog
print("ROWS", catalog.QUERIES["dense_topk_ip"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_get_the_package_wherever_they_start(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 50" in done.stdout, done.stderr[-2000:]


def test_small_scans_are_spread_and_large_ones_left(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert frames.spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 3)
    assert frames.spread(many) is many
