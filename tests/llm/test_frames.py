import subprocess
import sys
import os

SCRIPT = """
import os
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
assert spark.conf.get("spark.checkpoint.dir", None) is None
from sessionmill.llm.frames import Steps, shared_folder
one, two = Steps(spark), Steps(spark)
assert one.folder != two.folder and os.path.dirname(one.folder) == os.path.dirname(two.folder)
assert one.keep(spark.range(5), "five").count() == 5
print("kept")
"""


def test_steps_without_a_checkpoint_folder(tmp_path):
    """A plain local session whose configuration names no shared folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("kept"), done.stderr[-2000:]
