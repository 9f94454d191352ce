import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp}/shared").getOrCreate()
from tidemark.operators import grid, series
from tidemark.plans.analyze import Limit
df = spark.range(1000).selectExpr("id * 1000000000 as ts_nanos", "'a' as source", "cast(id as double) value")
periods = spark.createDataFrame([("a", 10)], "source string, period_sec int")
print("RESULT", grid.regular_grid(df, periods).count(), series.limit_distinct(df, Limit("tail", 2)).count())
from pathlib import Path
print("TABLES", len(list(Path({tmp!r}, "shared").rglob("*.parquet"))) > 0)
"""


def test_executors_need_no_installation(tmp_path):
    """On executors of their own, started elsewhere and without a path to the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    home = tmp_path / "home"
    home.mkdir()
    import pyspark

    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env["SPARK_HOME"] = str(home)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), tmp=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=170)
    assert "RESULT 100 2" in done.stdout, done.stderr[-2000:]
    assert "TABLES True" in done.stdout, "intermediate tables go to the shared folder"
    assert not list((tmp_path / "shared").rglob("*.parquet")), "and are gone when the application ends"
