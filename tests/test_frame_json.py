"""Frames as tagged JSON."""

import json
import math
import random

import pytest

from tidemark.plans import output
from tidemark.plans.output import read_frame_json, write_frame_json

SCHEMA = "ts_nanos bigint, v double, b boolean, `a\"]} name` string, n bigint"


def some_rows(n=500):
    rng = random.Random(1)
    texts = ["a", "é", "", "null", ']},"c":[', '{"ts_nanos":[', "two\nlines", '"', "\\", None]
    values = [1.5, -0.0, 5e-324, math.inf, -math.inf, 1e300, None]
    return [(rng.randrange(9), rng.choice(values), rng.choice([True, False, None]), rng.choice(texts), i) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_frames_are_read_in_parts(spark, tmp_path, n):
    path, rows = tmp_path / "frame.json", some_rows(n)
    split, spark_conf = "spark.sql.files.maxPartitionBytes", spark.conf
    before = {k: spark_conf.get(k) for k in (split, "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark_conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
        spark_conf.set(split, "2000")
        df = spark.createDataFrame(rows, SCHEMA).orderBy("ts_nanos")
        with open(path, "w") as out:
            write_frame_json(df, out)
        written = json.loads(path.read_text())
        assert [c["t"] for c in written["columns"]] == ["Float64", "Bool", "String", "UInt64"] and written["ts_nanos"] == sorted(r[0] for r in rows)
        assert sorted(map(repr, zip(written["ts_nanos"], *(c["c"] for c in written["columns"]), strict=True))) == sorted(map(repr, rows)), "ties stay together"
        got = read_frame_json(spark, str(path))
        assert got.columns == df.columns or n == 0
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, rows))
    finally:
        for k, v in before.items():
            spark_conf.set(k, v)


def test_frames_of_a_single_line_are_read(spark, tmp_path):
    rows = some_rows(30)
    times, *columns = zip(*rows, strict=True)
    fields = [{"name": n, "t": t, "c": c} for n, t, c in zip(["v", "b", "s", "n"], ["Float64", "Bool", "String", "UInt64"], columns, strict=True)]
    (tmp_path / "frame.json").write_text(json.dumps({"ts_nanos": times, "columns": fields}, separators=(",", ":")) + "\n")
    got = read_frame_json(spark, str(tmp_path / "frame.json"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, rows))


def test_the_file_is_in_lines_of_batches(spark, tmp_path):
    with open(tmp_path / "frame.json", "w") as out:
        write_frame_json(spark.range(25).toDF("ts_nanos").coalesce(1), out)
    assert json.loads((tmp_path / "frame.json").read_text()) == {"ts_nanos": list(range(25)), "columns": []}
    assert hasattr(output, "_json_columns")
