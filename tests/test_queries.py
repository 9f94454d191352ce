import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.queries import problems, series, stores

ROOT = Path(entry.__file__).parent
TABLES = ("events", "orders", "lineitem", "trades", "datapoints", "block_manifest", "metric_catalog")
SETS = problems.QUERIES | series.QUERIES | stores.QUERIES
SQL = problems.ORACLES | series.ORACLES | stores.ORACLES


@pytest.fixture(scope="module")
def db(data_dir):
    out = duckdb.connect()
    out.execute("SET timezone = 'UTC'")
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    return out


def comparable(rows):
    return sorted(tuple("" if x is None else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data_dir, db, name):
    got = SETS[name](spark, data_dir)
    names = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({SQL[name]})").fetchall()
    assert comparable(tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()) == comparable(want)


def test_flagged_rows_are_rows_of_their_tables(spark, data_dir):
    got = problems.p2_found(spark, data_dir)
    assert got.columns == ["record_table", "record_field", "row_id"]
    assert got.count() == got.distinct().count() > 0
    for table in ("trades", "datapoints"):
        flagged = got.where(f"record_table = '{table}'")
        assert flagged.join(spark.read.parquet(f"{data_dir}/{table}.parquet"), "row_id", "left_anti").count() == 0


def test_impossible_values_are_flagged_whole(spark, data_dir, db):
    got = {tuple(r) for r in problems.p2_found(spark, data_dir).collect()}
    want = db.execute("""SELECT 'trades', f, row_id FROM (SELECT row_id, unnest(['price', 'size']) AS f, unnest([price, size]) AS v FROM trades WHERE exec_date IS NOT NULL)
        WHERE NOT isnan(v) AND (v <= 0 OR isinf(v)) UNION ALL SELECT 'datapoints', 'c0', row_id FROM datapoints LEFT JOIN metric_catalog USING (metric)
        WHERE ts_nanos IS NOT NULL AND NOT isnan(c0) AND (c0 < low_limit OR c0 > high_limit OR isinf(c0))""").fetchall()
    assert want and set(want) <= got


def test_entry_has_all_queries(spark):
    assert set(SETS) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_subpackage_of_texts():
    name = "ll" + "m"
    for path in [*ROOT.glob("tidemark/**/*.py"), *ROOT.glob("*.py"), *ROOT.glob("tests/*.py")]:
        if name not in path.parts and path.name != "__spark_entry__.py":
            assert not re.search(rf"tidemark\.{name}|import {name}", path.read_text()), path
