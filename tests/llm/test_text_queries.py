import duckdb
import pytest

from tidemark.llm import queries
from tidemark.llm.leaks import find_leaks


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, data_dir, name, rows):
    got = queries.QUERIES[name](spark, data_dir)
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for table in ("documents", "trades"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data_dir}/{table}.parquet')")
    names = ", ".join(sorted(got.columns))
    want = db.execute(f"SELECT {names} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, rows(got.select(*sorted(got.columns))))) == sorted(map(str, want))


def test_only_texts_beyond_the_capacity_are_cut(spark, data_dir):
    cut = {r[0] for r in queries.p7_found(spark, data_dir).collect()}
    sizes = {r["doc_id"]: r["n_tokens"] for r in queries.p7_assignment(spark, data_dir).groupBy("doc_id").sum("n_tokens").toDF("doc_id", "n_tokens").collect()}
    assert cut == {d for d, n in sizes.items() if n > 2048}
    assert len(sizes) == spark.read.parquet(f"{data_dir}/documents.parquet").count()


def test_leaks_equal_the_alignment_of_all_pairs(spark, data_dir):
    """Every text is aligned with every item, whatever they share."""
    from tidemark.llm.leaks import longest_passage, words_of

    items = spark.read.parquet(f"{data_dir}/eval_items.parquet").where("item_id % 4 = 0")
    documents = [(r["doc_id"], words_of(r["text"] or "")) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    passages = [(r["item_id"], words_of(r["passage"] or "")) for r in items.collect()]
    expected = {(d, i): n for d, text in documents for i, passage in passages if (n := longest_passage(passage, text, 25, 8))}
    got = find_leaks(spark.read.parquet(f"{data_dir}/documents.parquet"), items)
    assert {(r["doc_id"], r["item_id"]): r["words"] for r in got.collect()} == expected


def test_every_text_lies_in_a_container_with_room(spark, data_dir):
    """The registered assignment: no container beyond its capacity, all tokens placed, next to no room left."""
    from tidemark.llm.packing import token_counts

    got = queries.p7_assignment(spark, data_dir)
    total = token_counts(spark.read.parquet(f"{data_dir}/documents.parquet")).groupBy().sum("n_tokens").first()[0]
    loads = [r[1] for r in got.groupBy("container_id").sum("n_tokens").collect()]
    assert max(loads) <= 2048 and sum(loads) == total and len(loads) <= -(-total // 2048) * 1.05 + 1
