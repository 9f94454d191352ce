"""The queries of the operators on texts, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leaks, packing, quantiles, shared_spans
from tidemark.operators.trades import distinct_trades
from tidemark.queries.problems import ONE_DELIVERY
from tidemark.storage import materialize

PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = distinct_trades(_table(spark, sf_dir, "trades"))
    found = quantiles.exact_percentiles(quantiles.long_values(trades, "market", ["price", "size"], "row_id"), PROBS)
    return found.select(F.col("grp").alias("market"), "field", "n", "prob", "value")


def p4_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the value counts of single days, combined."""
    trades = distinct_trades(_table(spark, sf_dir, "trades"))
    day = F.date_format("trade_day", "yyyy-MM-dd")
    daily = trades.select("row_id", F.struct(F.col("market"), day.alias("day")).alias("key"), "price", "size")
    counts = quantiles.value_counts(quantiles.long_values(daily, "key", ["price", "size"], "row_id"))
    found = quantiles.exact_percentiles(counts.withColumn("grp", F.col("grp.market")), PROBS)
    return found.select(F.col("grp").alias("market"), "field", "n", "prob", "value")


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.assign_containers(packing.token_counts(_table(spark, sf_dir, "documents")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_assignment(spark, sf_dir).where("part > 0").select("doc_id").distinct()


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the assignment: all documents placed, no container too full, none cut that fits, little room unused."""
    placed = materialize(p7_assignment(spark, sf_dir), "placed")
    capacity = F.lit(2048)
    docs = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("parts"))
    needless = F.count(F.when(F.col("parts") > F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)), 1))
    by_doc = docs.agg(F.count(F.lit(1)).alias("documents"), needless.alias("cut_needlessly"), F.sum("n").alias("tokens"))
    loads = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 0")
    by_container = loads.agg(F.count(F.when(F.col("n") > capacity, 1)).alias("too_full"), F.count(F.lit(1)).alias("containers"))
    one = F.lit(0).alias("one")
    both = by_doc.select("*", one).join(by_container.select("*", one), "one")
    return both.select("documents", "cut_needlessly", "too_full", (F.col("containers") <= F.ceil(F.col("tokens") / capacity) * 1.02 + 1).alias("tight"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_stretches(_table(spark, sf_dir, "documents"))


def p9_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_parts(_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_stretches(spark, sf_dir).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p4_percentiles, p4_combined_days, p7_found, p7_assignment, p7_summary, p8_found, p8_leaks, p9_found, p9_stretches, p9_parts)}

def _percentile_sql() -> str:
    # the order statistics themselves, so that both sides interpolate by the same formula to the last bit
    one = """SELECT market, '{0}' AS field, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY market) AS n, {0} AS v
 FROM {1} WHERE isfinite({0}) WINDOW w AS (PARTITION BY market ORDER BY {0})"""
    ranked = " UNION ALL ".join(one.format(f, ONE_DELIVERY) for f in ("price", "size"))
    probs = ", ".join(f"CAST({p} AS DOUBLE)" for p in PROBS)
    return f"""SELECT market, field, n, prob, CASE WHEN f = 0 THEN lo ELSE lo + (hi - lo) * f END AS value FROM (SELECT market, field, n, prob,
 prob * (n - 1) - floor(prob * (n - 1)) AS f, max(CASE WHEN i = floor(prob * (n - 1)) THEN v END) AS lo,
 max(CASE WHEN i = least(floor(prob * (n - 1)) + 1, n - 1) THEN v END) AS hi FROM ({ranked}), (SELECT unnest([{probs}]) AS prob) GROUP BY market, field, n, prob)"""


# Every window of 150 characters of every text; those that occur in more than one document, beside the first place of their
# least document (or, in that one, of their greatest); and the whole runs of equal windows on those diagonals.
_WINDOWS = """w AS (SELECT doc_id, i AS start, substr(text, CAST(i AS BIGINT) + 1, 150) AS t FROM (SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS i FROM documents WHERE length(text) >= 150)),
 s AS (SELECT t, min(doc_id) AS low, max(doc_id) AS high, min(struct_pack(d := doc_id, s := start)).s AS low_at, -max(struct_pack(d := doc_id, s := -start)).s AS high_at FROM w GROUP BY t HAVING min(doc_id) < max(doc_id)),
 m AS (SELECT doc_id, start, CASE WHEN doc_id = low THEN high ELSE low END AS other, CASE WHEN doc_id = low THEN high_at ELSE low_at END - start AS shift FROM w JOIN s USING (t)),
 d AS (SELECT DISTINCT doc_id, other, shift FROM m),
 e AS (SELECT d.*, a.start FROM d JOIN w a USING (doc_id) JOIN w b ON b.doc_id = d.other AND b.start = a.start + d.shift AND b.t = a.t),
 g AS (SELECT *, start - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY start) AS k FROM e),
 i AS (SELECT doc_id, other, shift, min(start) AS start, max(start) AS last FROM g GROUP BY doc_id, other, shift, k),
 r AS (SELECT i.doc_id, i.start, i.last + 150 - i.start AS length, i.other, i.start + i.shift AS other_start FROM i
 WHERE EXISTS (SELECT 1 FROM m WHERE m.doc_id = i.doc_id AND m.other = i.other AND m.shift = i.shift AND m.start BETWEEN i.start AND i.last))"""

ORACLES: dict[str, str] = {
    "p4_percentiles": _percentile_sql(),
    "p4_combined_days": _percentile_sql(),
    "p7_summary": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS cut_needlessly, CAST(0 AS BIGINT) AS too_full, TRUE AS tight FROM documents",
    "p9_found": f"WITH {_WINDOWS} SELECT DISTINCT doc_id FROM m",
    "p9_stretches": f"WITH {_WINDOWS} SELECT *, least(doc_id, other) AS class_id FROM r",
    "p9_parts": f"""WITH {_WINDOWS}, c AS (SELECT doc_id, sum(greatest(start + length - greatest(start, coalesce(before, start)), 0)) AS shared_chars, count(*) AS stretches, count(DISTINCT other) AS links
 FROM (SELECT *, max(start + length) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) GROUP BY doc_id)
 SELECT doc_id, length(text) AS n_chars, coalesce(CAST(shared_chars AS BIGINT), 0) AS shared_chars, coalesce(stretches, 0) AS stretches, coalesce(links, 0) AS links
 FROM documents LEFT JOIN c USING (doc_id) WHERE text IS NOT NULL""",
}
