"""Exact percentiles against plain Python, with nulls, ties, repeats, empty tables and clashing names."""

import math
import random
from collections import defaultdict

from tidemark.llm import quantiles

NAN, INF = float("nan"), float("inf")


def exact(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    lo = math.floor(at)
    return v[lo] if at == lo else v[lo] + (v[lo + 1] - v[lo]) * (at - lo)


def test_percentiles_are_exact_whatever_the_ties(spark):
    rng = random.Random(5)
    rows = [("hot", 7.0 if rng.random() < 0.5 else round(rng.gauss(0, 9), 1), "clash", 0) for _ in range(3000)]
    rows += [(rng.choice("abc"), rng.random(), "clash", 0) for _ in range(200)] + [(None, 1.0, "", 0), (None, 3.0, "", 0), ("one", 5.0, "", 0)]
    rows += [("a", x, "", 0) for x in (None, NAN, INF, -INF)] + [("empty", None, "", 0), ("zero", -0.0, "", 0), ("zero", 0.0, "", 0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, v double, part string, n int, salt bigint").repartition(5)
    probs = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    long = quantiles.long_values(df, "g", ["v"], "salt")
    held = defaultdict(list)
    for g, v, *_ in rows:
        if v is not None and math.isfinite(v):
            held[g].append(v)
    expected = {(g, p): (len(v), exact(v, p)) for g, v in held.items() for p in probs}
    assert {(r["grp"], r["prob"]): (r["n"], r["value"]) for r in quantiles.exact_percentiles(long, probs).collect()} == expected
    # portions kept as value counts combine to the same
    halves = [quantiles.value_counts(long.where(f"pmod(xxhash64(value), 2) = {i}")) for i in (0, 1)]
    combined = quantiles.exact_percentiles(halves[0].unionByName(halves[1]), probs)
    assert {(r["grp"], r["prob"]): (r["n"], r["value"]) for r in combined.collect()} == expected
    assert quantiles.exact_percentiles(long.where("false"), probs).count() == 0


def test_numbering_goes_on_over_batches():
    import pyarrow as pa

    schema = ["grp", "field", "weight"]
    parts = [[("a", 2), ("a", 3)], [("a", 1), ("b", 5), ("b", 1)], [], [("b", 1)], [("c", 1)]]
    batches = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in p], pa.string()), pa.array(["f"] * len(p)), pa.array([w for _, w in p], pa.int64())], schema) for p in parts]
    assert [x for b in quantiles._number_rows(iter(batches)) for x in b.column("before").to_pylist()] == [0, 2, 5, 0, 5, 6, 0]


def test_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    from tidemark import storage

    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, rng.random()]), i) for i in range(500)]
    long = quantiles.long_values(spark.createDataFrame(rows, "g string, v double, k bigint"), "g", ["v"], "k")
    got = {(r["grp"], r["prob"]): r["value"] for r in quantiles.exact_percentiles(long, (0.1, 0.5)).collect()}
    assert got == {(g, p): exact([v for x, v, _ in rows if x == g], p) for g in ("a", "b", None) for p in (0.1, 0.5)}
