"""Split groups give what whole groups give."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from daypanel.operators import ordering
from daypanel.operators.ordering import (
    add_row_number,
    exact_quantiles,
    keep_top,
    merged_sketches,
    quantile_sketches,
    table_quantiles,
)

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def skewed(spark, n=6000, seed=1):
    """Group 1 holds a third of all rows, most of them one value."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        g = 1 if i % 3 == 0 else rng.randrange(2, 40)
        v = rng.choice([None, 7.0, 7.0, 7.0, rng.gauss(0, 1), rng.lognormvariate(0, 3)])
        data.append((g, v, i))
    rng.shuffle(data)
    return spark.createDataFrame(data, "g int, v double, id long")



@pytest.mark.parametrize(("k", "few"), [(4096, True), (64, False), (8, True)])
def test_quantiles_equal_percentile(spark, k, few):
    infinite = spark.createDataFrame(
        [(g, v, 0) for g, own in ((None, [1.0, 2.0, 5.0]), (90, [1.0] + [float("inf")] * 3), (91, [float("-inf"), 3.0]), (92, [4.0] * 9), (93, [None]), (94, [float("nan")] * 3), (95, [1.0, 2.0, float("nan"), float("nan")])) for v in own],
        "g int, v double, id long",
    )
    df = skewed(spark).unionByName(infinite)
    wanted = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", wanted, k=k, few_groups=few).collect()}
    plain = df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", list(wanted.values())).alias("q")).collect()
    assert len(got) == len(plain)
    for r in plain:
        assert repr([got[r.g][n] for n in wanted]) == repr(r.q)


@pytest.mark.parametrize("ends", [(-1e9, -1e8), (1e8, 1e9), (0.001, 0.002), (7.5, 7.0)])
def test_a_bracket_that_misses_is_replaced(spark, monkeypatch, ends):
    monkeypatch.setattr(ordering, "_brackets", lambda quantiles, k: F.array(*map(F.lit, ends)))
    df = skewed(spark)
    plain = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("q")).collect()}
    assert {r.g: r.m for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == plain


def test_sketches_of_days_serve_years_and_the_table(spark):
    df = skewed(spark).withColumn("year", F.col("g") % 5)
    days = quantile_sketches(df, ["year", "g"], "v").cache()
    for by in (["year", "g"], ["year"]):
        got = exact_quantiles(df, by, "v", {"a": 0.3, "b": 0.9}, merged_sketches(days, by))
        plain = df.filter("v IS NOT NULL").groupBy(*by).agg(F.percentile("v", [0.3, 0.9]).alias("q"))
        want = {tuple(r[c] for c in by): r.q for r in plain.collect()}
        assert {tuple(r[c] for c in by): [r.a, r.b] for r in got.collect()} == want
    whole = merged_sketches(days, []).first()
    assert whole._n == df.filter("v IS NOT NULL").count()


def test_quantiles_of_a_whole_table(spark):
    df = skewed(spark)
    row = table_quantiles(df, "v", {"p50": 0.5, "p95": 0.95}, k=64).first()
    assert [row.p50, row.p95] == df.agg(F.percentile("v", [0.5, 0.95]).alias("q")).first().q
    assert table_quantiles(df.filter("false"), "v", {"p50": 0.5}).count() == 0


@pytest.mark.parametrize("hot_rows", [10_000, 500, 10])
def test_row_numbers_of_split_groups(spark, hot_rows):
    df = skewed(spark)
    w = Window.partitionBy("g").orderBy(F.desc_nulls_last("v"), "id")
    plain = df.withColumn("n", F.row_number().over(w).cast("long"))
    got = add_row_number(df, "g", "v", "id", "n", hot_rows, cuts=8, accuracy=500)
    assert sorted(map(tuple, got.select("g", "id", "n").collect())) == sorted(
        map(tuple, plain.select("g", "id", "n").collect())
    )


@pytest.mark.parametrize("hot_rows", [10_000, 10])
def test_row_numbers_by_text(spark, hot_rows):
    df = skewed(spark).withColumn("name", F.when(F.col("id") % 50 != 0, F.concat(F.char((F.col("id") % 7 + 97).cast("int")), F.col("id").cast("string"))))
    df = df.withColumn("name", F.coalesce("name", F.when(F.col("id") == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("ü"), "id"))))
    w = Window.partitionBy("g").orderBy(F.desc_nulls_last("v"), F.asc_nulls_last("name"))
    plain = df.withColumn("n", F.row_number().over(w).cast("long"))
    got = add_row_number(df, "g", "v", "name", "n", hot_rows, cuts=8, accuracy=500)
    assert sorted(map(tuple, got.select("g", "id", "n").collect())) == sorted(map(tuple, plain.select("g", "id", "n").collect()))


@SLOW
@given(seed=st.integers(0, 10_000), k1=st.integers(1, 30), k2=st.integers(1, 30), salts=st.sampled_from([1, 3, 64]))
def test_top_rows_by_two_orders(spark, seed, k1, k2, salts):
    df = skewed(spark, 900, seed).withColumn("w", F.sin("id"))
    orders = {"r1": (F.col("v"), k1), "r2": (F.col("w"), k2)}
    got = keep_top(df, "g", orders, "id", count_as="n", salts=salts)
    full = df
    for name, (value, _) in orders.items():
        w = Window.partitionBy("g").orderBy(value.desc_nulls_last(), F.asc_nulls_last("id"))
        full = full.withColumn(name, F.row_number().over(w).cast("long"))
    full = full.withColumn("n", F.count("*").over(Window.partitionBy("g"))).filter(f"r1 <= {k1} AND r2 <= {k2}")
    columns = ["g", "id", "r1", "r2", "n"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, full.select(*columns).collect()))
