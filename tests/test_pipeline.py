"""The whole way from a CSV file to the sample, and the file formats."""

import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daypanel.operators import keys, labels, universe
from daypanel.operators.universe import UniverseParams
from daypanel.plans.pipeline import PanelPipeline
from daypanel.schema import DAILY_STOCK
from daypanel.sources import readers, sinks


def raw_file(path, n_days=40, names=6):
    rng = random.Random(11)
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, [n.upper() for n in DAILY_STOCK.names])
        out.writeheader()
        for d in range(n_days):
            for p in range(1, names + 1):
                for copy in range(2 if rng.random() < 0.1 else 1):
                    day = dt.date(2019, 12, 15) + dt.timedelta(days=d)
                    price = rng.uniform(5, 50)
                    row = {
                        "permno": p, "dlycaldt": day, "dlyprc": price if p % 2 else -price, "dlyvol": rng.randrange(1, 1000),
                        "dlycap": rng.uniform(1, 9), "dlyret": rng.gauss(0, 0.02), "tradingstatusflg": "A",
                        "securityactiveflg": "Y", "dlydelflg": "N", "securitytype": "EQTY", "securitysubtype": "COM",
                        "sharetype": "NS", "usincflg": "Y", "shradrflg": "N", "primaryexch": "N", "shrout": "100",
                        "ticker": f"T{p}", "dlynumtrd": "many" if (d, p) == (3, 2) else "7", "distype": "CD" if copy else "",
                    }
                    out.writerow({k.upper(): v for k, v in row.items()})
        out.writerow({"PERMNO": "", "DLYCALDT": "2020-01-01", "DLYPRC": "1"})


def test_whole_pipeline(spark, tmp_path):
    raw_file(tmp_path / "raw.csv")
    params = UniverseParams(min_price=1.0, min_adv20=1.0, min_history_obs=3, max_market_cap_rank=4, max_adv20_rank=5)
    pipe = PanelPipeline(spark, str(tmp_path / "out"), universe_params=params)
    sample = pipe.run(str(tmp_path / "raw.csv"), sample_megabytes=0.02)
    raw, core = spark.read.parquet(pipe.path("raw")), pipe.table("core")
    assert core.count() + 1 == raw.count()
    assert spark.read.parquet(pipe.path("core_without_key")).count() == 1
    bad = spark.read.parquet(pipe.path("cast_failures")).collect()
    assert {r.failed_columns for r in bad} == {"dlynumtrd"}
    assert core.filter(F.col("dlyprc_negative_flag") & (F.col("prc") > 0)).count() > 0
    assert set(core.select("year").distinct().toPandas().year) == {2019, 2020}
    base = pipe.table("base")
    assert base.select("permno", "dlycaldt").distinct().count() == base.count() == 240
    assert base.agg(F.sum("n_rows_same_stock_day")).first()[0] == core.count()
    panel = pipe.table("model_panel")
    assert 0 < panel.count() < pipe.table("universe").count()
    assert panel.groupBy("dlycaldt").agg(F.abs(F.avg("target_5d_cs_zscore")).alias("m")).agg(F.max("m")).first()[0] < 1e-9
    assert 0 < sample.count() <= panel.count()
    pipe.write_reports()
    stages = {r["table_name"]: int(r["n"]) for r in readers.read_raw_csv(spark, pipe.path("reports/stage_rows")).collect()}
    assert stages["core"] == core.count() and stages["terminal_events"] == 0


def test_part_size_and_schema_merge(spark, tmp_path):
    path = str(tmp_path / "parts")
    sinks.write_parts(spark.range(25).coalesce(1).withColumnRenamed("id", "A"), path, rows=10)
    assert len(list((tmp_path / "parts").glob("*.parquet"))) == 3
    more = str(tmp_path / "more")
    spark.range(3).select(F.col("id").alias("A"), F.lit("x").alias("B")).write.parquet(more)
    back = readers.scan_raw(spark, [path, more])
    assert back.columns == ["source_file", "raw_row_id", "a", "b"]
    assert back.filter("b IS NULL").count() == 25
    assert back.select("source_file", "raw_row_id").distinct().count() == 28


def test_year_directories_prune(spark, tmp_path):
    path = str(tmp_path / "panel")
    sinks.write_panel(spark.range(100).withColumn("year", (F.col("id") % 3 + 2000).cast("int")), path)
    plan = readers.scan_panel(spark, path).filter("year = 2001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_text_reading_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "x.csv").write_text("cusip,n\n00012,1e3\n")
    assert tuple(readers.read_raw_csv(spark, str(tmp_path / "x.csv")).first()) == ("00012", "1e3")


def test_scratch_folder_comes_from_the_session():
    class Conf:
        def get(self, name, default):
            return "hdfs://shared/" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert sinks.scratch_path(Session(), "x").startswith("hdfs://shared/daypanel/x-")


@pytest.mark.parametrize("name", ["stored"])
def test_stored_reads_back(spark, name):
    df = spark.range(5).withColumn("v", F.col("id") / 2)
    assert sorted(map(tuple, sinks.stored(df, name).collect())) == sorted(map(tuple, df.collect()))


def years_of(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_one_year_is_replaced_and_the_others_stay(spark, tmp_path):
    path = tmp_path / "panel"
    rows = spark.range(90).select("id", (F.col("id") % 3 + 2000).cast("int").alias("year"))
    seen = sinks.write_panel(rows, str(path), metrics={"largest": F.max("id")})
    assert seen == {"rows": 90, "largest": 89}
    before = years_of(path)
    sinks.write_panel(rows.filter("year = 2001").withColumn("id", F.col("id") + 1000), str(path), keep_others=True)
    after = years_of(path)
    assert {f.parent.name for f in set(before) & set(after)} == {"year=2000", "year=2002"}
    assert all(before[f] == after[f] for f in set(before) & set(after))
    back = readers.scan_panel(spark, str(path))
    assert back.filter("id >= 1000").count() == 30 and back.count() == 90
    odd = rows.withColumn("year", F.when(F.col("id") < 10, F.lit(None)).otherwise(F.lit(2005)).cast("int"))
    sinks.write_panel(odd, str(path))  # the whole table: old years go, rows without a year stay
    assert {r.year: r.n for r in readers.scan_panel(spark, str(path)).groupBy("year").agg(F.count("*").alias("n")).collect()} == {None: 10, 2005: 80}


def test_directories_of_any_name(spark, tmp_path):
    path = str(tmp_path / "panel")
    names = ["a/b", "x=y", "50 %", "ü:", "", None, "plain"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names * 2)], "id long, part string")
    sinks.write_panel(rows, path, by="part")
    sinks.write_panel(rows.filter("part IS NULL OR part <> 'plain'"), path, by="part")
    back = readers.scan_panel(spark, path, rows.schema).collect()
    assert sorted((r.id, r.part) for r in back if r.part) == sorted((k, n) for k, n in enumerate(names * 2) if n and n != "plain")
    assert sum(not r.part for r in back) == 4


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = spark.range(60).select("id", (F.col("id") % 3 + 2000).cast("int").alias("year"))
    sinks.write_panel(rows, path)
    broken = rows.withColumn("id", F.when(F.col("id") == 59, F.raise_error(F.lit("no"))).otherwise(F.col("id") + 500).cast("long"))
    for keep_others in (False, True):
        with pytest.raises(Exception, match="no"):
            sinks.write_panel(broken, path, keep_others=keep_others)
        assert sorted(r.id for r in readers.scan_panel(spark, path).collect()) == list(range(60))


def test_pipeline_of_series_dealt_once(spark, tmp_path):
    raw_file(tmp_path / "raw.csv", n_days=15, names=4)
    dealt = PanelPipeline(spark, str(tmp_path / "dealt"), buckets=3)
    dealt.ingest_csv(str(tmp_path / "raw.csv"))
    core = dealt.build_core()
    unique = keys.dedup_first(core)
    dealt.save(universe.ready_rows(core), "base")
    dealt.build_labels()
    for name, plain in (("base", universe.ready_rows(core)), ("core_dedup", unique), ("labels", labels.forward_labels(unique))):
        assert sorted(map(repr, dealt.table(name).select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
    stages = ("core", "base", "labels")
    assert sorted(map(tuple, dealt.counts(stages).collect())) == sorted((n, dealt.table(n).count()) for n in stages)


def test_a_stage_with_repeated_keys_stops(spark, tmp_path):
    day = dt.date(2020, 1, 1)
    rows = spark.createDataFrame([(1, day, 2020, 0.1), (1, day, 2020, 0.2), (2, day, 2020, 0.1)], "permno long, dlycaldt date, year int, dlyret double")
    for buckets in (None, 2):
        pipe = PanelPipeline(spark, str(tmp_path / f"p{buckets}"), buckets=buckets)
        with pytest.raises(sinks.RepeatedKeys):
            pipe.save(rows.withColumn("fwd_date_1", F.col("dlycaldt")), "labels", None if buckets else {"repeated": F.count_if(F.col("fwd_date_1") == F.col("dlycaldt"))})
