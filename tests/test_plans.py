"""Shapes that plans must have at any scale."""

import re
import time

import pytest
from pyspark.sql import functions as F

from daypanel import session
from daypanel.operators import examples, keys, labels, ordering, profile, sampling, targets, universe
from daypanel.plans import catalog
from daypanel.plans.catalog import PARAMS, panel
from daypanel.schema import DEFAULT_KEY
from daypanel.session import WIDE_PANEL_SETTINGS
from daypanel.sources import readers, sinks

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    core = sinks.stored(panel(spark, SF_DIR), "plan-core")
    plan = plan_of(universe.ready_rows(core).select("permno", "dlycaldt"))
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan)
    assert pushed
    for filters, schema in pushed:
        for wanted in ("EqualTo(tradingstatusflg,A)", "GreaterThan(prc,0.0)", "GreaterThan(dlyvol,0.0)", "IsNotNull(dlyret)"):
            assert wanted in filters
        assert "dlyopen" not in schema and "distype" not in schema


def test_history_is_one_shuffle_of_narrow_rows(spark):
    base = sinks.stored(universe.ready_rows(panel(spark, SF_DIR)), "plan-base")
    narrow = universe.common_equity(base, PARAMS).select("permno", "dlycaldt", "prc", "dlyvol", "dlycap", "dlyret")
    plan = plan_of(universe.add_history(narrow, PARAMS))
    assert plan.count("Exchange hashpartitioning") == 1


def test_daily_ranks_are_split_by_part_first(spark):
    base = sinks.stored(universe.ready_rows(panel(spark, SF_DIR)), "plan-base")
    plan = plan_of(universe.daily_universe(base, PARAMS))
    assert re.search(r"hashpartitioning\(dlycaldt#\d+, _part#\d+", plan)
    assert "SinglePartition" not in plan


@pytest.fixture
def tuned(spark):
    before = {k: spark.conf.get(k) for k in WIDE_PANEL_SETTINGS}
    for k, v in WIDE_PANEL_SETTINGS.items():
        spark.conf.set(k, v)
    # Small tables are joined by broadcast whatever their layout.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for k, v in before.items():
        spark.conf.set(k, v)


def test_tables_dealt_once_are_not_dealt_again(tuned, tmp_path):
    """First rows, leads, the label join and the history of a security read its rows where they lie."""
    spark = tuned
    rows = keys.dedup_first(panel(spark, SF_DIR))
    dealt, seen = sinks.write_series(rows, str(tmp_path / "core"), buckets=4)
    assert seen["rows"] == dealt.count() and seen["repeated"] == 0
    made, _ = sinks.write_series(labels.forward_labels(dealt), str(tmp_path / "labels"), buckets=4)
    again = readers.scan_series(spark, str(tmp_path / "core"), rows.schema, universe.DEFAULT_KEY, 4)
    for source in (dealt, again):
        first = keys.dedup_first(source, count_as="n")
        led = labels.add_leads(source.select("permno", "dlycaldt", "dlyret", "dlyretmissflg", "tradingstatusflg", "dlydelflg"))
        joined = targets.join_labels(source.select("permno", "dlycaldt", "prc", "dlyvol", "dlycap", "dlyret"), made)
        history = universe.add_history(joined, PARAMS)
        for step in (first, led, joined, history):
            plan = plan_of(step)
            assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
        for step, plain in ((first, keys.dedup_first(rows, count_as="n")), (led.select("permno", "dlycaldt", "fwd_date_5", "ret_3"), None)):
            assert step.count() == rows.count()
            assert plain is None or sorted(map(repr, step.collect())) == sorted(map(repr, plain.collect()))
        assert history.count() == rows.count()


def test_a_series_with_repeated_days_stops(spark, tmp_path):
    rows = panel(spark, SF_DIR).select("permno", "dlycaldt", "prc")
    with pytest.raises(sinks.RepeatedKeys, match="share permno and dlycaldt"):
        sinks.write_series(rows, str(tmp_path / "twice"), buckets=3)


def test_profile_is_one_scan(spark):
    stored = sinks.stored(panel(spark, SF_DIR), "plan-profile")
    plan = plan_of(profile.profile(stored))
    assert plan.count("Scan parquet") == 1 or plan.count("FileScan parquet") == 1


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_read_their_input_twice(spark, few):
    """For the sketches and for the values; the branch for groups whose sketch failed is dropped before it runs."""
    stored = sinks.stored(panel(spark, SF_DIR).select("dlycaldt", "prc"), "plan-prices")
    found = ordering.exact_quantiles(stored, ["dlycaldt"], "prc", {"m": 0.5}, few_groups=few)
    found.collect()
    final = plan_of(found)
    assert "isFinalPlan=true" in final
    ran = final.split("+- == Initial Plan ==")[0]
    assert ran.count("FileScan parquet") <= 2


def test_samples_are_found_by_counting(spark):
    stored = sinks.stored(panel(spark, SF_DIR), "plan-sample")
    plan = plan_of(sampling.sample_to_size(stored, 0.1))
    assert "Window" not in plan and "TakeOrdered" not in plan and "Sort [" not in plan


def test_examples_are_planned_in_a_second(spark):
    """Neither the number of rules nor what the table is made of may show in the time the optimizer takes."""
    import time

    df = panel(spark, SF_DIR)
    plan_of(profile.abnormal_examples(df))  # classes are loaded
    start = time.perf_counter()
    plan_of(profile.abnormal_examples(panel(spark, SF_DIR)))
    assert time.perf_counter() - start < 3
    assert plan_of(examples.abnormal_rows(df, "prc"))


def test_long_horizons_have_no_longer_plans(spark):
    core = sinks.stored(keys.dedup_first(panel(spark, SF_DIR)), "plan-labels")
    sizes = [len(plan_of(labels.folded_labels(core, labels.LabelParams(horizon=h)))) for h in (5, 63)]
    assert abs(sizes[0] - sizes[1]) < 300


def test_long_labels_walk_no_list_of_steps(spark):
    """Of the functions that step through an array for each row only the fold of the returns is left."""
    plan = plan_of(labels.folded_labels(keys.dedup_first(panel(spark, SF_DIR)), labels.LabelParams(horizon=63)))
    assert "lambdafunction" in plan
    for step in ("transform(", "exists(", "filter(", "array_intersect(", "array_repeat("):
        assert step not in plan


def test_buckets_grow_with_the_rows(spark, tmp_path, monkeypatch):
    assert [sinks.series_buckets(n) for n in (0, 600_000, 2_000_001, 216_000_000)] == [8, 8, 9, 864]
    monkeypatch.setattr(sinks.series_buckets, "__defaults__", (8, 500))
    plan = plan_of(catalog.series_join(spark, SF_DIR))
    assert "SelectedBucketsCount: 12 out of 12" in plan  # 6,000 rows, 500 a bucket


def test_series_are_joined_where_they_lie(spark, monkeypatch):
    """In a session with Spark's own settings, which it keeps."""
    monkeypatch.setattr(sinks.series_rounds, "__defaults__", (2_500, 8))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = dict(spark.conf.getAll)
    try:
        found = catalog.series_join(spark, SF_DIR)
        plan = plan_of(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SelectedBucketsCount: 9 out of 9" in plan  # 6,000 rows, three rounds
    assert before["spark.sql.autoBroadcastJoinThreshold"] == found.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert {k: v for k, v in spark.conf.getAll.items()} | {"spark.sql.autoBroadcastJoinThreshold": "-1"} == before
    assert spark.conf.get(session.CO_PARTITION) == "true"


def test_labels_are_made_after_their_rows_are_dealt(spark):
    """Two shuffles, for first rows and by security, of the columns that labels are made from."""
    core = sinks.stored(panel(spark, SF_DIR), "plan-dealt")
    plan = plan_of(sinks.dealt(keys.dedup_first(core), DEFAULT_KEY, 6, labels.forward_labels, rounds=3, k=1))
    lines = plan.split("Initial Plan")[0].splitlines()
    shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and "hashpartitioning(permno" in lines[shuffles[0]] and ", 2)" in lines[shuffles[0]]
    below = "\n".join(lines[shuffles[0] :])
    assert "fwd_date_1" not in below and "disdivamt" not in below
    # Rows of other rounds are left out where they are read.
    assert any("pmod(hash(permno" in line for line in lines[shuffles[1] :])


@pytest.mark.parametrize("rounds", [1, 2, 6])
def test_rounds_make_one_table(spark, tmp_path, rounds):
    rows = keys.dedup_first(panel(spark, SF_DIR)).withColumn("permno", F.when(F.col("permno") > 0, F.col("permno")))
    rows = keys.dedup_first(rows)  # a security without a name is one like any other
    table, seen = sinks.write_series(rows, str(tmp_path / "t"), buckets=6, then=labels.forward_labels, rounds=rounds)
    plain = labels.forward_labels(rows)
    assert seen == {"rows": plain.count(), "repeated": 0}
    assert sorted(map(repr, table.collect())) == sorted(map(repr, plain.collect()))
    files = [f.name for f in (tmp_path / "t").glob("part-*")]
    assert len(files) == len({re.search(r"_(\d{5})\.", f)[1] for f in files}) <= 6  # a bucket is in one round


def test_rounds_see_repeated_days(spark, tmp_path):
    rows = panel(spark, SF_DIR).select("permno", "dlycaldt", "prc")
    n, days = rows.count(), rows.distinct().select("permno", "dlycaldt").distinct().count()
    with pytest.raises(sinks.RepeatedKeys, match=f"{n - days} of {n} rows share permno"):
        sinks.write_series(rows, str(tmp_path / "twice"), buckets=4, rounds=2)
    for wrong in ({"buckets": 5}, {"buckets": 4, "metrics": {"n": F.count("*")}}):
        with pytest.raises(ValueError):
            sinks.write_series(rows, str(tmp_path / "not"), rounds=2, **wrong)


def test_rounds_grow_with_the_rows():
    assert [sinks.series_rounds(n) for n in (0, 600_000, 4_000_001, 36_000_000, 216_000_000)] == [1, 1, 2, 8, 8]


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return set(re.findall(r"shuffle_(\d+)_", disk.getAllFiles().mkString(" ")))

    before = shuffled()
    sinks.write_series(keys.dedup_first(panel(spark, SF_DIR)), str(tmp_path / "t"), buckets=4, then=labels.forward_labels, rounds=2)
    until = time.time() + 10
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(*session.SHUFFLES_GO) == "false"


def test_values_of_repeated_keys_are_not_dealt_again(spark):
    """Rows are dealt once by key, and once to find large keys; their values go nowhere."""
    stored = sinks.stored(panel(spark, SF_DIR), "plan-differences")
    for report in (keys.duplicate_field_differences, keys.duplicate_event_digest):
        found = report(stored)
        found.collect()
        plan = plan_of(found).split("Initial Plan")[0]
        shuffles = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning", line)]
        assert len(shuffles) <= 2


@pytest.mark.parametrize("given, then", [("65535", "8000"), ("4000", "4000")])
def test_queries_split_what_the_compiler_would_not_take(spark, given, then):
    """Labels and flags are projections of more bytecode than a method may have to be compiled; a chosen limit stays."""
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", given)
        catalog.QUERIES["label_layout"](spark, SF_DIR)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == then
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)
