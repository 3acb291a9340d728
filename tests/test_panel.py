"""Keys, universe, labels, targets and reports on small panels."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from daypanel.functions import rules
from daypanel.operators import (
    distinct,
    examples,
    groups,
    keys,
    labels,
    ordering,
    profile,
    returns,
    sampling,
    summaries,
    targets,
    universe,
)
from daypanel.schema import PanelKey

DAY = dt.date(2020, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def copies(spark, n=3000, hot=1000):
    """A third of all rows are copies of one key."""
    rng = random.Random(3)
    data = []
    for i in range(n):
        permno, day = (1, DAY) if i < hot else (rng.randrange(2, 50), DAY + dt.timedelta(days=rng.randrange(40)))
        data.append((permno, day, f"f{i % 5}", i, "T", 2020, rng.choice([None, 1.0, 2.0]), rng.choice(["CD", None])))
    rng.shuffle(data)
    text = "permno long, dlycaldt date, source_file string, raw_row_id long, ticker string, year int, prc double, distype string"
    return spark.createDataFrame(data, text)


def test_dedup_keeps_first_and_counts(spark):
    df = copies(spark).repartition(7)
    kept = keys.dedup_first(df, count_as="n").toPandas()
    pdf = df.toPandas().sort_values(["source_file", "raw_row_id"])
    want = pdf.groupby(["permno", "dlycaldt"]).agg(raw_row_id=("raw_row_id", "first"), n=("raw_row_id", "size"))
    assert not kept.duplicated(["permno", "dlycaldt"]).any()
    got = kept.set_index(["permno", "dlycaldt"])[["raw_row_id", "n"]].sort_index()
    assert (got.values == want.sort_index().values).all()


def test_dedup_cuts_before_the_shuffle(spark):
    plan = keys.dedup_first(copies(spark))._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan and "row_number(), 1, Final" in plan


@pytest.mark.parametrize("hot_rows", [10**6, 100])
def test_rows_of_repeated_keys(spark, hot_rows):
    df = copies(spark)
    got = keys.rows_of_repeated_keys(df, ["permno", "dlycaldt"], hot_rows)
    sizes = df.groupBy("permno", "dlycaldt").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    want = df.join(sizes, ["permno", "dlycaldt"]).select("raw_row_id", "n_rows")
    assert sorted(map(tuple, got.select("raw_row_id", "n_rows").collect())) == sorted(map(tuple, want.collect()))


def test_duplicate_reports(spark):
    df = copies(spark)
    fields = ("prc", "distype")
    diff = keys.duplicate_field_differences(df, fields=fields).toPandas().set_index(["permno", "dlycaldt"])
    pdf = df.toPandas()
    for (permno, day), g in pdf.groupby(["permno", "dlycaldt"]):
        if len(g) > 1:
            line = diff.loc[(permno, day)]
            assert line.n_rows == len(g)
            assert line.n_distinct_prc == g.prc.nunique(dropna=False)
            assert line.n_distinct_distype == g.distype.nunique(dropna=False)
    rate = keys.duplicate_difference_rate(df, fields=fields).first()
    assert rate.n_duplicate_stock_days == len(diff)
    assert rate.n_diff_prc == (diff.n_distinct_prc > 1).sum()
    assert rate.n_diff_distype == (diff.n_distinct_distype > 1).sum()
    total = keys.duplicate_summary(df).first()
    assert total.n_total_rows == 3000 and total.max_rows_per_stock_day >= 1000
    first = keys.duplicate_rows(df, 50).toPandas()
    assert len(first) == 50 and first.dlycaldt.max() == DAY


def random_base(spark, n_days=60, names=12, seed=5):
    rng = random.Random(seed)
    data = []
    for d in days(n_days):
        for p in range(names):
            if rng.random() < 0.8:
                data.append((p, d, d.year, rng.uniform(1, 20), float(rng.randrange(1, 100)), rng.choice([5.0, 6.0, 7.0]),
                             0.01, "EQTY", "COM", "NS", "Y", "N", "N"))
    text = ("permno long, dlycaldt date, year int, prc double, dlyvol double, dlycap double, dlyret double, securitytype string,"
            "securitysubtype string, sharetype string, usincflg string, shradrflg string, primaryexch string")
    return spark.createDataFrame(data, text).withColumn("dlyretmissflg", F.lit(None).cast("string"))


SMALL = universe.UniverseParams(min_price=2.0, min_adv20=50.0, min_history_obs=5, max_market_cap_rank=6, max_adv20_rank=7,
                                average_rows=4, history_rows=10)


def test_universe_agrees_with_full_ranks(spark):
    base = random_base(spark)
    got = universe.daily_universe(base, SMALL).select("permno", "dlycaldt", "market_cap_rank", "adv20_rank",
                                                     "n_common_equity_candidates")
    history = universe.add_history(base, SMALL)
    full = universe.add_ranks(history, hot_rows=3).filter(
        "prc >= 2 AND adv20 >= 50 AND hist_ret_obs_252 >= 5 AND market_cap_rank <= 6 AND adv20_rank <= 7"
    ).select(*got.columns)
    a, b = sorted(map(tuple, got.collect())), sorted(map(tuple, full.collect()))
    assert a == b and len(a) > 100


def test_universe_does_not_look_ahead(spark):
    base = random_base(spark)
    cut = DAY + dt.timedelta(days=40)
    early = F.col("dlycaldt") <= F.lit(cut)
    columns = ["permno", "dlycaldt", "adv20", "market_cap_rank", "adv20_rank", "hist_ret_obs_252"]
    whole = universe.daily_universe(base, SMALL).filter(early).select(*columns)
    short = universe.daily_universe(base.filter(early), SMALL).select(*columns)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, short.collect()))


def test_history_is_min_of_age_and_window(spark):
    h = universe.add_history(random_base(spark), SMALL).toPandas()
    assert (h.hist_ret_obs_252 == h.trading_age_obs.clip(upper=10)).all()


def series(spark, returns_flags, status="A"):
    data = [(1, d, 2020, r, f, status, "N") for d, (r, f) in zip(days(len(returns_flags)), returns_flags)]
    text = "permno long, dlycaldt date, year int, dlyret double, dlyretmissflg string, tradingstatusflg string, dlydelflg string"
    return spark.createDataFrame(data, text)


def first_label(spark, future):
    return labels.forward_labels(series(spark, [(0.0, None), *future])).orderBy("dlycaldt").first()


def test_label_first_missing_at_three(spark):
    r = first_label(spark, [(0.1, None), (0.2, None), (None, "DM"), (0.3, None), (0.1, None)])
    assert (r.target_first_missing_return_pos, r.target_first_missing_return_flag) == (3, "DM")
    assert r.bt_5d_return_zero_after_missing == pytest.approx(0.32)
    assert r.bt_5d_return_delist_stress_30 == pytest.approx(-0.076)
    assert r.bt_5d_return_delist_stress_100 == -1.0
    assert r.target_5d_raw_complete_only is None and r.target_n_valid_forward_returns == 4
    assert r.target_missing_return_flag_set == "DM" and r.target_has_delisting_missing_flag == 1


@pytest.mark.parametrize("position", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("code", ["DM", "DG", "DP", "NT", None, "MV"])
def test_label_at_each_position(spark, position, code):
    future = [(0.1, None) if k != position else (None, code) for k in range(1, 6)]
    r = first_label(spark, future)
    wealth = 1.1 ** (position - 1)
    assert r.target_first_missing_return_pos == position
    assert r.bt_5d_return_zero_after_missing == pytest.approx(wealth - 1)
    delisted = code in ("DM", "DG", "DP")
    assert r.bt_5d_return_delist_stress_30 == pytest.approx(wealth * 0.7 - 1 if delisted else wealth - 1)
    assert r.bt_5d_return_delist_stress_100 == pytest.approx(-1.0 if delisted else wealth - 1)
    # A code outside the list counts as missing but does not show in the set.
    assert r.target_missing_return_flag_set == {"MV": "", None: "NO_FLAG"}.get(code, code)


def test_label_without_future(spark):
    r = labels.forward_labels(series(spark, [(0.1, None)])).first()
    assert (r.target_first_missing_return_pos, r.target_first_missing_return_flag) == (1, "NO_FUTURE_ROW")
    assert r.bt_5d_return_zero_after_missing == 0.0 and r.target_5d_raw_complete_only is None
    assert r.current_dlyret == 0.1


def test_label_horizon_and_penalty_are_parameters(spark):
    params = labels.LabelParams(horizon=2, penalties=(0.5,))
    df = labels.forward_labels(series(spark, [(0.0, None), (0.1, None), (None, "DP"), (0.2, None)]), params)
    r = df.orderBy("dlycaldt").first()
    assert r.bt_2d_return_delist_stress_50 == pytest.approx(1.1 * 0.5 - 1) and r.target_2d_raw_complete_only is None


def test_labels_ignore_the_universe(spark):
    base = random_base(spark)
    lab = labels.forward_labels(base)
    loose = targets.join_labels(universe.daily_universe(base, SMALL), lab)
    strict = targets.join_labels(universe.daily_universe(base, universe.UniverseParams(**{**SMALL.__dict__, "min_price": 10.0})), lab)
    columns = ["permno", "dlycaldt", "target_5d_raw_complete_only", "target_n_valid_forward_returns"]
    assert set(map(tuple, strict.select(*columns).collect())) <= set(map(tuple, loose.select(*columns).collect()))


def values_by_day(spark):
    data = [(p, DAY, float(p * p)) for p in range(50)] + [(p, DAY + dt.timedelta(1), 3.0) for p in range(4)]
    data += [(1, DAY + dt.timedelta(2), 8.0), (2, DAY, None)]
    return spark.createDataFrame(data, "permno long, dlycaldt date, v double")


def test_zscore_without_spread_is_zero(spark):
    z = targets.zscore_by(values_by_day(spark).filter("v IS NOT NULL"), "v", "z").toPandas()
    flat = z[z.dlycaldt > DAY]
    assert (flat.z == 0.0).all() and len(flat) == 5
    day = z[z.dlycaldt == DAY].z
    assert day.mean() == pytest.approx(0, abs=1e-12) and day.std() == pytest.approx(1)


def test_winsor_bounds(spark):
    w = targets.winsorize_by(values_by_day(spark), "v", "t").toPandas()
    day = w[(w.dlycaldt == DAY) & w.v.notna()]
    low, high = day.v.quantile(0.01), day.v.quantile(0.99)
    assert day.t_p01.iloc[0] == pytest.approx(low) and day.t_p99.iloc[0] == pytest.approx(high)
    assert day.t_winsor.min() == pytest.approx(low) and day.t_winsor.max() == pytest.approx(high)
    assert w[w.v.isna()].t_winsor.isna().all()


def test_model_panel_matches_general_form(spark):
    base = random_base(spark)
    joined = targets.join_labels(universe.daily_universe(base, SMALL), labels.forward_labels(base))
    complete = targets.complete_rows(joined)
    window = targets.normalise_target(complete).select("permno", "dlycaldt", "target_5d_cs_zscore").toPandas()
    general = targets.zscore_by(
        targets.winsorize_by(complete, "target_5d_raw_complete_only", "target_5d"), "target_5d_winsor", "z"
    ).select("permno", "dlycaldt", "z").toPandas()
    both = window.merge(general, on=["permno", "dlycaldt"])
    assert len(both) == len(window) and both.target_5d_cs_zscore.tolist() == pytest.approx(both.z.tolist(), abs=1e-9)


def test_profile_counts(spark):
    df = spark.createDataFrame([(0, None, "x"), (5, -1.0, None), (7, 200_000.0, "y" * 25)], "permno long, prc double, ticker string")
    got = {r.variable: r for r in profile.profile(df).collect()}
    assert {k: (r.missing_count, r.abnormal_count) for k, r in got.items()} == {"permno": (0, 1), "prc": (1, 2), "ticker": (1, 1)}
    none = profile.profile(df.limit(0)).first()
    assert none.missing_pct is None and none.n_total == 0


def test_profile_of_more_variables_than_a_long_has_bits(spark):
    rng = random.Random(4)
    rows = [[None if rng.random() < k / 200 else k for k in range(90)] for _ in range(300)]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{k} long" for k in range(90)))
    registry = {f"c{k}": rules.Rule(f"c{k}", f"c{k} % 3 = 1", (f"c{k}",)) for k in range(0, 90, 2)}
    got = {r.variable: (r.missing_count, r.abnormal_count, r.n_total) for r in profile.profile(df, registry=registry).collect()}
    for k in range(90):
        there = sum(r[k] is not None for r in rows)
        assert got[f"c{k}"] == (300 - there, there if k % 2 == 0 and k % 3 == 1 else 0, 300)


def test_histogram_edges(spark):
    h = groups.histogram(spark.createDataFrame([(float(x),) for x in range(11)], "v double"), "v", 5).toPandas()
    assert h["count"].tolist() == [2, 2, 2, 2, 3] and h.bin_right.iloc[-1] == 10.0
    for rows in ([(1.0,), (1.0,)], [(None,)]):
        assert groups.histogram(spark.createDataFrame(rows, "v double"), "v").count() == 0


def test_numeric_summary_of_nothing(spark):
    r = groups.numeric_summary(spark.createDataFrame([(None,)], "v double"), "v").first()
    assert (r.n_total, r.n_missing, r.p50) == (1, 1, None)
    r = groups.numeric_summary(spark.range(101).select(F.col("id").cast("double").alias("v")), "v", exact=False).first()
    assert r.p50 == 50.0


def test_samples(spark):
    df = copies(spark)
    few = F.col("permno") == df.filter("permno > 1").first().permno
    n = df.filter(few).count()
    assert examples.sample_rows(df, few, n + 5).count() == n
    ten = [r.raw_row_id for r in examples.sample_rows(df, F.col("prc").isNull(), 10).collect()]
    again = [r.raw_row_id for r in examples.sample_rows(df.repartition(9), F.col("prc").isNull(), 10).collect()]
    assert len(ten) == 10 and ten == again


def test_sample_to_size(spark):
    df = copies(spark)
    small = sampling.sample_to_size(df, 0.02)
    bytes_per_row = sampling.average_row_bytes(df).first()[0]
    assert small.count() == int(0.02 * 1024 * 1024 / bytes_per_row)
    order = [r.raw_row_id for r in df.orderBy(examples.draw_order()).limit(small.count()).collect()]
    assert set(order) == {r.raw_row_id for r in small.collect()}
    assert sampling.sample_to_size(df, 50).count() == df.count()


def test_trailing_returns(spark):
    r = returns.add_trailing_returns(series(spark, [(0.1, None)] * 3 + [(None, None)] + [(0.1, None)] * 3), (5,), 5)
    last = r.orderBy(F.desc("dlycaldt")).first()
    assert last.ret_5d == pytest.approx(1.1**5 - 1) and last.vol_5d == pytest.approx(0.0, abs=1e-12)
    assert r.orderBy("dlycaldt").first().ret_5d is None


def test_groups_and_rules_by_hand(spark):
    df = copies(spark)
    by = groups.missing_by_group(df, "prc", ["ticker"]).first()
    assert by.n_rows == 3000 and by.missing_rate == by.n_missing / 3000
    own = groups.abnormal_by_group(df, "prc", "prc > 1.5", ["ticker"]).first()
    assert own.n_abnormal == df.filter("prc > 1.5").count()
    with pytest.raises(ValueError):
        groups.missing_by_group(df, "nothing")
    lines = profile.abnormal_examples(df.withColumn("prc", -F.col("prc")), 20).collect()
    assert len(lines) == 20 and {r.variable for r in lines} == {"prc"}


def test_other_key_names(spark):
    users = PanelKey("user", "day", ("id",))
    df = spark.createDataFrame([(1, DAY, 2), (1, DAY, 1), (2, DAY, 3)], "user long, day date, id long")
    assert sorted(r.id for r in keys.dedup_first(df, users).collect()) == [1, 3]
    assert keys.duplicate_summary(df, key=users).first().n_extra_duplicate_rows == 1


def test_stage_counts(spark):
    df = spark.range(3)
    assert {r.table_name: r.n for r in summaries.stage_row_counts({"a": df, "b": df.limit(1)}).collect()} == {"a": 3, "b": 1}


def test_folded_labels_equal_the_stepwise_ones(spark):
    """To the last bit, with series that end, codes in and outside the list, and missing returns anywhere."""
    rng = random.Random(8)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(60)]
    flags_seen = [None, "DM", "NT", "DG", "ZZ"]
    rows = [
        (e, d, None if rng.random() < 0.08 else rng.gauss(0, 0.05), rng.choice(flags_seen)) for e in range(9) for d in days if rng.random() < 0.9 or e == 0
    ] + [(99, days[0], 0.5, None)]
    core = spark.createDataFrame(rows, "permno long, dlycaldt date, dlyret double, dlyretmissflg string")
    for params in (labels.LabelParams(), labels.LabelParams(horizon=1), labels.LabelParams(horizon=12, penalties=(0.3, 1.0, 0.55))):
        folded = labels.folded_labels(core, params)
        names = folded.columns
        want = sorted(map(repr, labels.forward_labels(core, params).select(*names).collect()))
        assert sorted(map(repr, folded.collect())) == want


def test_trailing_returns_over_any_number_of_rows(spark):
    rng = random.Random(2)
    s = [(rng.gauss(0, 0.02), None) for _ in range(80)]
    got = returns.add_trailing_returns(series(spark, s), (5, 63)).orderBy("dlycaldt").collect()
    for k, r in enumerate(got):
        for n, v in ((5, r.ret_5d), (63, r.ret_63d)):
            want = None if k + 1 < n else math.prod(1 + x for x, _ in s[k + 1 - n : k + 1]) - 1
            assert v == want


def test_bitmaps_count_distinct_ids(spark):
    rng = random.Random(5)
    ids = [None, 0, -1, 1, 32767, 32768, 32769, -32768, 2**40, -(2**40), *range(100, 160)]
    rows = [(rng.choice([2019, 2020, None]), rng.choice([1, 2, 3, None]), rng.choice(ids)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "year int, day int, id long")
    days = distinct.id_bitmaps(df, ["year", "day"], "id", n=F.count("*"))
    assert days.agg(F.sum("n")).first()[0] == 3000
    for by in (["year", "day"], ["year"], []):
        got = {tuple(r)[:-1]: r.n for r in distinct.distinct_ids(days, by, "n").collect()}
        want = {tuple(r)[:-1]: r.n for r in df.groupBy(*by).agg(F.count_distinct("id").alias("n")).collect()}
        assert got == want
    pairs = spark.range(1).select(distinct.distinct_pairs(days, ["year", "day"])).first()[0]
    assert pairs == df.agg(F.count_distinct("year", "day", "id")).first()[0]
    assert distinct.distinct_ids(distinct.id_bitmaps(df.limit(0), ["year"], "id"), ["year"], "n").count() == 0
    assert not distinct.has_bitmaps(spark.createDataFrame([("x",)], "id string"), "id")


def test_the_kth_hash(spark, monkeypatch):
    """Digits of one letter put many hashes into a bin, and some are equal."""
    rng = random.Random(6)
    hashes = sorted(f"{rng.randrange(2**20):032x}"[::-1] for _ in range(400)) * 2
    draws = spark.createDataFrame([(h,) for h in hashes], "_draw string")
    for digit, levels in ((4, 2), (1, 1)):
        monkeypatch.setattr(sampling, "DIGIT", digit)
        monkeypatch.setattr(sampling, "LEVELS", levels)
        for k in (0, 1, 399, 800, 801, None):
            got = spark.range(1).select(sampling.kth_draw(draws, F.lit(k).cast("bigint"))).first()[0]
            assert got == (sorted(hashes)[k - 1] if k and 0 < k <= 800 else None)


def test_rules_of_a_caller_are_analysed(spark):
    df = copies(spark).withColumn("other", F.col("prc") + 1)
    assert rules.predicate_columns(df, "other > 1 AND abs(prc) < 3 OR ticker IN ('a', 'b')") == [c for c in df.columns if c in ("other", "prc", "ticker")]
    assert rules.column_rule("prc", "prc < other", df=df).columns == ("prc", "other")
    wrong = {
        "nothing > 1": "nothing", "prc >": "", "prc + 1": "", "sum(prc) > 1": "aggregate", "prc > (SELECT 1)": "subquery", "prc IN (SELECT 1.0)": "subquery",
        "rand() < 0.5": "again", "rand() < prc": "again", "1 = 1": "column", "row_number() OVER (ORDER BY prc) = 1": "", "explode(array(prc)) > 1": "", "no_such(prc)": "",
    }
    for predicate, reason in wrong.items():
        for use in (groups.abnormal_by_group, examples.abnormal_rows):
            with pytest.raises(ValueError, match=f"(?is){reason}"):
                use(df, "prc", predicate=predicate)
    assert examples.abnormal_rows(df, "prc", n=5, predicate="other > prc").count() == 5
    seen = examples.matches(df, F.expr("other > prc"), 5).first()
    assert seen.n_matching == df.filter("other > prc").count() and seen.n_total == df.count() and seen.n_shown == 5 and seen.drawn


def test_quantiles_of_several_columns(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), rng.gauss(0, 1), rng.choice([None, 1.0, 2.0]), rng.randrange(9), None) for _ in range(500)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c int, d double")
    wanted = {"x": ("a", 0.5), "y": ("b", 0.1), "z": ("c", 0.5), "w": ("a", 0.9), "none": ("d", 0.5)}
    got = {r.g: tuple(r)[1:] for r in ordering.column_quantiles(df, ["g"], wanted).collect()}
    plain = df.groupBy("g").agg(*[F.percentile(c, p).alias(n) for n, (c, p) in wanted.items()]).collect()
    assert got == {r.g: tuple(r)[1:] for r in plain}


def test_universe_of_rows_is_that_of_the_first_rows(spark):
    """Keys have several rows, alike in their order, of other kinds, too cheap, or not ready."""
    rng = random.Random(12)
    base = random_base(spark).drop("n_rows_same_stock_day")
    rows = []
    for r in base.collect():
        for k in range(rng.choice([1, 1, 2, 4])):
            x = r.asDict() | {"source_file": rng.choice(["a", "b", None]), "raw_row_id": rng.choice([1, 2, None]) if k else 3}
            x |= rng.choice([{}, {}, {"prc": 1.0}, {"sharetype": "AD"}, {"usincflg": None}, {"dlyret": None}])
            rows.append((*x.values(), "A", None, 5))
    names = [*x, "tradingstatusflg", "dlydelflg", "shrout"]
    types = {f.name: f.dataType.simpleString() for f in base.schema}
    more = {"source_file": "string", "raw_row_id": "long", "tradingstatusflg": "string", "dlydelflg": "string", "shrout": "long"}
    core = spark.createDataFrame(rows, ", ".join(f"{n} {(types | more)[n]}" for n in names))
    decisive = PanelKey(order=("source_file", "raw_row_id", "prc", "dlyvol", "dlycap", "dlyret", "_common"))
    common = F.coalesce(universe.common_equity_condition(SMALL), F.lit(False))
    ready = keys.dedup_first(core.withColumn("_common", common).filter(universe.is_ready()), decisive, count_as="n_rows_same_stock_day")
    want = universe.daily_universe(ready.drop("_common"), SMALL)
    shown = ["permno", "dlycaldt", "source_file", "raw_row_id", "prc", "n_rows_same_stock_day", "adv20", "hist_ret_obs_252",
             "market_cap_rank", "adv20_rank", "n_common_equity_candidates", "in_universe_flag"]
    got = universe.universe_of_rows(core, SMALL)
    assert set(got.columns) == set(want.columns)
    a, b = (sorted(map(repr, d.select(*shown).collect())) for d in (got, want))
    assert a == b and len(a) > 30
    assert universe.universe_of_rows(core, SMALL, count_as=None).count() == len(a)


def test_queries_on_days_read_the_universe_once(spark):
    """The table is scanned for the few columns of first rows and for whole rows, not for each report on days."""
    from daypanel.plans import catalog

    plan = catalog.QUERIES["universe_daily_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan
    plan = catalog.uncounted_universe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
