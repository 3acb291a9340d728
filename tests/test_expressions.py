"""Casting, flags, derived variables and rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daypanel.functions import casting, derived, quality, rules
from daypanel.operators import universe
from daypanel.schema import DAILY_STOCK, Names, PanelKey, PanelSchema, columns_of, require_columns

TEXT = (
    "permno long, dlycaldt date, tradingstatusflg string, dlydelflg string, dlyprcflg string, prc double,"
    "dlyprc_negative_flag boolean, dlyopen double, dlyhigh double, dlylow double, dlyclose double, dlybid double,"
    "dlyask double, dlyvol double, dlycap double, dlyprcvol double, dlyret double, dlyretx double, dlyreti double,"
    "securitytype string, sharetype string, shrout long, shradrflg string, usincflg string, dlynumtrd long,"
    "dlymmcnt long, exchangetier string, delactiontype string, shareclass string, disexdt date, distype string,"
    "disdivamt double, disfacpr double, disfacshr double, disordinaryflg string, dlyfacprc double, disdetailtype string"
)
FIELDS = [f.strip().split()[0] for f in TEXT.split(",")]


def rows(spark, *changes):
    plain = {
        "permno": 1, "dlycaldt": dt.date(2020, 1, 2), "tradingstatusflg": "A", "dlydelflg": "N", "dlyprcflg": "TR",
        "prc": 10.0, "dlyprc_negative_flag": False, "dlyopen": 10.0, "dlyhigh": 11.0, "dlylow": 9.0, "dlyclose": 10.5,
        "dlybid": 9.9, "dlyask": 10.1, "dlyvol": 100.0, "dlycap": 1000.0, "dlyprcvol": 1.0, "dlyret": 0.1,
        "dlyretx": 0.1, "dlyreti": 0.0, "securitytype": "EQTY", "sharetype": "NS", "shrout": 5, "shradrflg": "N",
        "usincflg": "Y", "dlynumtrd": 0, "dlymmcnt": 3, "exchangetier": "T", "dlyfacprc": 1.0,
    }
    data = [tuple((plain | change).get(f) for f in FIELDS) for change in changes]
    return spark.createDataFrame(data, TEXT)


def flags_of(spark, **change):
    return quality.add_quality_flags(rows(spark, change)).first().asDict()


def test_dictionary_shape():
    kinds = [t for _, t in DAILY_STOCK]
    assert (len(kinds), len(set(DAILY_STOCK.names))) == (94, 94)
    assert {t: kinds.count(t) for t in set(kinds)} == {"char": 44, "decimal": 26, "int": 12, "date": 12}
    with pytest.raises(ValueError):
        PanelSchema.parse("a:money")


def test_column_checks(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="nope"):
        require_columns(df, ["id", "nope"])
    with pytest.raises(TypeError):
        PanelKey(date="id").check_date(df)
    assert [tuple(r) for r in columns_of(df).collect()] == [(0, "id", "bigint")]


@pytest.mark.parametrize(
    ("text", "logical", "expected"),
    [
        (" 42 ", "int", 42), ("1.5", "int", 2), ("-2.5", "int", -3), ("1e3", "int", 1000), ("7.0", "int", 7),
        ("99999999999999999999", "int", None), ("9007199254740993", "int", 9007199254740993), ("abc", "int", None),
        ("", "int", None), ("  ", "char", None), (" x ", "char", "x"), ("1.0d", "decimal", None), ("2.5f", "decimal", None),
        (".5", "decimal", 0.5), ("1,000", "decimal", None), ("-inf", "decimal", float("-inf")),
        ("2019", "date", None), ("2019-01", "date", None), ("2019/01/02", "date", dt.date(2019, 1, 2)),
        ("2019-1-2", "date", dt.date(2019, 1, 2)), ("2019-02-30", "date", None), ("20190102", "date", None),
    ],
)
def test_typed(spark, text, logical, expected):
    df = spark.createDataFrame([(text,)], "x string")
    row = df.select(casting.typed("x", logical).alias("v"), casting.cast_failed("x", logical).alias("f")).first()
    assert row.v == expected
    assert row.f == (expected is None and text.strip() != "")


def test_flag_count_and_unknown_is_zero(spark):
    df = rows(spark, {})
    blank = df.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    flags = quality.add_quality_flags(blank).first().asDict()
    added = {k: v for k, v in flags.items() if k not in FIELDS}
    assert len(added) == 40
    ones = {k for k, v in added.items() if v == 1}
    assert ones == {
        "invalid_price_flag", "ohlc_missing_flag", "bidask_missing_flag", "invalid_volume_flag",
        "invalid_market_cap_flag", "price_volume_missing_flag", "return_missing_flag", "price_return_missing_flag",
        "income_return_missing_flag", "security_metadata_missing_flag", "num_trades_missing_flag",
        "market_maker_count_missing_flag", "exchange_tier_missing_flag",
    }
    assert set(added.values()) == {0, 1}


def test_delisting_at_zero_price(spark):
    f = flags_of(spark, tradingstatusflg="D", dlyprcflg="DA", dlydelflg="Y", prc=0.0)
    assert all(f[x] for x in ("terminal_event_flag", "daily_delisting_flag", "invalid_price_flag", "zero_price_flag"))


def test_high_price_and_extreme_return(spark):
    assert flags_of(spark, prc=400_000.0)["high_price_flag"] == 1
    for before, after in ((0.2399, 9.77), (1.45, 45.08)):
        assert flags_of(spark, dlyret=after / before - 1)["extreme_return_flag"] == 1
    assert flags_of(spark, dlyret=-1.0)["extreme_return_flag"] == 0


def test_ohlc_inconsistent(spark):
    f = flags_of(spark, dlyopen=5.72, dlyhigh=6.09, dlylow=5.76, dlyclose=5.99)
    assert (f["ohlc_inconsistent_flag"], f["has_ohlc_flag"]) == (1, 1)


def test_quote_priced_row(spark):
    df = rows(spark, {"dlyopen": None, "dlyhigh": None, "dlylow": None, "dlyclose": None, "dlyprcflg": "BA"})
    r = derived.add_derived(quality.add_quality_flags(df)).first()
    assert r.ohlc_imputed_from_prc_flag == 1
    assert (r.dlyopen_clean, r.dlyhigh_clean, r.dlylow_clean, r.dlyclose_clean) == (10.0,) * 4
    assert r.intraday_ret_strict is None and r.intraday_ret_clean == 0.0 and r.intraday_range_clean == 0.0


def test_crossed_quote(spark):
    r = derived.add_derived(rows(spark, {"dlyask": 9.0})).first()
    assert r.bid_ask_spread is None and r.log_num_trades == 0.0


def test_adjustment_row(spark):
    change = {"disdivamt": -0.21, "disfacpr": -0.035959, "dlyfacprc": 0.964041, "distype": "FRS"}
    f = flags_of(spark, **change)
    assert all(f[x] for x in ("negative_disfacpr_flag", "negative_disdivamt_flag", "price_adjustment_event_flag"))
    kind = rows(spark, change).select(derived.distribution_kind().alias("k")).first().k
    assert kind == "adjustment"


def test_renamed_columns(spark):
    df = rows(spark, {"prc": 0.0}).withColumnRenamed("prc", "close_price")
    flags = quality.add_quality_flags(df, ["price"], Names(prc="close_price")).first()
    assert flags.zero_price_flag == 1


def test_rule_registry(spark):
    assert len(rules.CORE_RULES) == 47 + 9 and len(rules.UNIVERSE_RULES) == 54 + 1 + 9
    assert rules.column_rule("prc").predicate == "prc <= 0 OR prc > 100000"
    with pytest.raises(ValueError):
        rules.column_rule("ticker_of_nothing")
    df = spark.createDataFrame([(None,), (3.0,), (-1.0,)], "prc double")
    hits = [r.h for r in df.select(rules.column_rule("prc").hit().alias("h")).collect()]
    assert hits == [False, False, True]


def test_ready_condition_is_the_flags(spark):
    changes = [{}] + [
        {column: value}
        for column, values in {
            "tradingstatusflg": ["D", "H", None], "dlydelflg": ["Y", None], "dlyprcflg": ["DA", None],
            "prc": [0.0, -1.0, None], "dlyvol": [0.0, None], "dlycap": [-1.0, None], "dlyret": [None],
            "securitytype": [None], "sharetype": [None], "shrout": [0, None], "shradrflg": [None],
        }.items()
        for value in values
    ]
    df = quality.add_quality_flags(rows(spark, *changes))
    by_flags = quality.all_of(F.col(name) == value for name, value in universe.READY.items())
    both = df.select(F.coalesce(universe.is_ready(), F.lit(False)).alias("a"), by_flags.alias("b")).collect()
    assert all(r.a == r.b for r in both) and sum(r.a for r in both) == 5
