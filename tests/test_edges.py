"""Inputs at the edge: odd spellings, infinite and huge numbers, quotes, equal file names, rows without a year."""

import csv
import datetime

import pytest
from pyspark.sql import functions as F

from daypanel.functions.casting import typed
from daypanel.operators import ingest, profile, sampling, summaries
from daypanel.operators.labels import LabelParams
from daypanel.plans import catalog
from daypanel.schema import PanelSchema
from daypanel.sources import readers, sinks

DAY = datetime.date(2019, 1, 2)


def cast_all(spark, texts, logical):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in df.select("k", typed("t", logical).alias("v")).orderBy("k").collect()]


def test_integers_are_rounded_once(spark):
    texts = ["2.4999999999", "2." + "4" + "9" * 30, "2.5", "-2.5", "1e3", "24999999999e-10", "٣", "+7", ".5", "1.", "x", "", "99999999999999999999"]
    assert cast_all(spark, texts, "int") == [2, 2, 3, -3, 1000, 2, None, 7, 1, 1, None, None, None]


def test_dates_are_whole(spark):
    texts = ["2019-01-02", "2019/1/2", "2019-1/2", "2019/01-02", "2019-01-02 garbage", "2019-01-02Tfoo", "2019-01-02 10:00:00", "2019-01-02T10:00", "2019-01", "2019-02-30"]
    assert cast_all(spark, texts, "date") == [DAY, DAY, None, None, None, None, DAY, DAY, None, None]


def test_evidence_of_huge_and_infinite_values(spark):
    df = spark.createDataFrame([(1e33,), (float("inf"),), (1.5,), (None,)], "v double")
    got = [r.e for r in df.select(profile.evidence_text(df, "v").alias("e")).collect()]
    assert got == ["1.0E33", "Infinity", "1.500000", None]
    sizes = [r.b for r in df.select(sampling.csv_bytes(df).alias("b")).collect()]
    assert sizes == [7, 9, 13, 1]


def test_penalties_have_names_of_their_own():
    p = LabelParams(penalties=(0.301, 0.304, 0.3, 1.0))
    assert [p.stressed(x)[-4:] for x in p.penalties] == ["30p1", "30p4", "s_30", "_100"]
    with pytest.raises(ValueError):
        LabelParams(penalties=(0.3, 0.3))


ROWS = [('say "hi", ok', "1"), ("back\\", "2"), ("  spaces  ", "3"), ("", "4"), (None, "5"), ("two\nlines", "6")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "x string, n string")
    sinks.write_report(df, str(tmp_path / "r"), single_file=True)
    (file,) = (tmp_path / "r").glob("*.csv")
    with open(file, newline="") as f:
        assert [tuple(r) for r in csv.reader(f)][1:] == [(x or "", n) for x, n in ROWS]
    back = readers.read_raw_csv(spark, str(tmp_path / "r"), multi_line=True)
    assert {(r.x or "", r.n) for r in back.collect()} == {(x or "", n) for x, n in ROWS}


def test_equal_file_names_stay_apart(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(2).coalesce(1).write.parquet(str(tmp_path / name))
        (file,) = (tmp_path / name).glob("*.parquet")
        file.rename(tmp_path / name / "0000.parquet")
    both = readers.scan_raw(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted((r.source_file, r.raw_row_id) for r in both.collect()) == [(f"{n}/0000.parquet", k) for n in "ab" for k in (0, 1)]
    one = readers.scan_raw(spark, str(tmp_path / "a"))
    assert {r.source_file for r in one.collect()} == {"0000.parquet"}
    file = readers.scan_raw(spark, str(tmp_path / "a" / "0000.parquet"))
    assert {r.source_file for r in file.collect()} == {"0000.parquet"}


def test_every_year_stays(spark):
    rows = [(1, DAY, 2019, 0.1, 0.0), (2, DAY, 2019, None, None), (1, datetime.date(2020, 1, 2), 2020, None, None), (1, None, None, 0.2, 0.0)]
    panel = spark.createDataFrame(rows, "permno long, dlycaldt date, year int, target_5d_raw_complete_only double, target_5d_cs_zscore double")
    got = {r.year: (r.n_rows, r.median_target_5d_raw) for r in summaries.panel_yearly_summary(panel).collect()}
    assert got == {2019: (2, 0.1), 2020: (1, None), None: (1, 0.2)}
    assert {r.year for r in summaries.universe_yearly_summary(panel.withColumn("x", F.lit(1))).collect()} == {2019, 2020, None}


LINES = 'id,note,day\n1,a,2019-01-02\n4,5\n6,7,8,9\n10,"x, ""y"", z",2019-01-03\n11,"p, q",2019-01-04,"r, s"\n12,,\n'


def test_records_of_a_wrong_length_are_kept_whole(spark, tmp_path):
    (tmp_path / "x.csv").write_text(LINES)
    schema = PanelSchema.parse("id:int note:char day:date")
    plain = readers.read_raw_csv(spark, str(tmp_path / "x.csv"))
    assert plain.columns == ["id", "note", "day"] and plain.count() == 6  # cut and filled, without a word
    for declared in (None, schema):
        raw = readers.read_raw_csv(spark, str(tmp_path / "x.csv"), declared, record=ingest.BAD_RECORD)
        sinks.write_parts(raw, str(tmp_path / "raw"))
        scanned = readers.scan_raw(spark, str(tmp_path / "raw"))
        bad = {r.bad_record: (r.id, r.note, r.day, r.failed_columns, r.record_fault) for r in ingest.quarantine(scanned, schema).collect()}
        assert bad == {
            "4,5": ("4", "5", None, "", "too_few_fields"),
            "6,7,8,9": ("6", "7", "8", "day", "too_many_fields"),
            '11,"p, q",2019-01-04,"r, s"': ("11", "p, q", "2019-01-04", "", "too_many_fields"),
        }
        core = ingest.apply_types(ingest.readable(scanned), schema)
        assert core.columns == ["source_file", "raw_row_id", "id", "note", "day"]
        assert sorted((r.id, r.note) for r in core.collect()) == [(1, "a"), (4, "5"), (10, 'x, "y", z'), (12, None)]
    with pytest.raises(ValueError, match="already"):
        readers.read_raw_csv(spark, str(tmp_path / "x.csv"), record="note")
    sample = ingest.quarantine_sample(ingest.quarantine(scanned, schema))
    assert sample.columns == ["source_file", "raw_row_id", "failed_columns", "record_fault"]


def test_totals_of_ids_beyond_a_long(spark):
    """Parts of a sum may leave the longs that the whole comes back to; a total without a long is NULL, not an error."""
    top = 2**63 - 1
    rows = [(1, top, 1.0, None), (1, 5, 1.0, 1.0), (1, -9, 1.0, 1.0), (2, top, 2.0, 1.0), (2, 1, 2.0, 1.0), (3, None, None, None)]
    df = spark.createDataFrame(rows, "year int, raw_row_id long, prc double, dlyret double").coalesce(1)
    got = {r.year: (r.n_rows, r.sum_row_id, r.sum_prc, r.n_ret) for r in catalog.yearly_totals(df).collect()}
    assert got == {1: (3, top - 4, 3.0, 2), 2: (2, None, 4.0, 2), 3: (1, None, None, 0)}
