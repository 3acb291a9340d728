"""Named queries over the test tables, one per operator.

The panel they read is derived from ``lineitem`` (see ``sources.fixture``), so
their work grows with the tables. Doubles are rounded here, not in the
operators, so that results of two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daypanel import session
from daypanel.functions.quality import add_quality_flags, flag_columns
from daypanel.functions.derived import add_distribution_features, add_ohlc_features, distribution_kind
from daypanel.functions.rules import UNIVERSE_RULES
from daypanel.operators import (
    distinct,
    examples,
    groups,
    ingest,
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
from daypanel.schema import DAILY_STOCK, PanelKey, PanelSchema
from daypanel.sources import fixture, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]

KEY = ["permno", "dlycaldt"]
ROW = [*KEY, "source_file", "raw_row_id"]
RAW = PanelSchema.parse(fixture.RAW_VARIABLES)
CSV = PanelSchema.parse(fixture.CSV_VARIABLES)
# Limits that most candidates pass; one query has tight ones, where cutting is what it shows. Averages are ranked by
# four digits, since two engines differ in the last bits of an average.
PARAMS = universe.UniverseParams(
    min_price=500.0, min_adv20=40_000.0, min_history_obs=126, max_market_cap_rank=3000, max_adv20_rank=4000, adv_digits=4
)
TIGHT = replace(PARAMS, max_market_cap_rank=6, max_adv20_rank=7)
SAMPLE_MB = 0.5


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals.

    Spelled with floor, since engines disagree on where ``round`` sends a tie;
    the extra thousandth of a step sends ties up even when the engines differ
    in a last bit.
    """
    step = 10.0**digits

    def nearest(name: str):
        return (F.floor(F.col(name) * step + 0.501) / step).alias(name)

    return df.select(
        *[nearest(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields]
    )


# ---- stages over the derived panel ----
def panel(spark, sf):
    return fixture.panel(session.split_methods(spark), sf)


def prepared(spark, sf):
    return universe.prepare_all(panel(spark, sf))


def base(spark, sf):
    return universe.ready_base(panel(spark, sf))


def candidates(spark, sf):
    return universe.common_equity(base(spark, sf), PARAMS)


def in_universe(spark, sf, params=PARAMS):
    # Flags depend on their row alone: added to the rows that are left.
    return universe.prepare_all(universe.universe_of_rows(panel(spark, sf), params))


def stored_universe(spark, sf):
    """The universe written once, without what follows from each row."""
    return universe.prepare_all(sinks.stored(universe.universe_of_rows(panel(spark, sf), PARAMS), "universe"))


def uncounted_universe(spark, sf):
    """The universe for queries that do not show how many rows a key had, nor flags."""
    return universe.universe_of_rows(panel(spark, sf), PARAMS, count_as=None)


def core_dedup(spark, sf):
    return keys.dedup_first(panel(spark, sf))


def label_table(spark, sf):
    return labels.forward_labels(core_dedup(spark, sf))


def joined(spark, sf):
    return targets.join_labels(uncounted_universe(spark, sf), label_table(spark, sf))


def model_panel(spark, sf):
    # Rows are read for the statistics of days and once more as they are: a stage table, as in the pipeline, of the
    # columns that the queries over it show.
    complete = targets.complete_rows(joined(spark, sf))
    shown = [*KEY, "year", "market_cap_rank", *labels.label_columns()]
    return targets.normalise_target(sinks.stored(complete.select(*shown), "complete"))


# ---- queries ----
def raw_csv_scan(spark, sf):
    """Customers as CSV and back, everything as text."""
    path = sinks.scratch_path(spark, "raw-csv")
    source = fixture.table(spark, sf, "customer")
    source = source.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    sinks.write_report(source, path)
    sinks.remove_at_end(spark, path)
    return readers.read_raw_csv(spark, path)


def csv_records(spark, sf):
    """Lines of different lengths as the pipeline reads them: from text files
    to raw parts, which are scanned like any others."""
    text, parts = sinks.scratch_path(spark, "csv-lines"), sinks.scratch_path(spark, "csv-parts")
    fixture.csv_lines(spark, sf).write.text(text)
    raw = readers.read_raw_csv(spark, text, CSV, header=False, record=ingest.BAD_RECORD)
    sinks.write_parts(raw, parts, rows=1000)
    for path in (text, parts):
        sinks.remove_at_end(spark, path)
    return readers.scan_raw(spark, parts).drop("source_file", "raw_row_id")


def csv_quarantine(spark, sf):
    return ingest.quarantine(csv_records(spark, sf), CSV)


def csv_core(spark, sf):
    return ingest.apply_types(ingest.readable(csv_records(spark, sf)), CSV)


def raw_parts(spark, sf):
    """Raw parts with names in capitals: rows by part, of a given size at most,
    and their contents under names in lower case."""
    path = sinks.scratch_path(spark, "raw-parts")
    part = fixture.table(spark, sf, "part")
    sinks.write_parts(part.repartition(2, "p_partkey").toDF(*[c.upper() for c in part.columns]), path, rows=300)
    sinks.remove_at_end(spark, path)
    scanned = readers.scan_raw(spark, path)
    sizes = scanned.groupBy("source_file").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.struct((F.max("n") <= 300).alias("fits")).alias("s"))
    return scanned.withColumn("s", largest.scalar()).select(
        "p_partkey", "p_name", (F.col("raw_row_id") < 300).alias("row_below_300"), F.col("s.fits").alias("parts_fit")
    )


def replaced_year(spark, sf):
    """A stage table after a rerun of one of its years."""
    path = sinks.scratch_path(spark, "replaced")
    rows = panel(spark, sf).select(*ROW, "year", "prc")
    sinks.write_panel(rows, path)
    sinks.remove_at_end(spark, path)
    sinks.write_panel(rows.filter("year = 1995").withColumn("prc", F.col("prc") * 2), path, keep_others=True)
    back = readers.scan_panel(spark, path)
    return rounded(back.groupBy("year").agg(F.count("*").alias("n_rows"), F.sum("prc").alias("sum_prc")), 2)


def series(spark, sf, df, name, then=None):
    # No stage has more rows than the table it comes from, which knows their number from its footers.
    n = fixture.table(spark, sf, "lineitem").count()
    rounds = sinks.series_rounds(n)
    buckets = rounds * -(-sinks.series_buckets(n) // rounds)
    path = sinks.scratch_path(spark, name)
    table, seen = sinks.write_series(df, path, buckets=buckets, then=then, rounds=rounds)
    sinks.remove_at_end(spark, path)
    return table, seen


def series_join(spark, sf):
    """Base and labels dealt out once by security; their join and the history
    of its rows read them where they lie."""
    spark = session.with_settings(spark, session.JOINED_AS_DEALT)
    # Labels first: they shuffle more, and the base is not on disk yet.
    made, _ = series(spark, sf, core_dedup(spark, sf), "labels", then=labels.forward_labels)
    rows, _ = series(spark, sf, universe.ready_rows(panel(spark, sf)).select(*KEY, "prc", "dlyvol", "dlycap", "dlyret"), "base")
    both = universe.add_history(targets.join_labels(rows, made), PARAMS)
    return rounded(both.select(*KEY, "adv20", "hist_ret_obs_252", "trading_age_obs", "target_1d_raw", "target_5d_raw_complete_only"), 4)


def counts_while_writing(spark, sf):
    """Rows of stages, and rows that share their key, from the writes themselves."""
    _, base_seen = series(spark, sf, universe.ready_rows(panel(spark, sf)).select(*KEY, "prc"), "base")
    path = sinks.scratch_path(spark, "labels")
    same_day = F.count_if(F.col("fwd_date_1") == F.col("dlycaldt"))
    labels_seen = sinks.write_panel(label_table(spark, sf).select(*KEY, "year", "fwd_date_1"), path, metrics={"repeated": same_day})
    sinks.remove_at_end(spark, path)
    seen = {"base": base_seen, "labels": labels_seen}
    return spark.createDataFrame([(n, s["rows"], s["repeated"]) for n, s in seen.items()], "table_name string, n long, n_repeated long")


def quantiles_from_days(spark, sf):
    """Yearly quantiles by the sketches of days, stored once."""
    rows = sinks.stored(panel(spark, sf).select("year", "dlycaldt", "prc"), "prices")
    days = sinks.stored(ordering.quantile_sketches(rows, ["year", "dlycaldt"], "prc"), "sketches")
    wanted = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    years = ordering.exact_quantiles(rows, ["year"], "prc", wanted, ordering.merged_sketches(days, ["year"]), few_groups=True)
    return rounded(years, 4)


def distinct_names(spark, sf):
    """Securities by year and by exchange and year, from the bitmaps of days."""
    days = distinct.id_bitmaps(panel(spark, sf), ["year", "primaryexch", "dlycaldt"], "permno")
    by_both = distinct.distinct_ids(days, ["year", "primaryexch"], "n_names")
    return by_both.unionByName(distinct.distinct_ids(days, ["year"], "n_names").withColumn("primaryexch", F.lit("all")))


OWN_RULE = "dlyclose > 0.94 * dlyhigh OR dlyvol >= 48"


def abnormal_by_group_own(spark, sf):
    """By a predicate of the caller over several columns."""
    return rounded(groups.abnormal_by_group(panel(spark, sf), "dlybid", OWN_RULE, top=None))


def sample_abnormal_own(spark, sf):
    return rounded(examples.abnormal_rows(panel(spark, sf), "dlybid", predicate=OWN_RULE).select(*ROW, "dlybid", "dlyvol"))


def abnormal_by_group_universe(spark, sf):
    """Over the universe, with its rules and a variable that only it has."""
    uni = in_universe(spark, sf)
    registered = groups.abnormal_by_group(uni, "disfacpr", top=None, registry=UNIVERSE_RULES)
    own = groups.abnormal_by_group(uni, "market_cap_rank", "market_cap_rank <= 3 AND adv20_rank > 3", top=None, registry=UNIVERSE_RULES)
    return rounded(registered.withColumn("variable", F.lit("disfacpr")).unionByName(own.withColumn("variable", F.lit("market_cap_rank"))))


def abnormal_examples_universe(spark, sf):
    return profile.abnormal_examples(stored_universe(spark, sf), registry=UNIVERSE_RULES)


def sample_matches(spark, sf):
    """How many rows stand behind the examples."""
    rows = panel(spark, sf)
    found = [
        examples.matches(rows, F.expr(c)).withColumn("condition", F.lit(c))
        for c in ("disdivamt IS NULL", "disdivamt < 0", "dlyvol > 49 AND dlyret IS NULL AND dlyfacprc < 1")
    ]
    return reduce(DataFrame.unionByName, found)


def duplicate_rows_wide(spark, sf):
    """Every column of the rows that share their key."""
    return rounded(keys.duplicate_rows(panel(spark, sf)), 4)


def long_labels(horizon: int) -> Query:
    return lambda spark, sf: rounded(labels.folded_labels(core_dedup(spark, sf), labels.LabelParams(horizon=horizon)))


def raw_scan_with_provenance(spark, sf):
    scanned = readers.scan_raw(spark, f"{sf}/part.parquet")
    return scanned.select("source_file", "raw_row_id", "p_partkey", "p_name")


def partitioned_scan(spark, sf):
    path = sinks.scratch_path(spark, "panel")
    sinks.write_panel(panel(spark, sf).select(*ROW, "year", "prc", "dlyret"), path)
    sinks.remove_at_end(spark, path)
    return rounded(yearly_totals(readers.scan_panel(spark, path)), 2)


def yearly_totals(rows):
    """Row ids add up in decimals: those of a year of large tables are beyond a long. A total that no long holds, where
    the cast of the SQL raises an error, is NULL."""
    ids = F.sum(F.col("raw_row_id").cast("decimal(20,0)")).try_cast("long")
    return rows.groupBy("year").agg(
        F.count("*").alias("n_rows"), ids.alias("sum_row_id"), F.sum("prc").alias("sum_prc"), F.count("dlyret").alias("n_ret")
    )


def report_csv_roundtrip(spark, sf):
    path = sinks.scratch_path(spark, "report")
    counts = groups.value_counts(fixture.table(spark, sf, "orders"), "o_orderpriority", count_name="n_rows")
    sinks.write_report(counts, path, single_file=True)
    sinks.remove_at_end(spark, path)
    return readers.read_raw_csv(spark, path)


def typed_cast(spark, sf):
    return rounded(ingest.apply_types(fixture.raw_text(spark, sf), RAW))


def cast_failure_flags(spark, sf):
    flagged = ingest.add_cast_flags(fixture.raw_text(spark, sf), RAW)
    return flagged.select("raw_row_id", *[f"{n}_cast_failed" for n, _ in RAW.castable])


def cast_failed_columns(spark, sf):
    return ingest.add_failed_columns(fixture.raw_text(spark, sf), RAW).select("raw_row_id", "failed_columns")


def cast_quarantine(spark, sf):
    return ingest.quarantine(fixture.raw_text(spark, sf), RAW)


def cast_quarantine_sample(spark, sf):
    key = PanelKey(order=("raw_row_id",))
    return ingest.quarantine_sample(ingest.quarantine(fixture.raw_text(spark, sf), RAW), 200, key)


def price_normalise(spark, sf):
    raw = panel(spark, sf).select(*ROW, "dlyprc")
    return rounded(ingest.add_price_columns(raw), 4)


def flags(group: str) -> Query:
    def query(spark, sf):
        return panel(spark, sf).select(*ROW, *[c.alias(n) for n, c in flag_columns(group).items()])

    return query


def derived(columns: list[str], digits: int = 6) -> Query:
    def query(spark, sf):
        return rounded(prepared(spark, sf).select(*ROW, *columns), digits)

    return query


def ready_base(spark, sf):
    return rounded(base(spark, sf).select(*ROW, "prc", "dollar_volume", "bid_ask_spread", "n_rows_same_stock_day"))


def terminal_events(spark, sf):
    return rounded(universe.terminal_events(prepared(spark, sf)).select(*ROW, "dlyprcflg", "prc", "terminal_event_flag"))


def common_equity_candidates(spark, sf):
    return rounded(candidates(spark, sf).select(*ROW, "primaryexch", "securitytype", "prc"))


def daily_universe(spark, sf, params=PARAMS):
    columns = [
        *ROW, "ticker", "prc", "dollar_volume_for_universe", "adv20", "avg_volume_20d", "hist_ret_obs_252",
        "trading_age_obs", "market_cap_rank", "adv20_rank", "n_common_equity_candidates", *params.stamp(),
    ]
    return rounded(in_universe(spark, sf, params).select(*columns), 4)


def daily_universe_tight(spark, sf):
    return daily_universe(spark, sf, TIGHT)


def missing_return_without_flag(spark, sf):
    return examples.listing(core_dedup(spark, sf), examples.return_without_flag(), [*ROW, "ticker", "tradingstatusflg"])


def open_only_missing(spark, sf):
    """The derived panel lacks OHLC as a block, so its open is taken away on
    delisting days for this query."""
    odd = panel(spark, sf).withColumn("dlyopen", F.when(F.col("dlydelflg") == "N", F.col("dlyopen")))
    return rounded(examples.listing(odd, examples.open_only_missing(), [*ROW, "dlyhigh", "dlylow", "dlyclose"]))


def ohlc_inconsistent_rows(spark, sf):
    return rounded(examples.ohlc_inconsistent_rows(panel(spark, sf)), 4)


def invalid_quote_rows(spark, sf):
    listed = examples.listing(prepared(spark, sf), examples.quote_invalid(), [*ROW, "dlybid", "dlyask", "bid_ask_spread"])
    return rounded(listed, 4)


def quote_missing_rows(spark, sf):
    return rounded(examples.listing(in_universe(spark, sf), examples.quote_missing(), [*ROW, "prc", "dlyask"]), 4)


def retained_return_flag_rows(spark, sf):
    return summaries.retained_return_flag_rows(panel(spark, sf)).select(*ROW, "dlyretmissflg")


def panel_label_join(spark, sf):
    wanted = [*KEY, "market_cap_rank", "target_1d_raw", "target_5d_raw_complete_only", "target_first_missing_return_flag",
              "fwd_date_5"]
    return rounded(joined(spark, sf).select(*wanted))


def duplicate_rows_detail(spark, sf):
    return rounded(keys.duplicate_rows(panel(spark, sf), columns=keys.COMPACT_COLUMNS), 4)


def profile_core(spark, sf):
    core = panel(spark, sf)
    logical = {n: t for n, t in DAILY_STOCK if n in core.columns}
    schema = logical | {"dlyprc_negative_flag": "bool", "prc": "decimal"}
    report = profile.profile(core, schema)
    return rounded(report.filter(F.col("type") != profile.CROSS_COLUMN).drop("abnormal_rule"), 8)


def profile_universe(spark, sf):
    report = profile.profile(stored_universe(spark, sf), registry=UNIVERSE_RULES)
    return rounded(report.drop("type", "abnormal_rule"), 8)


def profile_cross_column(spark, sf):
    return rounded(profile.cross_column_profile(panel(spark, sf)).drop("abnormal_rule"), 8)


def duplicate_summary(spark, sf):
    return keys.duplicate_summary(panel(spark, sf))


def duplicate_summary_by_year(spark, sf):
    return keys.duplicate_summary(panel(spark, sf), ["year"])


def event_duplicate_summary(spark, sf):
    """A second panel: users by day, from the event table."""
    user_day = PanelKey("user_id", "day", ("event_id",))
    events = fixture.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return keys.duplicate_summary(events, key=user_day)


def event_dedup(spark, sf):
    user_day = PanelKey("user_id", "day", ("ts", "event_id"))
    events = fixture.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    kept = keys.dedup_first(events, user_day, count_as="n_events")
    return kept.select("user_id", "day", "event_id", "event_type", "n_events")


def rows_per_key(spark, sf):
    return keys.rows_per_key_histogram(panel(spark, sf))


def duplicate_event_digest(spark, sf):
    return rounded(keys.duplicate_event_digest(panel(spark, sf)))


def duplicate_field_differences(spark, sf):
    return keys.duplicate_field_differences(panel(spark, sf))


def duplicate_difference_rate(spark, sf):
    return keys.duplicate_difference_rate(panel(spark, sf))


def missing_by_group(spark, sf):
    return rounded(groups.missing_by_group(panel(spark, sf), "dlyret"))


def abnormal_by_group(spark, sf):
    return rounded(groups.abnormal_by_group(panel(spark, sf), "disdivamt"))


def nonmissing_by_group(spark, sf):
    return rounded(groups.nonmissing_by_group(panel(spark, sf), "distype"))


def value_counts(spark, sf):
    return groups.value_counts(panel(spark, sf), "dlyretmissflg", null_label=groups.MISSING_LABEL, count_name="count")


def value_counts_nonmissing(spark, sf):
    return groups.nonmissing_values(panel(spark, sf), "disdetailtype")


def value_counts_orders(spark, sf):
    return groups.value_counts(fixture.table(spark, sf, "orders"), "o_orderpriority", count_name="count")


def retained_return_flag_counts(spark, sf):
    return summaries.retained_return_flags(core_dedup(spark, sf))


def numeric_summary(spark, sf):
    return rounded(groups.numeric_summary(panel(spark, sf), "dlyret"))


def numeric_summary_orders(spark, sf):
    return rounded(groups.numeric_summary(fixture.table(spark, sf, "orders"), "o_totalprice"), 4)


def histogram(spark, sf):
    return rounded(groups.histogram(panel(spark, sf), "dlycap"), 4)


def histogram_orders(spark, sf):
    return rounded(groups.histogram(fixture.table(spark, sf, "orders"), "o_totalprice", 20), 4)


def missing_return_status(with_flag: bool) -> Query:
    return lambda spark, sf: summaries.missing_return_status(core_dedup(spark, sf), with_flag)


def dedup_ready_base(spark, sf):
    return base(spark, sf).select(*ROW, "ticker", "n_rows_same_stock_day")


def dedup_core(spark, sf):
    return rounded(core_dedup(spark, sf).select(*ROW, "tradingstatusflg", "prc"))


def history(spark, sf):
    narrow = candidates(spark, sf).select(*KEY, "prc", "dlyvol", "dlycap", "dlyret")
    return universe.add_history(narrow, PARAMS)


def rolling_adv20(spark, sf):
    return rounded(history(spark, sf).select(*KEY, "dollar_volume_for_universe", "adv20", "avg_volume_20d"), 4)


def rolling_history(spark, sf):
    return history(spark, sf).select(*KEY, "hist_ret_obs_252", "trading_age_obs")


def cross_section_ranks(spark, sf):
    # Read more than once, so written once, as the pipeline does.
    stored = sinks.stored(history(spark, sf).select(*KEY, "dlycap", "adv20"), "history")
    ranked = universe.add_ranks(stored, params=PARAMS)
    return ranked.select(*KEY, "market_cap_rank", "adv20_rank", "n_common_equity_candidates")


def forward_leads(spark, sf):
    leads = labels.add_leads(core_dedup(spark, sf).select(*KEY, "dlyret", "dlyretmissflg", "tradingstatusflg", "dlydelflg"))
    return rounded(leads.drop("dlyret", "dlyretmissflg", "tradingstatusflg", "dlydelflg"))


def label_query(*columns: str) -> Query:
    return lambda spark, sf: rounded(label_table(spark, sf).select(*KEY, *columns))


def label_layout(spark, sf):
    return rounded(label_table(spark, sf))


def target_winsor(spark, sf):
    stored = sinks.stored(label_table(spark, sf).select(*KEY, "target_5d_raw_complete_only"), "labels")
    return rounded(targets.winsorize_by(stored, "target_5d_raw_complete_only", "target_5d"))


def target_zscore(spark, sf):
    rows = label_table(spark, sf).select(*KEY, "target_5d_raw_complete_only").filter("target_5d_raw_complete_only IS NOT NULL")
    return rounded(targets.zscore_by(rows, "target_5d_raw_complete_only", "zscore"))


def model_panel_query(spark, sf):
    return rounded(
        model_panel(spark, sf).select(
            *KEY, "market_cap_rank", "target_5d_raw_complete_only", "target_5d_p01", "target_5d_p99", "target_5d_winsor",
            "target_5d_winsor_mean", "target_5d_winsor_sd", "n_cross_section", "target_5d_cs_zscore",
        )
    )


def latest_base_rows(spark, sf):
    return rounded(summaries.latest_rows(base(spark, sf), summaries.BASE_PREVIEW, 20, "permno"), 4)


def latest_universe_rows(spark, sf):
    return rounded(summaries.latest_rows(in_universe(spark, sf), summaries.UNIVERSE_PREVIEW, 30, "market_cap_rank"), 4)


def dropped_label_examples(spark, sf):
    shown = summaries.dropped_label_examples(joined(spark, sf))
    return shown.select(*KEY, "market_cap_rank", "target_missing_return_flag_set", "target_n_valid_forward_returns")


def missing_label_examples(spark, sf):
    shown = summaries.missing_label_examples(label_table(spark, sf))
    return shown.select(*KEY, "target_first_missing_return_pos", "target_missing_return_flag_set")


def abnormal_examples(spark, sf):
    return profile.abnormal_examples(panel(spark, sf))


def sample_missing(spark, sf):
    return rounded(examples.missing_examples(panel(spark, sf), "disdivamt").select(*ROW, "prc"))


def sample_abnormal(spark, sf):
    return rounded(examples.abnormal_rows(panel(spark, sf), "disdivamt").select(*ROW, "disdivamt"))


def sample_nonmissing(spark, sf):
    return rounded(examples.nonmissing_examples(panel(spark, sf), "shareclass").select(*ROW, "prc"))


def sample_ohlc_missing(spark, sf):
    return rounded(examples.ohlc_missing_sample(panel(spark, sf)).select(*ROW, "prc"))


def sampled(spark, sf):
    rows = panel(spark, sf).select(*ROW, "ticker", "dlyprcflg", "dlyvol", "shrout")
    return sampling.sample_to_size(rows, SAMPLE_MB)


def sample_size_summary(spark, sf):
    return rounded(sampling.sample_summary(sampled(spark, sf), SAMPLE_MB))


def sample_estimate(spark, sf):
    """What fixed the size of the sample: the mean of ten thousand rows, and the rows that make the size."""
    rows = panel(spark, sf).select(*ROW, "ticker", "dlyprcflg", "dlyvol", "shrout")
    return rounded(sampling.size_estimate(rows, SAMPLE_MB))


def stage_row_counts(spark, sf):
    return summaries.stage_row_counts(
        {
            "daily_core": panel(spark, sf),
            "daily_universe_prepare_all": prepared(spark, sf),
            "daily_universe_ready_base": base(spark, sf),
            "daily_terminal_events": universe.terminal_events(prepared(spark, sf)),
        }
    )


def trailing(spark, sf):
    return returns.add_trailing_returns(core_dedup(spark, sf).select(*KEY, "dlyret"))


def over(stage: Callable, operator: Callable, digits: int = 6) -> Query:
    return lambda spark, sf: rounded(operator(stage(spark, sf)), digits)


CLEAN = ["dlyopen_clean", "dlyhigh_clean", "dlylow_clean", "dlyclose_clean"]
INTRADAY = ["intraday_ret_strict", "intraday_range_strict", "intraday_ret_clean", "intraday_range_clean"]
STEPS = range(1, 6)

QUERIES: dict[str, Query] = {
    "raw_csv_scan": raw_csv_scan,
    "csv_quarantine": csv_quarantine,
    "csv_core": csv_core,
    "raw_parts": raw_parts,
    "replaced_year": replaced_year,
    "series_join": series_join,
    "counts_while_writing": counts_while_writing,
    "quantiles_from_days": quantiles_from_days,
    "distinct_names": distinct_names,
    "abnormal_by_group_own": abnormal_by_group_own,
    "abnormal_by_group_universe": abnormal_by_group_universe,
    "abnormal_examples_universe": abnormal_examples_universe,
    "sample_abnormal_own": sample_abnormal_own,
    "sample_matches": sample_matches,
    "duplicate_rows_wide": duplicate_rows_wide,
    "label_21d": long_labels(21),
    "label_63d": long_labels(63),
    "raw_scan_with_provenance": raw_scan_with_provenance,
    "partitioned_scan": partitioned_scan,
    "report_csv_roundtrip": report_csv_roundtrip,
    "typed_cast": typed_cast,
    "cast_failure_flags": cast_failure_flags,
    "cast_failed_columns": cast_failed_columns,
    "cast_quarantine": cast_quarantine,
    "cast_quarantine_sample": cast_quarantine_sample,
    "price_normalise": price_normalise,
    "spread_missing_reasons": over(prepared, examples.spread_missing_reasons),
    **{f"flags_{g}": flags(g) for g in ("status", "price", "ohlc", "quote", "size", "return", "meta", "event")},
    "ohlc_clean": derived(CLEAN),
    "log_features": derived(["log_prc", "log_dlycap", "log_num_trades", "log_market_maker_count"]),
    "dollar_volume": derived(["dollar_volume"], 4),
    "bid_ask_spread": derived(["bid_ask_spread"]),
    "intraday_features": derived(INTRADAY),
    "ready_base": ready_base,
    "terminal_events": terminal_events,
    "common_equity_candidates": common_equity_candidates,
    "daily_universe": daily_universe,
    "daily_universe_tight": daily_universe_tight,
    "missing_return_without_flag": missing_return_without_flag,
    "open_only_missing": open_only_missing,
    "ohlc_inconsistent_rows": ohlc_inconsistent_rows,
    "invalid_quote_rows": invalid_quote_rows,
    "quote_missing_rows": quote_missing_rows,
    "retained_return_flag_rows": retained_return_flag_rows,
    "panel_label_join": panel_label_join,
    "universe_yearly_summary": over(
        lambda spark, sf: sinks.stored(uncounted_universe(spark, sf).select(*KEY, "year"), "universe"),
        summaries.universe_yearly_summary,
    ),
    "duplicate_rows_detail": duplicate_rows_detail,
    "panel_coverage_summary": over(joined, summaries.panel_coverage_summary),
    "profile_core": profile_core,
    "profile_universe": profile_universe,
    "profile_cross_column": profile_cross_column,
    "duplicate_summary": duplicate_summary,
    "duplicate_summary_by_year": duplicate_summary_by_year,
    "event_duplicate_summary": event_duplicate_summary,
    "event_dedup": event_dedup,
    "rows_per_key": rows_per_key,
    "duplicate_event_digest": duplicate_event_digest,
    "duplicate_field_differences": duplicate_field_differences,
    "duplicate_difference_rate": duplicate_difference_rate,
    # Read for sizes and twice for medians.
    "universe_daily_summary": over(
        lambda spark, sf: sinks.stored(
            uncounted_universe(spark, sf).select(*KEY, "year", "prc", "dlycap", "adv20", "market_cap_rank", "adv20_rank"), "universe"
        ),
        summaries.universe_daily_summary,
        4,
    ),
    "missing_by_group": missing_by_group,
    "abnormal_by_group": abnormal_by_group,
    "nonmissing_by_group": nonmissing_by_group,
    "value_counts": value_counts,
    "value_counts_nonmissing": value_counts_nonmissing,
    "value_counts_orders": value_counts_orders,
    "missing_return_status_with_flag": missing_return_status(True),
    "missing_return_status_without_flag": missing_return_status(False),
    "missing_return_flag_counts": over(core_dedup, summaries.missing_return_flags),
    "retained_return_flag_counts": retained_return_flag_counts,
    "numeric_summary": numeric_summary,
    "numeric_summary_orders": numeric_summary_orders,
    "histogram": histogram,
    "histogram_orders": histogram_orders,
    "ohlc_missing_by_price_flag": over(prepared, examples.ohlc_missing_by_price_flag),
    "missing_return_summary": over(core_dedup, summaries.missing_return_summary),
    "label_summary": over(label_table, summaries.label_summary),
    "label_yearly_summary": over(label_table, summaries.label_yearly_summary),
    "label_flag_set_counts": over(label_table, lambda d: summaries.label_flag_counts(d, "target_missing_return_flag_set")),
    "label_first_flag_counts": over(
        label_table, lambda d: summaries.label_flag_counts(d, "target_first_missing_return_flag")
    ),
    "panel_daily_summary": over(model_panel, summaries.panel_daily_summary),
    "panel_yearly_summary": over(
        lambda spark, sf: sinks.stored(
            model_panel(spark, sf).select(*KEY, "year", "target_5d_raw_complete_only", "target_5d_cs_zscore"), "model"
        ),
        summaries.panel_yearly_summary,
    ),
    "recent_label_availability": over(joined, summaries.recent_label_availability),
    "dedup_ready_base": dedup_ready_base,
    "dedup_core": dedup_core,
    "rolling_adv20": rolling_adv20,
    "rolling_history": rolling_history,
    "cross_section_ranks": cross_section_ranks,
    "forward_leads": forward_leads,
    "label_missing_flags": label_query(*[f"miss_flag_{k}" for k in STEPS]),
    "label_first_missing": label_query(
        "target_first_missing_return_pos", "target_first_missing_return_flag", "target_n_valid_forward_returns",
        "target_has_missing_return", "target_has_delisting_missing_flag",
    ),
    "label_flag_set": label_query("target_missing_return_flag_set"),
    "label_5d_complete": label_query("target_1d_raw", "target_5d_raw_complete_only"),
    "label_zero_after_missing": label_query("bt_5d_return_zero_after_missing"),
    "label_delist_stress": label_query("bt_5d_return_delist_stress_30", "bt_5d_return_delist_stress_100"),
    "label_layout": label_layout,
    "target_winsor": target_winsor,
    "target_zscore": target_zscore,
    "model_panel": model_panel_query,
    "latest_base_rows": latest_base_rows,
    "latest_universe_rows": latest_universe_rows,
    "dropped_label_examples": dropped_label_examples,
    "missing_label_examples": missing_label_examples,
    "abnormal_examples": abnormal_examples,
    "sample_missing": sample_missing,
    "sample_abnormal": sample_abnormal,
    "sample_nonmissing": sample_nonmissing,
    "sample_ohlc_missing": sample_ohlc_missing,
    "size_targeted_sample": lambda spark, sf: sampled(spark, sf).select(*ROW),
    "sample_size_summary": sample_size_summary,
    "sample_estimate": sample_estimate,
    "stage_row_counts": stage_row_counts,
    "rolling_return": lambda spark, sf: rounded(trailing(spark, sf).select(*KEY, "ret_5d", "ret_21d")),
    "rolling_return_63d": lambda spark, sf: rounded(
        returns.add_trailing_returns(core_dedup(spark, sf).select(*KEY, "dlyret"), (63,)).select(*KEY, "ret_63d")
    ),
    "rolling_volatility": lambda spark, sf: rounded(trailing(spark, sf).select(*KEY, "vol_21d")),
    "ohlc_valid_features": lambda spark, sf: rounded(
        add_ohlc_features(panel(spark, sf)).select(*ROW, "ohlc_usable_flag", "intraday_ret_valid", "intraday_range_valid")
    ),
    "distribution_yield": lambda spark, sf: rounded(
        add_distribution_features(panel(spark, sf)).select(*ROW, "distribution_yield", "split_event_flag", "abs_disfacpr"), 8
    ),
    "distribution_kinds": lambda spark, sf: panel(spark, sf).select(*ROW, distribution_kind().alias("distribution_kind")),
}
