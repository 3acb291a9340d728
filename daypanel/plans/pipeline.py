"""The stages from raw files to the model panel.

Each stage reads the tables of earlier stages and writes its own, so a stage
that is read several times is computed once and a lost executor costs a part of
one stage at most.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from daypanel.functions.quality import any_of
from daypanel.operators import examples, groups, ingest, keys, labels, profile, sampling, summaries, targets, universe
from daypanel.functions.rules import UNIVERSE_RULES
from daypanel.schema import DAILY_STOCK, DEFAULT_KEY, PanelKey, PanelSchema
from daypanel.sources import readers, sinks


#: stages with one row per security and day, which are read by security
SERIES = ("base", "core_dedup", "universe", "labels")


@dataclass
class PanelPipeline:
    """Stage tables live under ``root``; reports under ``root/reports``."""

    spark: SparkSession
    root: str
    schema: PanelSchema = DAILY_STOCK
    key: PanelKey = DEFAULT_KEY
    #: into how many buckets the tables of series are dealt, None for directories of years
    buckets: int | None = None
    universe_params: universe.UniverseParams = field(default_factory=universe.UniverseParams)
    label_params: labels.LabelParams = field(default_factory=labels.LabelParams)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(self.path(f"schemas/{name}")).schema
        if self.buckets and name in SERIES:
            return readers.scan_series(self.spark, self.path(name), schema, self.key, self.buckets)
        return readers.scan_panel(self.spark, self.path(name), schema)

    def save(self, df: DataFrame, name: str, metrics: dict[str, Column] | None = None) -> DataFrame:
        """The schema and the number of rows are kept beside the table: a stage
        without rows, such as terminal events in a quiet year, has no file to
        read the one from, and the other was counted as the rows were written.
        A stage whose ``repeated`` rows are counted must have none."""
        if self.buckets and name in SERIES:
            _, seen = sinks.write_series(df, self.path(name), self.key, self.buckets, metrics)
        else:
            seen = sinks.write_panel(df, self.path(name), metrics=metrics)
        if seen.get("repeated"):
            raise sinks.RepeatedKeys(f"{name}: {seen['repeated']} rows share {self.key.entity} and {self.key.date} with the next")
        self.spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(self.path(f"schemas/{name}"))
        self.count(name, seen["rows"])
        return self.table(name)

    def count(self, name: str, rows: int) -> None:
        counted = self.spark.createDataFrame([(name, rows)], "table_name string, n long")
        counted.write.mode("overwrite").parquet(self.path(f"counts/{name}"))

    def counts(self, names: Iterable[str]) -> DataFrame:
        """Rows of the stages, as counted while they were written."""
        return self.spark.read.parquet(*[self.path(f"counts/{n}") for n in names])

    def report(self, df: DataFrame, name: str, single_file: bool = True) -> None:
        sinks.write_report(df, self.path(f"reports/{name}"), single_file)

    def ingest_csv(self, csv_path: str) -> None:
        raw = readers.read_raw_csv(self.spark, csv_path, record=ingest.BAD_RECORD)
        sinks.write_parts(raw, self.path("raw"))

    def build_core(self) -> DataFrame:
        """Typed table. Rows with unreadable values stay in it, with NULL, and so
        do records that end early; both are shown whole in a table of their
        own, which alone holds records with too many fields. Rows without a key
        belong to no series and move to ``core_without_key``."""
        raw = readers.scan_raw(self.spark, self.path("raw"))
        failures = ingest.quarantine(raw, self.schema)
        failures.write.mode("overwrite").option("compression", "zstd").parquet(self.path("cast_failures"))
        self.report(
            ingest.quarantine_sample(self.spark.read.parquet(self.path("cast_failures")), key=self.key), "cast_failures"
        )
        core = ingest.daily_core(raw, self.schema)
        keyless = any_of(F.col(c).isNull() for c in self.key.pair)
        seen = Observation()
        apart = core.filter(keyless).observe(seen, F.count(F.lit(1)).alias("rows"))
        apart.write.mode("overwrite").parquet(self.path("core_without_key"))
        self.count("core_without_key", seen.get["rows"])
        return self.save(core.filter(~keyless), "core")

    def build_universe(self) -> DataFrame:
        core = self.table("core")
        prepared = self.save(universe.prepare_all(core), "prepared")
        base = self.save(universe.ready_base(core, self.key), "base")
        self.save(universe.terminal_events(prepared), "terminal_events")
        return self.save(universe.daily_universe(base, self.universe_params, self.key), "universe")

    def build_labels(self) -> DataFrame:
        dedup = self.save(keys.dedup_first(self.table("core"), self.key), "core_dedup")
        made = labels.forward_labels(dedup, self.label_params, self.key)
        # The next row of a security is of a later day, or its day has two rows.
        same_day = F.count_if(F.col("fwd_date_1") == F.col(self.key.date))
        return self.save(made, "labels", None if self.buckets else {"repeated": same_day})

    def build_panel(self) -> DataFrame:
        panel = targets.model_panel(self.table("universe"), self.table("labels"), self.label_params, self.key)
        return self.save(panel, "model_panel")

    def build_sample(self, megabytes: float = 100.0) -> DataFrame:
        sample = sampling.sample_to_size(self.table("model_panel"), megabytes, key=self.key)
        sample.write.mode("overwrite").parquet(self.path("sample"))
        stored = self.spark.read.parquet(self.path("sample"))
        self.report(stored, "sample", single_file=False)
        self.report(sampling.sample_summary(stored, megabytes, self.key), "sample_summary")
        self.report(sampling.size_estimate(self.table("model_panel"), megabytes, key=self.key), "sample_estimate")
        return stored

    def run(self, csv_path: str, sample_megabytes: float = 100.0) -> DataFrame:
        self.ingest_csv(csv_path)
        self.build_core()
        self.build_universe()
        self.build_labels()
        self.build_panel()
        return self.build_sample(sample_megabytes)

    def write_reports(self) -> None:
        """The diagnostics that go with the stages."""
        core, prepared, base = self.table("core"), self.table("prepared"), self.table("base")
        uni, dedup, lab, panel = (self.table(n) for n in ("universe", "core_dedup", "labels", "model_panel"))
        # Rows without a key are kept beside the core table, so the counts add up to what was read.
        stages = ("core", "core_without_key", "prepared", "base", "terminal_events", "core_dedup", "universe", "labels", "model_panel")
        joined = targets.join_labels(uni, lab, self.label_params, self.key)
        p = self.label_params
        small = {
            "core_profile": profile.profile(core),
            "core_abnormal_examples": profile.abnormal_examples(core, key=self.key),
            "core_duplicates": keys.duplicate_summary(core, key=self.key),
            "core_duplicates_by_year": keys.duplicate_summary(core, ["year"], self.key),
            "core_rows_per_key": keys.rows_per_key_histogram(core, self.key),
            "core_duplicate_difference_rate": keys.duplicate_difference_rate(core, self.key),
            "core_duplicate_rows": keys.duplicate_rows(core, key=self.key),
            "dedup_check": keys.duplicate_summary(dedup, key=self.key),
            "missing_returns": summaries.missing_return_summary(dedup),
            "missing_return_status_with_flag": summaries.missing_return_status(dedup, True),
            "missing_return_status_without_flag": summaries.missing_return_status(dedup, False),
            "missing_return_flags": summaries.missing_return_flags(dedup),
            "stage_rows": self.counts(stages),
            "base_latest": summaries.latest_rows(base, summaries.BASE_PREVIEW, 20, self.key.entity),
            "universe_profile": profile.profile(uni, registry=UNIVERSE_RULES),
            "universe_abnormal_examples": profile.abnormal_examples(uni, registry=UNIVERSE_RULES, key=self.key),
            "universe_daily": summaries.universe_daily_summary(uni),
            "universe_yearly": summaries.universe_yearly_summary(uni, self.key),
            "universe_latest": summaries.latest_rows(uni, summaries.UNIVERSE_PREVIEW, 30, "market_cap_rank"),
            "universe_ohlc_by_price_flag": examples.ohlc_missing_by_price_flag(uni),
            "universe_ohlc_missing": examples.ohlc_missing_sample(uni),
            "universe_spread_reasons": examples.spread_missing_reasons(uni),
            "universe_return_flags": summaries.retained_return_flags(uni),
            "labels": summaries.label_summary(lab, p, self.key),
            "labels_yearly": summaries.label_yearly_summary(lab, p),
            "labels_flag_sets": summaries.label_flag_counts(lab, "target_missing_return_flag_set"),
            "labels_first_flags": summaries.label_flag_counts(lab, "target_first_missing_return_flag"),
            "labels_missing_examples": summaries.missing_label_examples(lab),
            "panel_coverage": summaries.panel_coverage_summary(joined, p),
            "panel_daily": summaries.panel_daily_summary(panel, p),
            "panel_yearly": summaries.panel_yearly_summary(panel, p, self.key),
            "panel_recent_labels": summaries.recent_label_availability(joined, params=p),
            "panel_dropped": summaries.dropped_label_examples(joined, params=p),
            "return_histogram": groups.histogram(core, "dlyret"),
            "return_summary": groups.numeric_summary(core, "dlyret"),
        }
        for name, df in small.items():
            self.report(df, name)
        # As long as the data makes them.
        long = {
            "core_duplicate_digest": keys.duplicate_event_digest(core, self.key),
            "core_duplicate_fields": keys.duplicate_field_differences(core, self.key),
            "missing_return_without_flag_rows": examples.listing(dedup, examples.return_without_flag()),
            "universe_open_only_missing": examples.listing(uni, examples.open_only_missing()),
            "universe_ohlc_inconsistent": examples.ohlc_inconsistent_rows(uni),
            "universe_invalid_quotes": examples.invalid_quote_rows(uni, None),
            "universe_quote_missing": examples.listing(uni, examples.quote_missing()),
            "universe_return_flag_rows": summaries.retained_return_flag_rows(uni),
        }
        for name, df in long.items():
            self.report(df, name, single_file=False)
