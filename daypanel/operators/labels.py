"""Forward-return labels that do not depend on surviving.

Labels come from the broad one-row-per-day table, not from the universe: what
happens to a security after day t counts even when it leaves the universe.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.functions.quality import any_of, flag
from daypanel.schema import DEFAULT_KEY, PanelKey

# ---- fixed values: codes, carried columns and their names in the result ----
NO_ROW = "NO_FUTURE_ROW"
NO_FLAG = "NO_FLAG"
FLAG_CODES = ("NT", "NS", "MP", "RA", "DM", "GP", "DG", "DP", NO_FLAG, NO_ROW)
DELISTING_CODES = ("DM", "DG", "DP")
CONTEXT = (
    "year", "ticker", "tradingstatusflg", "securityactiveflg", "dlydelflg",
    "prc", "dlyprc", "dlyprcflg", "dlyvol", "dlycap",
)
CURRENT = ("dlyret", "dlyretx", "dlyreti", "dlyretmissflg", "dlyretdurflg")
LEADS = {
    "dlyret": "ret_{k}",
    "dlyretmissflg": "miss_flag_raw_{k}",
    "tradingstatusflg": "fwd_tradingstatusflg_{k}",
    "dlydelflg": "fwd_dlydelflg_{k}",
}
# ---- end of fixed values ----


@dataclass(frozen=True)
class LabelParams:
    """``horizon`` counts rows of the security, not calendar days."""

    horizon: int = 5
    penalties: tuple[float, ...] = (0.30, 1.00)
    flag_codes: tuple[str, ...] = FLAG_CODES
    delisting_codes: tuple[str, ...] = DELISTING_CODES

    def __post_init__(self):
        names = [self.stressed(p) for p in self.penalties]
        if len(set(names)) < len(names):
            raise ValueError(f"penalties share a column name: {names}")

    @property
    def steps(self) -> range:
        return range(1, self.horizon + 1)

    @property
    def complete(self) -> str:
        return f"target_{self.horizon}d_raw_complete_only"

    @property
    def zero_after(self) -> str:
        return f"bt_{self.horizon}d_return_zero_after_missing"

    def stressed(self, penalty: float) -> str:
        percent = f"{penalty * 100:.10g}".replace(".", "p")
        return f"bt_{self.horizon}d_return_delist_stress_{percent}"


DEFAULT_LABELS = LabelParams()


def add_leads(source: DataFrame, params: LabelParams = DEFAULT_LABELS, key: PanelKey = DEFAULT_KEY) -> DataFrame:
    """The next rows of the same security: date, return, flags and status.

    One window serves all leads. (entity, date) must be unique, so a security
    has at most one row per calendar day.
    """
    key.check_date(source)
    series = Window.partitionBy(key.entity).orderBy(key.date)
    columns = {key.date: "fwd_date_{k}", **{c: n for c, n in LEADS.items() if c in source.columns}}
    return source.withColumns(
        {name.format(k=k): F.lead(c, k).over(series) for c, name in columns.items() for k in params.steps}
    )


def add_missing_flags(leads: DataFrame, params: LabelParams = DEFAULT_LABELS) -> DataFrame:
    """Why the return k rows ahead is missing; NULL where it is there."""
    return leads.withColumns(
        {
            f"miss_flag_{k}": F.when(F.col(f"fwd_date_{k}").isNull(), NO_ROW).when(
                F.col(f"ret_{k}").isNull(), F.coalesce(f"miss_flag_raw_{k}", F.lit(NO_FLAG))
            )
            for k in params.steps
        }
    )


def add_missing_summary(flagged: DataFrame, params: LabelParams = DEFAULT_LABELS) -> DataFrame:
    flags = [F.col(f"miss_flag_{k}") for k in params.steps]
    position = F.coalesce(*[F.when(f.isNotNull(), k) for k, f in zip(params.steps, flags)])
    valid = sum((flag(F.col(f"ret_{k}").isNotNull()) for k in params.steps), F.lit(0))
    codes = F.array(*[F.lit(code) for code in params.flag_codes])
    return flagged.withColumns(
        {
            "target_first_missing_return_pos": position,
            "target_first_missing_return_flag": F.coalesce(*flags),
            "target_n_valid_forward_returns": valid,
            "target_has_missing_return": flag(any_of(f.isNotNull() for f in flags)),
            "target_has_delisting_missing_flag": flag(any_of(f.isin(*params.delisting_codes) for f in flags)),
            # '' rather than NULL where nothing is missing; codes outside the list do not show.
            "target_missing_return_flag_set": F.array_join(F.array_intersect(codes, F.array(*flags)), "|"),
        }
    )


def add_label_returns(summarised: DataFrame, params: LabelParams = DEFAULT_LABELS) -> DataFrame:
    """Compounded returns under each treatment of a missing return."""
    wealth: list[Column] = [F.lit(1.0)]
    for k in params.steps:
        wealth.append(wealth[-1] * (1 + F.col(f"ret_{k}")) if k > 1 else 1 + F.col(f"ret_{k}"))
    complete = wealth[-1] - 1  # NULL as soon as one return is

    zero_after = F.lit(None).cast("double")
    for k in reversed(params.steps):
        before = wealth[k - 1] - 1 if k > 1 else F.lit(0.0)
        zero_after = F.when(F.col(f"ret_{k}").isNull(), before).otherwise(
            complete if k == params.horizon else zero_after
        )

    position = F.col("target_first_missing_return_pos")
    delisted = F.col("target_first_missing_return_flag").isin(*params.delisting_codes)

    def stressed(penalty: float) -> Column:
        if penalty == 1.0:
            loss = F.lit(-1.0)
        else:
            loss = F.when(position == 1, F.lit(-penalty))
            for k in params.steps[1:]:
                loss = loss.when(position == k, wealth[k - 1] * (1 - penalty) - 1)
        return F.when(delisted, loss).otherwise(F.col(params.zero_after))

    with_base = summarised.withColumns(
        {"target_1d_raw": F.col("ret_1"), params.complete: complete, params.zero_after: zero_after}
    )
    return with_base.withColumns({params.stressed(p): stressed(p) for p in params.penalties})


def label_columns(params: LabelParams = DEFAULT_LABELS) -> list[str]:
    """Label columns that a panel takes over."""
    return [
        "target_1d_raw",
        params.complete,
        params.zero_after,
        *[params.stressed(p) for p in params.penalties],
        "target_has_missing_return",
        "target_first_missing_return_pos",
        "target_first_missing_return_flag",
        "target_missing_return_flag_set",
        "target_has_delisting_missing_flag",
        "target_n_valid_forward_returns",
        *[f"fwd_date_{k}" for k in params.steps],
        *[f"ret_{k}" for k in params.steps],
    ]


def forward_labels(
    core: DataFrame,
    params: LabelParams = DEFAULT_LABELS,
    key: PanelKey = DEFAULT_KEY,
    context: Sequence[str] = CONTEXT,
) -> DataFrame:
    """Labels of every row of a one-row-per-day table, in the output layout.

    Only the columns that labels need go through the window.
    """
    needed = dict.fromkeys([*key.pair, *context, *CURRENT])
    source = core.select(*[c for c in needed if c in core.columns])
    labelled = add_label_returns(add_missing_summary(add_missing_flags(add_leads(source, params, key), params), params), params)
    current = [F.col(c).alias(f"current_{c}") for c in CURRENT if c in source.columns]
    per_step = [f"{name}_{k}" for name in ("miss_flag", "fwd_tradingstatusflg", "fwd_dlydelflg") for k in params.steps]
    return labelled.select(
        *key.pair,
        *[c for c in context if c in source.columns],
        *current,
        *label_columns(params),
        *[c for c in per_step if c in labelled.columns],
    )


def folded_labels(
    core: DataFrame, params: LabelParams = DEFAULT_LABELS, key: PanelKey = DEFAULT_KEY, context: Sequence[str] = ()
) -> DataFrame:
    """The labels of ``forward_labels`` without a column per step, for horizons
    of any length.

    The series is read backwards, so that the next rows of a day are behind it:
    the next missing return, the next row of each code and the number of missing
    returns are running values, at the same work a row for any horizon. Only the
    returns before the first missing one are folded, in their order. So the plan
    is the same at 5 rows and at 63, and so are the results, to the last bit.
    ``fwd_date_<horizon>`` is the day of the last row.
    """
    key.check_date(core)
    h, back = params.horizon, Window.partitionBy(key.entity).orderBy(F.desc(key.date))
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    source = core.select(*dict.fromkeys([*key.pair, *[c for c in context if c in core.columns], "dlyret", "dlyretmissflg"]))
    reason = F.when(F.col("dlyret").isNull(), F.coalesce("dlyretmissflg", F.lit(NO_FLAG)))
    placed = source.withColumns(
        {
            "_nth": F.row_number().over(back),
            "_flag": reason,
            "_next": F.lag("dlyret", 1).over(back),
            "_end": F.lag(key.date, h).over(back),
            "_returns": F.collect_list("dlyret").over(back.rowsBetween(-h, -1)),
        }
    )
    named = list(dict.fromkeys([*params.flag_codes, *params.delisting_codes]))
    seen = placed.withColumns(
        {
            "_gone": F.last(F.when(F.col("_flag").isNotNull(), F.struct("_nth", "_flag")), ignorenulls=True).over(later),
            "_missing": F.count("_flag").over(later),
            **{f"_code_{i}": F.max(F.when(F.col("_flag") == c, F.col("_nth"))).over(later) for i, c in enumerate(named)},
        }
    )
    nth = F.col("_nth")
    seen = seen.withColumn("_missing", F.col("_missing") - F.lag("_missing", h, 0).over(back))
    # A row that is not there is missing, too: the first such step is the number of the row from the end.
    ahead, short = nth - F.col("_gone._nth"), nth <= h
    within = F.coalesce(ahead <= h, F.lit(False))
    seen = seen.withColumn("_at", F.when(within, ahead).when(short, nth))
    position, first = F.col("_at"), F.when(within, F.col("_gone._flag")).when(short, NO_ROW)
    held = {
        c: F.coalesce(nth - F.col(f"_code_{i}") <= h, F.lit(False)) | (short if c == NO_ROW else F.lit(False)) for i, c in enumerate(named)
    }
    # The returns stand from the last to the next one, without the missing ones.
    n, kept = F.coalesce(position - 1, F.lit(h)), F.col("_returns")
    before = F.reverse(F.slice(kept, F.size(kept) - n + 1, n))
    grown = seen.withColumn("_wealth", F.aggregate(before, F.lit(1.0), lambda whole, r: whole * (1 + r)))
    wealth = F.col("_wealth")
    zero_after = F.when(position == 1, 0.0).otherwise(wealth - 1)
    delisted = first.isin(*params.delisting_codes)

    def stressed(penalty: float) -> Column:
        loss = F.lit(-1.0) if penalty == 1.0 else F.when(position == 1, F.lit(-penalty)).otherwise(wealth * (1 - penalty) - 1)
        return F.when(delisted, loss).otherwise(zero_after)

    made = {
        "target_1d_raw": F.col("_next"),
        params.complete: F.when(position.isNull(), wealth - 1),
        params.zero_after: zero_after,
        **{params.stressed(p): stressed(p) for p in params.penalties},
        "target_has_missing_return": flag(position.isNotNull()),
        "target_first_missing_return_pos": position,
        "target_first_missing_return_flag": first,
        "target_missing_return_flag_set": F.concat_ws("|", *[F.when(held[c], c) for c in dict.fromkeys(params.flag_codes)]),
        "target_has_delisting_missing_flag": flag(any_of(held[c] for c in params.delisting_codes)),
        "target_n_valid_forward_returns": (F.least(nth - 1, F.lit(h)) - F.col("_missing")).cast("int"),
        f"fwd_date_{h}": F.col("_end"),
    }
    return grown.select(*key.pair, *[c for c in context if c in core.columns], *[c.alias(n) for n, c in made.items()])
