"""The catalog's queries as plain SQL for an independent engine.

Written from the definitions, over the same derived panel; nothing is shared
with the Spark side but the SELECTs of ``sources.fixture`` and the names and
types of the dictionary. Rules are written out here by hand; profiles and
examples are one SELECT per variable and rule.
"""

from __future__ import annotations

from daypanel.schema import DAILY_STOCK
from daypanel.sources import fixture

KEY = ["permno", "dlycaldt"]
ROW = [*KEY, "source_file", "raw_row_id"]
STEPS = range(1, 6)
SEED = 9527


def nearest(x: str, digits: int = 6) -> str:
    step = f"1e{digits}"
    return f"floor(({x}) * {step} + 0.501e0) / {step}"


def r(x: str, digits: int = 6, name: str | None = None) -> str:
    return f"{nearest(x, digits)} AS {name or x}"


def rs(names, digits: int = 6) -> str:
    return ", ".join(r(n, digits) for n in names)


def cols(names) -> str:
    return ", ".join(names)


def bit(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INTEGER)"


# ---- the rules over one variable ----
OHLC_RULE_NAME = "price_ohlc_consistency"
RULES = {
    "permno": "permno <= 0",
    "permco": "permco <= 0",
    "dlycaldt": "dlycaldt < DATE '1900-01-01' OR dlycaldt > DATE '2100-01-01'",
    "disexdt": "disexdt < DATE '1900-01-01' OR disexdt > DATE '2100-01-01'",
    "dlyprc": "abs(dlyprc) = 0 OR abs(dlyprc) > 100000",
    "prc": "prc <= 0 OR prc > 100000",
    "dlyopen": "dlyopen <= 0 OR dlyopen > 100000",
    "dlyclose": "dlyclose <= 0 OR dlyclose > 100000",
    "dlyhigh": "dlyhigh <= 0 OR dlyhigh > 100000",
    "dlylow": "dlylow <= 0 OR dlylow > 100000",
    "dlybid": "dlybid < 0 OR dlybid > 100000",
    "dlyask": "dlyask < 0 OR dlyask > 100000",
    "dlyvol": "dlyvol < 0",
    "dlynumtrd": "dlynumtrd < 0",
    "dlymmcnt": "dlymmcnt < 0",
    "dlyprcvol": "dlyprcvol < 0",
    "shrout": "shrout <= 0",
    "dlycap": "dlycap <= 0",
    "dlyret": "dlyret < -1 OR dlyret > 20",
    "dlyretx": "dlyretx < -1 OR dlyretx > 20",
    "dlyreti": "dlyreti < -1 OR dlyreti > 20",
    "dlyfacprc": "dlyfacprc <= 0",
    "disdivamt": "disdivamt < 0",
    "disfacpr": "disfacpr < 0",
    "disfacshr": "disfacshr < 0",
    "primaryexch": "length(primaryexch) > 10",
    "ticker": "length(ticker) > 20",
}
UNIVERSE_RULES = RULES | {
    "dollar_volume": "dollar_volume <= 0",
    "dollar_volume_for_universe": "dollar_volume_for_universe <= 0",
    "adv20": "adv20 <= 0",
    "avg_volume_20d": "avg_volume_20d <= 0",
    "market_cap_rank": "market_cap_rank <= 0",
    "adv20_rank": "adv20_rank <= 0",
    "trading_age_obs": "trading_age_obs <= 0",
    "hist_ret_obs_252": "hist_ret_obs_252 < 0",
}

# ---- the panel and its flags ----
PANEL = fixture.for_duckdb(fixture.PANEL_SELECT.format(lineitem="lineitem"))
RAW = fixture.for_duckdb(fixture.RAW_SELECT.format(part="part"))
PANEL_COLUMNS = [
    "permno", "permco", "ticker", "dlycaldt", "year", "source_file", "raw_row_id", "primaryexch", "securitytype",
    "securitysubtype", "sharetype", "shradrflg", "usincflg", "tradingstatusflg", "dlydelflg", "dlyprcflg", "dlyprc",
    "prc", "dlyprc_negative_flag", "dlyopen", "dlyhigh", "dlylow", "dlyclose", "dlybid", "dlyask", "dlyvol", "dlycap",
    "dlyprcvol", "dlyret", "dlyretmissflg", "dlynumtrd", "shrout", "distype", "disseqnbr", "disdivamt", "disfacpr",
    "disfacshr", "disordinaryflg", "disexdt", "dispaymenttype", "disdetailtype", "dlyfacprc", "dlyretx", "dlyreti",
    "dlymmcnt", "exchangetier", "delactiontype", "shareclass", "securityactiveflg",
]

CSV_LINES = """WITH c AS (SELECT p_partkey AS k, replace(p_name, ' ', ', ') AS s_name, p_size,
  p_partkey || ',"' || replace(p_name, ' ', ', ') || '",' || p_size AS line,
  CASE WHEN p_partkey % 11 = 4 THEN 'long' WHEN p_partkey % 7 = 3 THEN 'short' WHEN p_partkey % 5 = 0 THEN 'soon'
       ELSE 'whole' END AS kind FROM part)"""

OHLC_GAP = "dlyopen IS NULL OR dlyhigh IS NULL OR dlylow IS NULL OR dlyclose IS NULL"
OHLC_BAD = f"""NOT ({OHLC_GAP}) AND (dlyhigh < dlylow OR dlyopen > dlyhigh OR dlyopen < dlylow
  OR dlyclose > dlyhigh OR dlyclose < dlylow)"""
STAND_IN = f"({OHLC_GAP}) AND prc > 0 AND tradingstatusflg = 'A' AND dlyprcflg = 'BA'"
QUOTE_OK = "dlybid > 0 AND dlyask > 0 AND dlyask >= dlybid"

FLAGS = {
    "status": {
        "is_active_trading_flag": "tradingstatusflg = 'A'",
        "non_tradable_status_flag": "tradingstatusflg IN ('X', 'S', 'H')",
        "terminal_event_flag": "tradingstatusflg = 'D' OR dlydelflg = 'Y' OR (prc = 0 AND dlyprcflg = 'DA')",
        "daily_delisting_flag": "dlydelflg = 'Y'",
    },
    "price": {
        "invalid_price_flag": "prc IS NULL OR prc <= 0",
        "zero_price_flag": "prc = 0",
        "high_price_flag": "prc > 100000",
        "price_from_bidask_flag": "dlyprcflg = 'BA'",
        "negative_raw_price_flag": "dlyprc_negative_flag",
    },
    "ohlc": {
        "has_ohlc_flag": f"NOT ({OHLC_GAP})",
        "ohlc_missing_flag": OHLC_GAP,
        "ohlc_inconsistent_flag": OHLC_BAD,
        "ohlc_imputed_from_prc_flag": STAND_IN,
    },
    "quote": {
        "bidask_missing_flag": "dlybid IS NULL OR dlyask IS NULL",
        "valid_bidask_flag": QUOTE_OK,
    },
    "size": {
        "invalid_volume_flag": "dlyvol IS NULL OR dlyvol <= 0",
        "invalid_market_cap_flag": "dlycap IS NULL OR dlycap <= 0",
        "price_volume_missing_flag": "dlyprcvol IS NULL",
    },
    "return": {
        "return_missing_flag": "dlyret IS NULL",
        "price_return_missing_flag": "dlyretx IS NULL",
        "income_return_missing_flag": "dlyreti IS NULL",
        "extreme_return_flag": "dlyret < -1 OR dlyret > 20",
    },
    "meta": {
        "security_metadata_missing_flag": "securitytype IS NULL OR sharetype IS NULL OR shrout IS NULL OR shrout <= 0",
        "is_equity_flag": "securitytype = 'EQTY'",
        "is_fund_flag": "securitytype = 'FUND'",
        "is_common_share_flag": "sharetype = 'NS'",
        "is_adr_flag": "shradrflg = 'Y'",
        "is_us_incorporated_flag": "usincflg = 'Y'",
        "num_trades_missing_flag": "dlynumtrd IS NULL",
        "market_maker_count_missing_flag": "dlymmcnt IS NULL",
        "exchange_tier_missing_flag": "exchangetier IS NULL",
    },
    "event": {
        "has_delactiontype_flag": "delactiontype IS NOT NULL",
        "has_shareclass_flag": "shareclass IS NOT NULL",
        "has_distribution_event_flag": "coalesce(CAST(disexdt AS VARCHAR), distype, CAST(disdivamt AS VARCHAR), "
                                       "CAST(disfacpr AS VARCHAR), CAST(disfacshr AS VARCHAR)) IS NOT NULL",
        "has_distribution_amount_flag": "disdivamt IS NOT NULL",
        "has_ordinary_distribution_flag": "disordinaryflg = 'Y'",
        "negative_disfacpr_flag": "disfacpr < 0",
        "negative_disfacshr_flag": "disfacshr < 0",
        "negative_disdivamt_flag": "disdivamt < 0",
        "price_adjustment_event_flag": "dlyfacprc <> 1",
    },
}
ALL_FLAGS = {name: cond for group in FLAGS.values() for name, cond in group.items()}
CLEAN = {
    f"dly{x}_clean": f"CASE WHEN dly{x} IS NOT NULL THEN dly{x} WHEN {STAND_IN} THEN prc END"
    for x in ("open", "high", "low", "close")
}
DERIVED = {
    "log_prc": "CASE WHEN prc > 0 THEN ln(prc) END",
    "log_dlycap": "CASE WHEN dlycap > 0 THEN ln(dlycap) END",
    "dollar_volume": "CASE WHEN prc > 0 AND dlyvol > 0 THEN prc * dlyvol END",
    "bid_ask_spread": f"CASE WHEN {QUOTE_OK} THEN (dlyask - dlybid) / ((dlyask + dlybid) / 2e0) END",
    "log_num_trades": "CASE WHEN dlynumtrd >= 0 THEN ln(1 + dlynumtrd) END",
    "log_market_maker_count": "CASE WHEN dlymmcnt >= 0 THEN ln(1 + dlymmcnt) END",
    "intraday_ret_strict": "CASE WHEN dlyopen > 0 AND dlyclose > 0 THEN dlyclose / dlyopen - 1 END",
    "intraday_range_strict": "CASE WHEN dlyhigh > 0 AND dlylow > 0 AND dlyhigh >= dlylow THEN dlyhigh / dlylow - 1 END",
    "intraday_ret_clean": "CASE WHEN dlyopen_clean > 0 AND dlyclose_clean > 0 THEN dlyclose_clean / dlyopen_clean - 1 END",
    "intraday_range_clean": "CASE WHEN dlyhigh_clean > 0 AND dlylow_clean > 0 AND dlyhigh_clean >= dlylow_clean "
                            "THEN dlyhigh_clean / dlylow_clean - 1 END",
}


def named(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in expressions.items())


def first_per_key(source: str, where: str = "true") -> str:
    return f"""SELECT * EXCLUDE (nth) FROM (
      SELECT *, count(*) OVER (PARTITION BY permno, dlycaldt) AS n_rows_same_stock_day,
        row_number() OVER (PARTITION BY permno, dlycaldt ORDER BY source_file, raw_row_id) AS nth
      FROM {source} WHERE {where}) WHERE nth = 1"""


READY = """tradingstatusflg = 'A' AND terminal_event_flag = 0 AND prc > 0 AND dlyvol > 0 AND dlycap > 0
  AND dlyret IS NOT NULL AND security_metadata_missing_flag = 0"""

HISTORY = """SELECT *, avg(dollar_volume_for_universe) OVER recent AS adv20, avg(dlyvol) OVER recent AS avg_volume_20d,
    count(dlyret) OVER (series ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS hist_ret_obs_252,
    count(*) OVER (series ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trading_age_obs
  FROM (SELECT *, prc * dlyvol AS dollar_volume_for_universe FROM candidates)
  WINDOW series AS (PARTITION BY permno ORDER BY dlycaldt),
         recent AS (PARTITION BY permno ORDER BY dlycaldt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
RANKED = """SELECT *,
    row_number() OVER (PARTITION BY dlycaldt ORDER BY dlycap DESC NULLS LAST, permno) AS market_cap_rank,
    row_number() OVER (PARTITION BY dlycaldt ORDER BY round(adv20, 4) DESC NULLS LAST, permno) AS adv20_rank,
    count(*) OVER (PARTITION BY dlycaldt) AS n_common_equity_candidates
  FROM history"""
def universe(by_cap: int, by_volume: int) -> str:
    return f"""SELECT *, 1 AS in_universe_flag, 'N,Q,A' AS universe_exchange_set, 500e0 AS universe_min_price,
    40000e0 AS universe_min_adv20, 126 AS universe_min_history_obs,
    {by_cap} AS universe_max_market_cap_rank, {by_volume} AS universe_max_adv20_rank
  FROM ranked
  WHERE prc >= 500 AND adv20 >= 40000 AND hist_ret_obs_252 >= 126 AND market_cap_rank <= {by_cap}
    AND adv20_rank <= {by_volume}"""


# ---- labels ----
def leads() -> str:
    names = {
        "dlycaldt": "fwd_date_{}", "dlyret": "ret_{}", "dlyretmissflg": "miss_flag_raw_{}",
        "tradingstatusflg": "fwd_tradingstatusflg_{}", "dlydelflg": "fwd_dlydelflg_{}",
    }
    out = [f"lead({c}, {k}) OVER series AS {n.format(k)}" for c, n in names.items() for k in STEPS]
    return f"SELECT *, {cols(out)} FROM core_dedup WINDOW series AS (PARTITION BY permno ORDER BY dlycaldt)"


def reasons() -> str:
    out = [
        f"CASE WHEN fwd_date_{k} IS NULL THEN 'NO_FUTURE_ROW' "
        f"WHEN ret_{k} IS NULL THEN coalesce(miss_flag_raw_{k}, 'NO_FLAG') END AS miss_flag_{k}"
        for k in STEPS
    ]
    return f"SELECT *, {cols(out)} FROM leads"


def first_missing() -> str:
    """Uses lists: the position of the first reason, and codes that occur."""
    codes = "['NT', 'NS', 'MP', 'RA', 'DM', 'GP', 'DG', 'DP', 'NO_FLAG', 'NO_FUTURE_ROW']"
    flags = "[" + ", ".join(f"miss_flag_{k}" for k in STEPS) + "]"
    present = " + ".join(f"(ret_{k} IS NOT NULL)::INTEGER" for k in STEPS)
    position = "CASE " + " ".join(f"WHEN flags[{k}] IS NOT NULL THEN {k}" for k in STEPS) + " END"
    return f"""SELECT *,
      flags[target_first_missing_return_pos] AS target_first_missing_return_flag,
      (target_first_missing_return_pos IS NOT NULL)::INTEGER AS target_has_missing_return,
      coalesce(list_has_any(flags, ['DM', 'DG', 'DP']), false)::INTEGER AS target_has_delisting_missing_flag,
      coalesce(array_to_string(list_filter({codes}, lambda c: list_contains(flags, c)), '|'), '')
        AS target_missing_return_flag_set
    FROM (SELECT *, {position} AS target_first_missing_return_pos, {present} AS target_n_valid_forward_returns
          FROM (SELECT *, {flags} AS flags FROM reasons))"""


def wealth(n: int) -> str:
    return " * ".join(f"(1 + ret_{k})" for k in range(1, n + 1))


def label_returns() -> str:
    first = "target_first_missing_return_pos"
    kept = " ".join(f"WHEN {first} = {k} THEN {wealth(k - 1)} - 1" for k in range(2, 6))
    stressed = " ".join(f"WHEN {first} = {k} THEN {wealth(k - 1)} * 0.7e0 - 1" for k in range(2, 6))
    zero = f"CASE WHEN {first} IS NULL THEN {wealth(5)} - 1 WHEN {first} = 1 THEN 0e0 {kept} END"
    hit = "coalesce(target_first_missing_return_flag IN ('DM', 'DG', 'DP'), false)"
    return f"""SELECT *, ret_1 AS target_1d_raw,
      CASE WHEN {first} IS NULL THEN {wealth(5)} - 1 END AS target_5d_raw_complete_only,
      {zero} AS bt_5d_return_zero_after_missing,
      CASE WHEN {hit} AND {first} = 1 THEN -0.3e0 {stressed.replace('WHEN ', f'WHEN {hit} AND ')} ELSE {zero} END
        AS bt_5d_return_delist_stress_30,
      CASE WHEN {hit} THEN -1e0 ELSE {zero} END AS bt_5d_return_delist_stress_100
    FROM firsts"""


JOINED = """SELECT u.*, l.target_1d_raw, l.target_5d_raw_complete_only, l.target_first_missing_return_flag,
    l.target_missing_return_flag_set, l.target_n_valid_forward_returns, l.fwd_date_5
  FROM universe u LEFT JOIN labels l ON u.permno = l.permno AND u.dlycaldt = l.dlycaldt"""


def normalised(source: str) -> str:
    return f"""SELECT *, CASE WHEN coalesce(target_5d_winsor_sd, 0) = 0 THEN 0e0
        ELSE (target_5d_winsor - target_5d_winsor_mean) / target_5d_winsor_sd END AS target_5d_cs_zscore
      FROM (SELECT *, avg(target_5d_winsor) OVER day AS target_5d_winsor_mean,
              stddev_samp(target_5d_winsor) OVER day AS target_5d_winsor_sd, count(*) OVER day AS n_cross_section
            FROM ({winsorised(source)}) WINDOW day AS (PARTITION BY dlycaldt))"""


def winsorised(source: str) -> str:
    t = "target_5d_raw_complete_only"
    return f"""SELECT *, CASE WHEN {t} < target_5d_p01 THEN target_5d_p01 WHEN {t} > target_5d_p99 THEN target_5d_p99
        ELSE {t} END AS target_5d_winsor
      FROM {source} LEFT JOIN (SELECT dlycaldt, quantile_cont({t}, 0.01) AS target_5d_p01,
          quantile_cont({t}, 0.99) AS target_5d_p99
        FROM {source} WHERE {t} IS NOT NULL GROUP BY dlycaldt) USING (dlycaldt)"""


STAGES = {
    "panel": PANEL,
    "raw": RAW,
    "prepared": f"""SELECT *, {named(DERIVED)} FROM (
        SELECT *, {named({n: bit(c) for n, c in ALL_FLAGS.items()})}, {named(CLEAN)} FROM panel)""",
    "base": first_per_key("prepared", READY),
    "candidates": """SELECT * FROM base WHERE securitytype = 'EQTY' AND securitysubtype = 'COM' AND sharetype = 'NS'
        AND usincflg = 'Y' AND shradrflg = 'N' AND primaryexch IN ('N', 'Q', 'A')""",
    "history": HISTORY,
    "ranked": RANKED,
    "universe": universe(3000, 4000),
    "tight_universe": universe(6, 7),
    "core_dedup": f"SELECT * EXCLUDE (n_rows_same_stock_day) FROM ({first_per_key('panel')})",
    "leads": leads(),
    "reasons": reasons(),
    "firsts": first_missing(),
    "labels": label_returns(),
    "joined": JOINED,
    "complete": "SELECT * FROM joined WHERE target_5d_raw_complete_only IS NOT NULL",
    "model": normalised("complete"),
}
NEEDS = {
    "prepared": ["panel"], "base": ["prepared"], "candidates": ["base"], "history": ["candidates"],
    "ranked": ["history"], "universe": ["ranked"], "tight_universe": ["ranked"],
    "core_dedup": ["panel"], "leads": ["core_dedup"],
    "reasons": ["leads"], "firsts": ["reasons"], "labels": ["firsts"], "joined": ["universe", "labels"],
    "complete": ["joined"], "model": ["complete"],
}


def over(stage: str | list[str], body: str) -> str:
    """``body`` after the stages it reads, each spelled out once."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in wanted:
            wanted.append(name)

    for s in [stage] if isinstance(stage, str) else stage:
        visit(s)
    ctes = ",\n".join(f"{s} AS MATERIALIZED ({STAGES[s]})" for s in wanted)
    return f"WITH {ctes}\n{body}"


# ---- reports ----
def share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1e0 ELSE 0e0 END)"


def tally(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


def duplicates(source: str, by: str = "", pair: str = "permno, dlycaldt") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead}CAST(sum(n) AS BIGINT) AS n_total_rows, count(*) AS n_unique_stock_days,
        {tally('n > 1')} AS n_duplicate_stock_days,
        CAST(sum(n - 1) AS BIGINT) AS n_extra_duplicate_rows, max(n) AS max_rows_per_stock_day
      FROM (SELECT {lead}{pair}, count(*) AS n FROM {source} GROUP BY {lead}{pair}) {group}"""


DUP_FIELDS = ["dlyprc", "prc", "dlyret", "dlyretx", "dlyreti", "dlyvol", "dlycap", "dlyopen", "dlyhigh", "dlylow",
              "dlyclose", "dlybid", "dlyask", "distype", "disseqnbr"]


def field_differences(group: str) -> str:
    counts = [f"count(DISTINCT {f}) + max(({f} IS NULL)::BIGINT) AS n_distinct_{f}" for f in DUP_FIELDS]
    return f"SELECT {group}, count(*) AS n_rows, {cols(counts)} FROM panel GROUP BY {group} HAVING count(*) > 1"


def event_digest() -> str:
    sets = [
        f"array_to_string(list_sort(list_distinct(list(coalesce(CAST({f} AS VARCHAR), '__NULL__')))), ',') AS {f}_set"
        for f in ("distype", "disseqnbr", "disordinaryflg", "dispaymenttype", "disdetailtype")
    ]
    ends = [r(f"{fn}({a})", 6, f"{fn}_{a}") for a in ("disdivamt", "disfacpr", "disfacshr") for fn in ("min", "max")]
    return f"""SELECT permno, dlycaldt, ticker, year, count(*) AS n_rows, min(raw_row_id) AS min_raw_row_id,
        max(raw_row_id) AS max_raw_row_id, {cols(sets)}, count(distype) AS n_distribution_rows,
        count(disdivamt) AS n_disdivamt_rows, {cols(ends)}
      FROM panel GROUP BY permno, dlycaldt, ticker, year HAVING count(*) > 1"""


def by_group(source: str, condition: str, name: str) -> str:
    g = "year, primaryexch, securitytype, sharetype, tradingstatusflg"
    order = ", ".join(f"{c} NULLS LAST" for c in g.split(", "))
    return f"""SELECT {g}, count(*) AS n_rows, {tally(condition)} AS n_{name}, {r(share(condition), 6, f'{name}_rate')}
      FROM {source} GROUP BY {g} HAVING count(*) FILTER (WHERE {condition}) > 0
      ORDER BY n_{name} DESC, {order} LIMIT 100"""


REGULAR = "(SELECT * FROM panel WHERE tradingstatusflg = 'A' AND securityactiveflg = 'Y' AND dlydelflg = 'N')"


def counted(source: str, value: str, where: str = "true", name: str = "value", n: str = "n_rows", top: str = "") -> str:
    return f"""SELECT {value} AS {name}, count(*) AS {n} FROM {source} WHERE {where} GROUP BY 1
      ORDER BY {n} DESC, 1 NULLS LAST {top}"""


def summary(source: str, v: str, digits: int = 6) -> str:
    q = [r(f"quantile_cont({v}, {p / 100})", digits, f"p{p:02d}") for p in (1, 5, 50, 95, 99)]
    return f"""SELECT count(*) AS n_total, {tally(f'{v} IS NULL')} AS n_missing, {r(f'min({v})', digits, 'min_value')},
      {cols(q)}, {r(f'max({v})', digits, 'max_value')} FROM {source}"""


def histogram(source: str, v: str, bins: int) -> str:
    left, right = f"lo + b * (hi - lo) / {bins}", f"lo + (b + 1) * (hi - lo) / {bins}"
    return f"""SELECT CAST(b AS INTEGER) AS bin_id, count(*) AS count, {r(left, 4, 'bin_left')}, {r(right, 4, 'bin_right')},
        {r(f'(({left}) + ({right})) / 2', 4, 'bin_mid')}
      FROM (SELECT lo, hi, least(floor(({v} - lo) / (hi - lo) * {bins}), {bins - 1}) AS b
            FROM {source}, (SELECT min({v}) AS lo, max({v}) AS hi FROM {source}) WHERE {v} IS NOT NULL AND hi > lo)
      GROUP BY b, lo, hi"""


def profile_line(source, name, kind, rule, missing=True):
    bad = tally(f"{name} IS NOT NULL AND ({rule})") if rule and missing else tally(rule) if rule else "CAST(0 AS BIGINT)"
    gone = tally(f"{name} IS NULL") if missing else "CAST(NULL AS BIGINT)"
    rate = r(share(f"{name} IS NULL"), 8, "missing_pct") if missing else "CAST(NULL AS DOUBLE) AS missing_pct"
    kind_column = f"'{kind}' AS type, " if kind else ""
    return f"""SELECT '{name}' AS variable, {kind_column}count(*) AS n_total, {gone} AS missing_count, {rate},
      {bad} AS abnormal_count, {nearest(f'{bad} / count(*)::DOUBLE', 8)} AS abnormal_pct FROM {source}"""


def profile_core() -> str:
    kinds = {n: t for n, t in DAILY_STOCK if n in PANEL_COLUMNS} | {"dlyprc_negative_flag": "bool", "prc": "decimal"}
    lines = [
        profile_line("panel", n, t, RULES.get(n)) for n, t in kinds.items()
    ]
    return "\nUNION ALL\n".join(lines)


def profile_universe() -> str:
    added = ["n_rows_same_stock_day", "dollar_volume_for_universe", "adv20", "avg_volume_20d", "hist_ret_obs_252",
             "trading_age_obs", "market_cap_rank", "adv20_rank", "n_common_equity_candidates", "in_universe_flag",
             "universe_exchange_set", "universe_min_price", "universe_min_adv20", "universe_min_history_obs",
             "universe_max_market_cap_rank", "universe_max_adv20_rank"]
    names = [*PANEL_COLUMNS, *ALL_FLAGS, *CLEAN, *DERIVED, *added]
    lines = [
        profile_line("universe", n, None, UNIVERSE_RULES.get(n)) for n in names
    ]
    lines.append(profile_line("universe", OHLC_RULE_NAME, None, OHLC_BAD, missing=False))
    return "\nUNION ALL\n".join(lines)


DOUBLES = {"dlyprc", "prc", "dlyopen", "dlyhigh", "dlylow", "dlyclose", "dlybid", "dlyask", "dlyvol", "dlycap",
           "dlyprcvol", "dlyret", "disdivamt", "disfacpr", "disfacshr", "dlyfacprc", "dlyretx", "dlyreti",
           "dollar_volume", "dollar_volume_for_universe", "adv20", "avg_volume_20d"}


def as_text(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(38, 6)) AS VARCHAR)" if c in DOUBLES else f"CAST({c} AS VARCHAR)"


def evidence(source: str = "panel", rules: dict[str, str] = RULES) -> str:
    parts = []
    for name, rule in {**rules, OHLC_RULE_NAME: OHLC_BAD}.items():
        value = as_text(name)
        if name == OHLC_RULE_NAME:
            value = " || ', ' || ".join(f"'{n}=' || {as_text('dly' + n)}" for n in ("open", "high", "low", "close"))
        parts.append(f"""SELECT '{name}' AS variable, permno, dlycaldt, ticker, {value} AS value FROM
          (SELECT * FROM {source} WHERE {rule} ORDER BY dlycaldt, permno, source_file, raw_row_id LIMIT 20)""")
    return "\nUNION ALL\n".join(parts)


DRAW = f"md5(concat_ws('|', permno, dlycaldt, source_file, raw_row_id, '{SEED}'))"


def drawn(source: str, condition: str, n: int, shown: str) -> str:
    return f"SELECT {cols(ROW)}, {r(shown)} FROM (SELECT * FROM {source} WHERE {condition} ORDER BY {DRAW} LIMIT {n})"


SAMPLE_COLUMNS = [*ROW, "ticker", "dlyprcflg", "dlyvol", "shrout"]
LINE_BYTES = " + ".join(
    f"coalesce(strlen(CAST({'CAST(dlyvol AS DECIMAL(38, 10))' if c == 'dlyvol' else c} AS VARCHAR)), 0)"
    for c in SAMPLE_COLUMNS
) + f" + {len(SAMPLE_COLUMNS)}"
SAMPLE_SIZE = f"""(SELECT CAST(floor(524288e0 / avg(bytes)) AS BIGINT)
   FROM (SELECT {LINE_BYTES} AS bytes FROM panel ORDER BY {DRAW} LIMIT 10000))"""
SAMPLED = f"SELECT {cols(SAMPLE_COLUMNS)} FROM panel ORDER BY {DRAW} LIMIT {SAMPLE_SIZE}"


OWN_RULE = "dlybid IS NOT NULL AND (dlyclose > 0.94e0 * dlyhigh OR dlyvol >= 48)"
CODES = ["NT", "NS", "MP", "RA", "DM", "GP", "DG", "DP", "NO_FLAG", "NO_FUTURE_ROW"]


def long_labels(h: int) -> str:
    """Labels over the next ``h`` rows from one list of them a row."""
    zero = "CASE WHEN pos = 1 THEN 0e0 ELSE wealth - 1 END"
    delisted = "flags[pos] IN ('DM', 'DG', 'DP')"
    codes = ", ".join(f"'{c}'" for c in CODES)
    return f"""SELECT permno, dlycaldt, {r('later[1].r', 6, 'target_1d_raw')},
        {r('CASE WHEN pos IS NULL THEN wealth - 1 END', 6, f'target_{h}d_raw_complete_only')}, {r(zero, 6, f'bt_{h}d_return_zero_after_missing')},
        {r(f'CASE WHEN {delisted} THEN CASE WHEN pos = 1 THEN -0.3e0 ELSE wealth * 0.7e0 - 1 END ELSE {zero} END', 6, f'bt_{h}d_return_delist_stress_30')},
        {r(f'CASE WHEN {delisted} THEN -1e0 ELSE {zero} END', 6, f'bt_{h}d_return_delist_stress_100')},
        (pos IS NOT NULL)::INTEGER AS target_has_missing_return, pos::INTEGER AS target_first_missing_return_pos, flags[pos] AS target_first_missing_return_flag,
        array_to_string(list_filter([{codes}], lambda c: list_contains(flags, c)), '|') AS target_missing_return_flag_set,
        list_has_any(flags, ['DM', 'DG', 'DP'])::INTEGER AS target_has_delisting_missing_flag,
        len(list_filter(flags, lambda f: f IS NULL))::INTEGER AS target_n_valid_forward_returns, CASE WHEN len(later) = {h} THEN later[{h}].day END AS fwd_date_{h}
      FROM (SELECT *, list_reduce(list_prepend(1e0, list_transform(later[1:coalesce(pos - 1, {h})], lambda x: 1 + x.r)), lambda a, b: a * b) AS wealth
        FROM (SELECT *, nullif(list_position(list_transform(flags, lambda f: f IS NOT NULL), true), 0) AS pos
          FROM (SELECT *, list_concat(list_transform(later, lambda x: CASE WHEN x.r IS NULL THEN coalesce(x.f, 'NO_FLAG') END),
                                      list_transform(range({h} - len(later)), lambda i: 'NO_FUTURE_ROW')) AS flags
            FROM (SELECT permno, dlycaldt, coalesce(list({{'day': dlycaldt, 'r': dlyret, 'f': dlyretmissflg}})
                    OVER (PARTITION BY permno ORDER BY dlycaldt ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING), []) AS later FROM core_dedup))))"""


def matching(condition: str) -> str:
    met = tally(condition)
    return f"""SELECT {met} AS n_matching, count(*) AS n_total, least({met}, 20) AS n_shown, {met} > 20 AS drawn,
      '{condition}' AS condition FROM panel"""


def label_measures() -> str:
    gone = "target_5d_raw_complete_only IS NULL"
    return f"""{tally(gone)} AS n_missing_target_5d_complete, {r(share(gone), 6, 'missing_target_5d_complete_rate')},
      CAST(sum(target_has_missing_return) AS BIGINT) AS n_has_missing_forward_return,
      {r('avg(target_has_missing_return)', 6, 'has_missing_forward_return_rate')},
      CAST(sum(target_has_delisting_missing_flag) AS BIGINT) AS n_has_delisting_missing_flag,
      {r('avg(target_has_delisting_missing_flag)', 6, 'has_delisting_missing_flag_rate')}"""


def label_flag_counts(column: str) -> str:
    return over("labels", counted("labels", f"coalesce({column}, '__NO_MISSING__')", name=column))


def missing_status(flagged: str) -> str:
    where = f"dlyret IS NULL AND dlyretmissflg IS {flagged}"
    return over("core_dedup", counted("core_dedup", "tradingstatusflg", where, "tradingstatusflg"))


def trailing(n: int) -> str:
    terms = [f"lag(1 + dlyret, {k}) OVER series" for k in range(n - 1, 0, -1)] + ["(1 + dlyret)"]
    return f"{' * '.join(terms)} - 1"


TRAILING = """FROM (SELECT * FROM core_dedup WHERE dlyret IS NOT NULL)
  WINDOW series AS (PARTITION BY permno ORDER BY dlycaldt),
         recent AS (PARTITION BY permno ORDER BY dlycaldt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"""

CAST_AS = {"s_int": "BIGINT", "s_dec": "DOUBLE", "s_date": "DATE"}
CLEANED = {c: f"nullif(trim({c}), '')" for c in [*CAST_AS, "s_char"]}
FAILED = {c: f"({CLEANED[c]} IS NOT NULL AND try_cast({CLEANED[c]} AS {t}) IS NULL)" for c, t in CAST_AS.items()}
FAILED_LIST = "concat_ws(';', " + ", ".join(f"CASE WHEN {f} THEN '{c}' END" for c, f in FAILED.items()) + ")"
FAILED_FLAGS = ", ".join(f"{f} AS {c}_cast_failed" for c, f in FAILED.items())
ANY_FAILED = " OR ".join(FAILED.values())

QUOTE_GAP = "dlybid IS NULL OR dlyask IS NULL"
USER_DAY = "(SELECT *, CAST(ts AS DATE) AS day FROM events)"
USABLE = f"coalesce(NOT ({OHLC_GAP}) AND NOT ({OHLC_BAD}), false)"
LABEL_LAYOUT_TEXT = [
    "ticker", "tradingstatusflg", "securityactiveflg", "dlydelflg", "dlyprcflg",
    "target_first_missing_return_flag", "target_missing_return_flag_set",
    *[f"{n}_{k}" for n in ("miss_flag", "fwd_tradingstatusflg", "fwd_dlydelflg") for k in STEPS],
]
MODEL_DOUBLES = ["target_5d_raw_complete_only", "target_5d_p01", "target_5d_p99", "target_5d_winsor",
                 "target_5d_winsor_mean", "target_5d_winsor_sd", "target_5d_cs_zscore"]
Z = "zscore"
T = "target_5d_raw_complete_only"

ORACLE: dict[str, str] = {
    "raw_csv_scan": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
                    "CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer",
    "csv_quarantine": f"""{CSV_LINES} SELECT CAST(k AS VARCHAR) AS raw_key, s_name, CAST(p_size AS VARCHAR) AS s_size,
        CASE kind WHEN 'long' THEN '2019-01-02' WHEN 'soon' THEN 'soon' END AS s_date,
        CASE kind WHEN 'long' THEN line || ',2019-01-02,surplus' WHEN 'short' THEN line END AS bad_record,
        false AS raw_key_cast_failed, false AS s_size_cast_failed, kind = 'soon' AS s_date_cast_failed,
        CASE kind WHEN 'soon' THEN 's_date' ELSE '' END AS failed_columns,
        CASE kind WHEN 'long' THEN 'too_many_fields' WHEN 'short' THEN 'too_few_fields' END AS record_fault
        FROM c WHERE kind <> 'whole'""",
    "csv_core": f"""{CSV_LINES} SELECT k AS raw_key, s_name, CAST(p_size AS BIGINT) AS s_size,
        CASE kind WHEN 'whole' THEN DATE '2019-01-02' END AS s_date FROM c WHERE kind <> 'long'""",
    "replaced_year": over("panel", f"""SELECT year, count(*) AS n_rows,
        {r('sum(CASE WHEN year = 1995 THEN 2 * prc ELSE prc END)', 2, 'sum_prc')} FROM panel GROUP BY year"""),
    "series_join": over(["base", "labels"], f"""SELECT permno, dlycaldt,
        {r('avg(prc * dlyvol) OVER (PARTITION BY permno ORDER BY dlycaldt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 4, 'adv20')},
        count(dlyret) OVER (PARTITION BY permno ORDER BY dlycaldt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS hist_ret_obs_252,
        count(*) OVER (PARTITION BY permno ORDER BY dlycaldt) AS trading_age_obs,
        {r('l.target_1d_raw', 4, 'target_1d_raw')}, {r(f'l.{T}', 4, T)}
        FROM (SELECT permno, dlycaldt, prc, dlyvol, dlyret FROM base) b LEFT JOIN labels l USING (permno, dlycaldt)""".replace("dlyret)", "b.dlyret)").replace("prc * dlyvol", "b.prc * b.dlyvol")),
    "counts_while_writing": over(["base", "labels"], """SELECT 'base' AS table_name, count(*) AS n, 0::BIGINT AS n_repeated FROM base
        UNION ALL SELECT 'labels', count(*), 0::BIGINT FROM labels"""),
    "quantiles_from_days": over("panel", "SELECT year, " + cols(
        r(f"quantile_cont(prc, {p / 100})", 4, f"p{p:02d}") for p in (5, 50, 95)) + " FROM panel GROUP BY year"),
    "distinct_names": over("panel", """SELECT year, primaryexch, count(DISTINCT permno) AS n_names FROM panel GROUP BY ALL
        UNION ALL SELECT year, 'all', count(DISTINCT permno) FROM panel GROUP BY year"""),
    "abnormal_by_group_own": over("panel", by_group("panel", OWN_RULE, "abnormal").removesuffix("LIMIT 100")),
    "abnormal_by_group_universe": over("universe", " UNION ALL ".join(
        f"SELECT *, '{v}' AS variable FROM ({by_group('universe', c, 'abnormal').removesuffix('LIMIT 100')})"
        for v, c in (("disfacpr", "disfacpr < 0"), ("market_cap_rank", "market_cap_rank <= 3 AND adv20_rank > 3")))),
    "abnormal_examples_universe": over("universe", evidence("universe", UNIVERSE_RULES)),
    "sample_abnormal_own": over("panel", drawn("panel", OWN_RULE, 20, "dlybid").replace(" FROM (SELECT", ", dlyvol FROM (SELECT", 1)),
    "sample_matches": over("panel", " UNION ALL ".join(
        map(matching, ("disdivamt IS NULL", "disdivamt < 0", "dlyvol > 49 AND dlyret IS NULL AND dlyfacprc < 1")))),
    "duplicate_rows_wide": over("panel", f"""SELECT {cols(r(c, 4) if c in DOUBLES else c for c in PANEL_COLUMNS)}
        FROM (SELECT *, count(*) OVER (PARTITION BY permno, dlycaldt) AS n FROM panel) WHERE n > 1
        ORDER BY dlycaldt, permno, raw_row_id LIMIT 500"""),
    "label_21d": over("core_dedup", long_labels(21)),
    "label_63d": over("core_dedup", long_labels(63)),
    "rolling_return_63d": over("core_dedup", f"SELECT permno, dlycaldt, {r(trailing(63), 6, 'ret_63d')} {TRAILING}"),
    "raw_parts": "SELECT p_partkey, p_name, true AS row_below_300, true AS parts_fit FROM part",
    "raw_scan_with_provenance": "SELECT 'part.parquet' AS source_file, row_number() OVER () - 1 AS raw_row_id, p_partkey, "
                                "p_name FROM part",
    "partitioned_scan": over("panel", f"SELECT year, count(*) AS n_rows, CAST(sum(raw_row_id) AS BIGINT) AS sum_row_id, "
                                      f"{r('sum(prc)', 2, 'sum_prc')}, count(dlyret) AS n_ret FROM panel GROUP BY year"),
    "report_csv_roundtrip": "SELECT o_orderpriority AS value, CAST(count(*) AS VARCHAR) AS n_rows FROM orders GROUP BY 1",
    "typed_cast": over("raw", "SELECT raw_row_id, " + ", ".join(
        r(f"try_cast({CLEANED[c]} AS {t})", 6, c) if t == "DOUBLE" else f"try_cast({CLEANED[c]} AS {t}) AS {c}"
        for c, t in CAST_AS.items()) + f", {CLEANED['s_char']} AS s_char FROM raw"),
    "cast_failure_flags": over("raw", f"SELECT raw_row_id, {FAILED_FLAGS} FROM raw"),
    "cast_failed_columns": over("raw", f"SELECT raw_row_id, {FAILED_LIST} AS failed_columns FROM raw"),
    "cast_quarantine": over("raw", f"SELECT raw_row_id, s_int, s_dec, s_date, s_char, {FAILED_FLAGS}, {FAILED_LIST} AS "
                                   f"failed_columns FROM raw WHERE {ANY_FAILED}"),
    "cast_quarantine_sample": over("raw", f"SELECT raw_row_id, {FAILED_LIST} AS failed_columns FROM raw "
                                          f"WHERE {ANY_FAILED} ORDER BY raw_row_id LIMIT 200"),
    "price_normalise": over("panel", f"SELECT {cols(ROW)}, {r('dlyprc', 4)}, CAST(year(dlycaldt) AS INTEGER) AS year, "
                                     f"CASE WHEN dlyprc IS NOT NULL THEN dlyprc < 0 END AS dlyprc_negative_flag, "
                                     f"{r('abs(dlyprc)', 4, 'prc')} FROM panel"),
    "spread_missing_reasons": over("prepared", f"""SELECT CASE WHEN {QUOTE_GAP} THEN 'bid_or_ask_missing'
        WHEN dlybid <= 0 THEN 'bid_nonpositive' WHEN dlyask <= 0 THEN 'ask_nonpositive'
        WHEN dlyask < dlybid THEN 'ask_less_than_bid' ELSE 'other' END AS reason, count(*) AS n_rows
        FROM prepared WHERE bid_ask_spread IS NULL GROUP BY 1"""),
    **{
        f"flags_{g}": over("panel", f"SELECT {cols(ROW)}, {named({n: bit(c) for n, c in fs.items()})} FROM panel")
        for g, fs in FLAGS.items()
    },
    "ohlc_clean": over("prepared", f"SELECT {cols(ROW)}, {rs(CLEAN)} FROM prepared"),
    "log_features": over("prepared", f"SELECT {cols(ROW)}, "
                                     f"{rs(['log_prc', 'log_dlycap', 'log_num_trades', 'log_market_maker_count'])} FROM prepared"),
    "dollar_volume": over("prepared", f"SELECT {cols(ROW)}, {r('dollar_volume', 4)} FROM prepared"),
    "bid_ask_spread": over("prepared", f"SELECT {cols(ROW)}, {r('bid_ask_spread')} FROM prepared"),
    "intraday_features": over("prepared", f"SELECT {cols(ROW)}, " + rs(
        ["intraday_ret_strict", "intraday_range_strict", "intraday_ret_clean", "intraday_range_clean"]) + " FROM prepared"),
    "ready_base": over("base", f"SELECT {cols(ROW)}, {rs(['prc', 'dollar_volume', 'bid_ask_spread'])}, "
                               f"n_rows_same_stock_day FROM base"),
    "terminal_events": over("prepared", f"SELECT {cols(ROW)}, dlyprcflg, {r('prc')}, terminal_event_flag FROM prepared "
                                        f"WHERE terminal_event_flag = 1"),
    "common_equity_candidates": over("candidates", f"SELECT {cols(ROW)}, primaryexch, securitytype, {r('prc')} FROM candidates"),
    "daily_universe": over("universe", f"""SELECT {cols(ROW)}, ticker,
        {rs(['prc', 'dollar_volume_for_universe', 'adv20', 'avg_volume_20d'], 4)}, hist_ret_obs_252, trading_age_obs,
        market_cap_rank, adv20_rank, n_common_equity_candidates, in_universe_flag, universe_exchange_set,
        universe_min_price, universe_min_adv20, universe_min_history_obs, universe_max_market_cap_rank,
        universe_max_adv20_rank FROM universe"""),
    "daily_universe_tight": over("tight_universe", f"""SELECT {cols(ROW)}, ticker,
        {rs(['prc', 'dollar_volume_for_universe', 'adv20', 'avg_volume_20d'], 4)}, hist_ret_obs_252, trading_age_obs,
        market_cap_rank, adv20_rank, n_common_equity_candidates, in_universe_flag, universe_exchange_set,
        universe_min_price, universe_min_adv20, universe_min_history_obs, universe_max_market_cap_rank,
        universe_max_adv20_rank FROM tight_universe"""),
    "missing_return_without_flag": over("core_dedup", f"SELECT {cols(ROW)}, ticker, tradingstatusflg FROM core_dedup "
                                                      f"WHERE dlyret IS NULL AND dlyretmissflg IS NULL"),
    "open_only_missing": over("panel", f"""SELECT {cols(ROW)}, {rs(['dlyhigh', 'dlylow', 'dlyclose'])}
        FROM (SELECT * REPLACE (CASE WHEN dlydelflg = 'N' THEN dlyopen END AS dlyopen) FROM panel)
        WHERE dlyopen IS NULL AND dlyhigh IS NOT NULL AND dlylow IS NOT NULL AND dlyclose IS NOT NULL"""),
    "ohlc_inconsistent_rows": over("panel", f"""SELECT dlycaldt, permno, ticker,
        {rs(['dlyopen', 'dlyhigh', 'dlylow', 'dlyclose', 'dlyprc', 'prc'], 4)}, dlyprcflg, {rs(['dlyvol', 'dlyret'], 4)}
        FROM panel WHERE {OHLC_BAD}"""),
    "invalid_quote_rows": over("prepared", f"""SELECT {cols(ROW)}, {rs(['dlybid', 'dlyask', 'bid_ask_spread'], 4)}
        FROM prepared WHERE bid_ask_spread IS NULL AND NOT ({QUOTE_GAP})"""),
    "quote_missing_rows": over("universe", f"SELECT {cols(ROW)}, {rs(['prc', 'dlyask'], 4)} FROM universe WHERE {QUOTE_GAP}"),
    "retained_return_flag_rows": over("panel", f"SELECT {cols(ROW)}, dlyretmissflg FROM panel WHERE dlyretmissflg IS NOT NULL"),
    "panel_label_join": over("joined", f"""SELECT permno, dlycaldt, market_cap_rank, {rs(['target_1d_raw', T])},
        target_first_missing_return_flag, fwd_date_5 FROM joined"""),
    "universe_yearly_summary": over("universe", f"""SELECT year, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_days,
        {r('avg(n)', 6, 'avg_daily_universe_size')}, min(n) AS min_daily_universe_size, max(n) AS max_daily_universe_size,
        any_value(names) AS n_unique_permnos
        FROM (SELECT year, dlycaldt, count(*) AS n FROM universe GROUP BY year, dlycaldt)
        JOIN (SELECT year, count(DISTINCT permno) AS names FROM universe GROUP BY year) USING (year) GROUP BY year"""),
    "duplicate_rows_detail": over("panel", f"""SELECT dlycaldt, permno, ticker, raw_row_id,
        {rs(['prc', 'dlyret', 'dlyretx', 'dlyreti', 'dlyvol', 'dlycap'], 4)}, distype, disseqnbr, disordinaryflg,
        dispaymenttype, disdetailtype, {rs(['disdivamt', 'disfacpr', 'disfacshr', 'dlyfacprc'], 4)}
        FROM (SELECT *, count(*) OVER (PARTITION BY permno, dlycaldt) AS n FROM panel) WHERE n > 1
        ORDER BY dlycaldt, permno, raw_row_id LIMIT 500"""),
    "panel_coverage_summary": over("joined", f"""SELECT count(*) AS n_universe_rows, count({T}) AS n_complete_label_rows,
        {tally(T + ' IS NULL')} AS n_rows_dropped_missing_complete_5d_label,
        {r(share(T + ' IS NULL'), 6, 'missing_complete_5d_label_rate')} FROM joined"""),
    "profile_core": over("panel", profile_core()),
    "profile_universe": over("universe", profile_universe()),
    "profile_cross_column": over("panel", profile_line("panel", OHLC_RULE_NAME, "cross_column_rule", OHLC_BAD, missing=False)),
    "duplicate_summary": over("panel", duplicates("panel")),
    "duplicate_summary_by_year": over("panel", duplicates("panel", "year")),
    "event_duplicate_summary": duplicates(USER_DAY, pair="user_id, day"),
    "event_dedup": f"""SELECT user_id, day, event_id, event_type, n_events FROM (SELECT *,
        count(*) OVER (PARTITION BY user_id, day) AS n_events,
        row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS nth FROM {USER_DAY}) WHERE nth = 1""",
    "rows_per_key": over("panel", "SELECT n_rows, count(*) AS n_stock_days FROM "
                                  "(SELECT count(*) AS n_rows FROM panel GROUP BY permno, dlycaldt) GROUP BY n_rows"),
    "duplicate_event_digest": over("panel", event_digest()),
    "duplicate_field_differences": over("panel", field_differences("permno, dlycaldt, ticker, year")),
    "duplicate_difference_rate": over("panel", "SELECT count(*) AS n_duplicate_stock_days, " + ", ".join(
        f"{tally(f'n_distinct_{f} > 1')} AS n_diff_{f}" for f in DUP_FIELDS)
        + f" FROM ({field_differences('permno, dlycaldt')})"),
    "universe_daily_summary": over("universe", f"""SELECT dlycaldt, year, count(*) AS n_universe, {r('min(prc)', 4, 'min_prc')},
        {r('median(prc)', 4, 'median_prc')}, {r('median(dlycap)', 4, 'median_mktcap')}, {r('median(adv20)', 4, 'median_adv20')},
        min(market_cap_rank) AS best_market_cap_rank, max(market_cap_rank) AS worst_market_cap_rank,
        min(adv20_rank) AS best_adv20_rank, max(adv20_rank) AS worst_adv20_rank FROM universe GROUP BY dlycaldt, year"""),
    "missing_by_group": over("panel", by_group("panel", "dlyret IS NULL", "missing")),
    "abnormal_by_group": over("panel", by_group("panel", "disdivamt < 0", "abnormal")),
    "nonmissing_by_group": over("panel", by_group(REGULAR, "distype IS NOT NULL", "nonmissing")),
    "value_counts": over("panel", counted("panel", "coalesce(dlyretmissflg, '__MISSING__')", n="count")),
    "value_counts_nonmissing": over("panel", counted(REGULAR, "disdetailtype", "disdetailtype IS NOT NULL", top="LIMIT 50")),
    "value_counts_orders": counted("orders", "o_orderpriority", n="count"),
    "missing_return_status_with_flag": missing_status("NOT NULL"),
    "missing_return_status_without_flag": missing_status("NULL"),
    "missing_return_flag_counts": over("core_dedup", counted(
        "core_dedup", "coalesce(dlyretmissflg, '__NULL__')", "dlyret IS NULL", "dlyretmissflg")),
    "retained_return_flag_counts": over("core_dedup", counted(
        "core_dedup", "dlyretmissflg", "dlyretmissflg IS NOT NULL", "dlyretmissflg")),
    "numeric_summary": over("panel", summary("panel", "dlyret")),
    "numeric_summary_orders": summary("orders", "o_totalprice", 4),
    "histogram": over("panel", histogram("panel", "dlycap", 50)),
    "histogram_orders": histogram("orders", "o_totalprice", 20),
    "ohlc_missing_by_price_flag": over("prepared", f"""SELECT dlyprcflg, price_from_bidask_flag, count(*) AS n_rows,
        {', '.join(f"{tally(f'dly{x} IS NULL')} AS n_missing_{x}" for x in ('open', 'close', 'high', 'low'))},
        {r(share('dlyclose IS NULL'), 6, 'close_missing_rate')}
        FROM prepared GROUP BY dlyprcflg, price_from_bidask_flag HAVING count(*) FILTER (WHERE {OHLC_GAP}) > 0"""),
    "missing_return_summary": over("core_dedup", f"""SELECT count(*) AS n_total, {tally('dlyret IS NULL')} AS n_missing_dlyret,
        {tally('dlyret IS NULL AND dlyretmissflg IS NOT NULL')} AS n_missing_dlyret_with_dlyretmissflg,
        {tally('dlyret IS NULL AND dlyretmissflg IS NULL')} AS n_missing_dlyret_without_dlyretmissflg,
        {r(share('dlyret IS NULL'), 6, 'missing_dlyret_rate')} FROM core_dedup"""),
    "label_summary": over("labels", f"""SELECT count(*) AS n_rows, count(DISTINCT (permno, dlycaldt)) AS n_unique_stock_days,
        {tally('target_1d_raw IS NULL')} AS n_missing_target_1d_raw,
        {r(share('target_1d_raw IS NULL'), 6, 'missing_target_1d_rate')}, {label_measures()} FROM labels"""),
    "label_yearly_summary": over("labels", f"SELECT year, count(*) AS n_rows, {label_measures()} FROM labels GROUP BY year"),
    "label_flag_set_counts": label_flag_counts("target_missing_return_flag_set"),
    "label_first_flag_counts": label_flag_counts("target_first_missing_return_flag"),
    "panel_daily_summary": over("model", f"""SELECT dlycaldt, year, count(*) AS n_model_rows,
        {', '.join(r(f'quantile_cont({T}, {p / 100})', 6, f'target_5d_p{p:02d}') for p in (1, 50, 99))},
        {r(f'avg({T})', 6, 'mean_target_5d_raw')}, {r('avg(target_5d_cs_zscore)', 6, 'mean_target_5d_cs_zscore')},
        {r('stddev_samp(target_5d_cs_zscore)', 6, 'sd_target_5d_cs_zscore')} FROM model GROUP BY dlycaldt, year"""),
    "panel_yearly_summary": over("model", f"""SELECT year, count(*) AS n_rows, count(DISTINCT dlycaldt) AS n_days,
        count(DISTINCT permno) AS n_unique_permnos, {r(f'avg({T})', 6, 'mean_target_5d_raw')},
        {r(f'median({T})', 6, 'median_target_5d_raw')}, {r('avg(target_5d_cs_zscore)', 6, 'mean_target_5d_cs_zscore')},
        {r('stddev_samp(target_5d_cs_zscore)', 6, 'sd_target_5d_cs_zscore')} FROM model GROUP BY year"""),
    "recent_label_availability": over("joined", f"""SELECT dlycaldt, count(*) AS n_universe_rows,
        {tally(T + ' IS NULL')} AS n_missing_complete_5d_label,
        {r(share(T + ' IS NULL'), 6, 'missing_complete_5d_label_rate')}
        FROM joined GROUP BY dlycaldt ORDER BY dlycaldt DESC LIMIT 15"""),
    "dedup_ready_base": over("base", f"SELECT {cols(ROW)}, ticker, n_rows_same_stock_day FROM base"),
    "dedup_core": over("core_dedup", f"SELECT {cols(ROW)}, tradingstatusflg, {r('prc')} FROM core_dedup"),
    "rolling_adv20": over("history", f"SELECT permno, dlycaldt, "
                                     f"{rs(['dollar_volume_for_universe', 'adv20', 'avg_volume_20d'], 4)} FROM history"),
    "rolling_history": over("history", "SELECT permno, dlycaldt, hist_ret_obs_252, trading_age_obs FROM history"),
    "cross_section_ranks": over("ranked", "SELECT permno, dlycaldt, market_cap_rank, adv20_rank, "
                                          "n_common_equity_candidates FROM ranked"),
    "forward_leads": over("leads", "SELECT permno, dlycaldt, " + ", ".join(
        r(f"ret_{k}") if n == "ret" else f"{n}_{k}"
        for n in ("fwd_date", "ret", "miss_flag_raw", "fwd_tradingstatusflg", "fwd_dlydelflg") for k in STEPS) + " FROM leads"),
    "label_missing_flags": over("reasons", "SELECT permno, dlycaldt, " + cols(f"miss_flag_{k}" for k in STEPS) + " FROM reasons"),
    "label_first_missing": over("firsts", """SELECT permno, dlycaldt, target_first_missing_return_pos,
        target_first_missing_return_flag, target_n_valid_forward_returns, target_has_missing_return,
        target_has_delisting_missing_flag FROM firsts"""),
    "label_flag_set": over("firsts", "SELECT permno, dlycaldt, target_missing_return_flag_set FROM firsts"),
    "label_5d_complete": over("labels", f"SELECT permno, dlycaldt, {rs(['target_1d_raw', T])} FROM labels"),
    "label_zero_after_missing": over("labels", f"SELECT permno, dlycaldt, {r('bt_5d_return_zero_after_missing')} FROM labels"),
    "label_delist_stress": over("labels", f"SELECT permno, dlycaldt, "
                                          f"{rs(['bt_5d_return_delist_stress_30', 'bt_5d_return_delist_stress_100'])} FROM labels"),
    "label_layout": over("labels", f"""SELECT permno, dlycaldt, year, {cols(LABEL_LAYOUT_TEXT)},
        {rs(['prc', 'dlyprc', 'dlyvol', 'dlycap'])}, {r('dlyret', 6, 'current_dlyret')}, {r('dlyretx', 6, 'current_dlyretx')},
        {r('dlyreti', 6, 'current_dlyreti')}, dlyretmissflg AS current_dlyretmissflg,
        {cols(f'fwd_date_{k}' for k in STEPS)}, {rs([f'ret_{k}' for k in STEPS])},
        {rs(['target_1d_raw', T, 'bt_5d_return_zero_after_missing', 'bt_5d_return_delist_stress_30', 'bt_5d_return_delist_stress_100'])},
        target_has_missing_return, target_first_missing_return_pos, target_has_delisting_missing_flag,
        target_n_valid_forward_returns FROM labels"""),
    "target_winsor": over("labels", f"SELECT permno, dlycaldt, "
                                    f"{rs([T, 'target_5d_p01', 'target_5d_p99', 'target_5d_winsor'])} "
                                    f"FROM ({winsorised('(SELECT permno, dlycaldt, ' + T + ' FROM labels)')})"),
    "target_zscore": over("labels", f"""SELECT permno, dlycaldt, {rs([T, T + '_mean', T + '_sd'])}, n_cross_section,
        {r(f"CASE WHEN coalesce({T}_sd, 0) = 0 THEN 0e0 ELSE ({T} - {T}_mean) / {T}_sd END", 6, Z)}
        FROM (SELECT permno, dlycaldt, {T}, avg({T}) OVER day AS {T}_mean, stddev_samp({T}) OVER day AS {T}_sd,
              count(*) OVER day AS n_cross_section FROM labels WHERE {T} IS NOT NULL
              WINDOW day AS (PARTITION BY dlycaldt))"""),
    "model_panel": over("model", f"SELECT permno, dlycaldt, market_cap_rank, n_cross_section, {rs(MODEL_DOUBLES)} FROM model"),
    "latest_base_rows": over("base", f"""SELECT dlycaldt, permno, ticker, primaryexch, securitytype, sharetype,
        tradingstatusflg, {rs(['prc', 'dlyvol', 'dlycap', 'dlyret', 'dollar_volume'], 4)}, has_ohlc_flag, ohlc_missing_flag,
        price_from_bidask_flag, bidask_missing_flag FROM base ORDER BY dlycaldt DESC, permno LIMIT 20"""),
    "latest_universe_rows": over("universe", f"""SELECT dlycaldt, permno, ticker, primaryexch, securitytype, securitysubtype,
        sharetype, {rs(['prc', 'dlyvol', 'dlycap', 'adv20'], 4)}, market_cap_rank, adv20_rank, hist_ret_obs_252,
        has_ohlc_flag, price_from_bidask_flag, bidask_missing_flag
        FROM universe ORDER BY dlycaldt DESC, market_cap_rank, permno LIMIT 30"""),
    "dropped_label_examples": over("joined", f"""SELECT permno, dlycaldt, market_cap_rank, target_missing_return_flag_set,
        target_n_valid_forward_returns FROM joined WHERE {T} IS NULL ORDER BY dlycaldt DESC, permno LIMIT 500"""),
    "missing_label_examples": over("labels", """SELECT permno, dlycaldt, target_first_missing_return_pos,
        target_missing_return_flag_set FROM labels WHERE target_has_missing_return = 1 ORDER BY dlycaldt, permno LIMIT 200"""),
    "abnormal_examples": over("panel", evidence()),
    "sample_missing": over("panel", drawn("panel", "disdivamt IS NULL", 20, "prc")),
    "sample_abnormal": over("panel", drawn("panel", "disdivamt < 0", 20, "disdivamt")),
    "sample_nonmissing": over("panel", drawn(REGULAR, "shareclass IS NOT NULL", 20, "prc")),
    "sample_ohlc_missing": over("panel", drawn("panel", OHLC_GAP, 50, "prc")),
    "size_targeted_sample": over("panel", f"SELECT {cols(ROW)} FROM ({SAMPLED})"),
    "sample_size_summary": over("panel", f"""SELECT 0.5e0 AS target_size_mb, {r('sum(bytes) / 1048576e0', 6, 'actual_size_mb')},
        count(*) AS n_rows, {r('avg(bytes)', 6, 'avg_bytes_per_row')}, min(dlycaldt) AS min_date, max(dlycaldt) AS max_date,
        count(DISTINCT dlycaldt) AS n_unique_dates, count(DISTINCT permno) AS n_unique_permnos
        FROM (SELECT *, {LINE_BYTES} AS bytes FROM ({SAMPLED}))"""),
    "sample_estimate": over("panel", f"""SELECT 0.5e0 AS target_size_mb, {r('avg(bytes)', 6, 'avg_bytes_per_row')}, {SAMPLE_SIZE} AS n_wanted
        FROM (SELECT {LINE_BYTES} AS bytes FROM panel ORDER BY {DRAW} LIMIT 10000)"""),
    "stage_row_counts": over("base", """SELECT 'daily_core' AS table_name, count(*) AS n FROM panel
        UNION ALL SELECT 'daily_universe_prepare_all', count(*) FROM prepared
        UNION ALL SELECT 'daily_universe_ready_base', count(*) FROM base
        UNION ALL SELECT 'daily_terminal_events', count(*) FROM prepared WHERE terminal_event_flag = 1"""),
    "rolling_return": over("core_dedup", f"SELECT permno, dlycaldt, {r(trailing(5), 6, 'ret_5d')}, "
                                         f"{r(trailing(21), 6, 'ret_21d')} {TRAILING}"),
    "rolling_volatility": over("core_dedup", "SELECT permno, dlycaldt, " + r(
        "CASE WHEN count(dlyret) OVER recent = 21 THEN stddev_samp(dlyret) OVER recent END", 6, "vol_21d") + f" {TRAILING}"),
    "ohlc_valid_features": over("panel", f"""SELECT {cols(ROW)}, ({USABLE})::INTEGER AS ohlc_usable_flag,
        {r(f"CASE WHEN {USABLE} AND dlyopen > 0 AND dlyclose > 0 THEN dlyclose / dlyopen - 1 END", 6, 'intraday_ret_valid')},
        {r(f"CASE WHEN {USABLE} AND dlyhigh > 0 AND dlylow > 0 THEN dlyhigh / dlylow - 1 END", 6, 'intraday_range_valid')}
        FROM panel"""),
    "distribution_yield": over("panel", f"""SELECT {cols(ROW)},
        {r('CASE WHEN prc > 0 THEN disdivamt / prc END', 8, 'distribution_yield')},
        {bit('disfacpr <> 0')} AS split_event_flag, {r('abs(disfacpr)', 8, 'abs_disfacpr')} FROM panel"""),
    "distribution_kinds": over("panel", f"""SELECT {cols(ROW)}, CASE
        WHEN distype IS NULL AND disdetailtype IS NULL AND disdivamt IS NULL THEN 'none'
        WHEN disdivamt < 0 OR disfacpr < 0 THEN 'adjustment'
        WHEN disordinaryflg = 'Y' AND disdivamt > 0 THEN 'ordinary_cash'
        WHEN disdivamt > 0 THEN 'special_cash'
        WHEN disfacshr <> 0 AND disdivamt IS NULL THEN 'stock' ELSE 'other' END AS distribution_kind FROM panel"""),
}
