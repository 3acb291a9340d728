"""Registry of scanning rules: which values are worth a look.

A rule is a Spark SQL predicate over the columns of one row. Rules do not
clean anything; they are counted, grouped and illustrated by the operators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: rule templates and the variables they apply to ----
NOT_POSITIVE = "{c} <= 0"
NEGATIVE = "{c} < 0"
PRICE = "{c} <= 0 OR {c} > 100000"
SIGNED_PRICE = "ABS({c}) <= 0 OR ABS({c}) > 100000"
QUOTE = "{c} < 0 OR {c} > 100000"
CALENDAR = "{c} < DATE '1900-01-01' OR {c} > DATE '2100-01-01'"
STOCK_RETURN = "{c} < -1 OR {c} > 20"
INDEX_RETURN = "{c} < -1 OR {c} > 1"

CORE_FAMILIES = [
    (NOT_POSITIVE, "permno permco"),
    ("{c} < 19000101 OR {c} > 21000101", "yyyymmdd"),
    (CALENDAR, "dlycaldt secinfostartdt secinfoenddt securitybegdt securityenddt dlyprevdt "
               "shrstartdt shrenddt disexdt disdeclaredt disrecorddt dispaydt"),
    (SIGNED_PRICE, "dlyprc dlyprevprc"),
    (PRICE, "prc dlyopen dlyclose dlyhigh dlylow"),
    (QUOTE, "dlybid dlyask"),
    (NEGATIVE, "dlyvol dlynumtrd dlymmcnt dlyprcvol"),
    (NOT_POSITIVE, "shrout dlycap dlyprevcap"),
    (STOCK_RETURN, "dlyret dlyretx dlyreti"),
    (INDEX_RETURN, "vwretd vwretx ewretd ewretx sprtrn"),
    (NOT_POSITIVE, "dlyfacprc"),
    (NEGATIVE, "disdivamt disfacpr disfacshr dlyorddivamt dlynonorddivamt"),
    ("{c} < 0 OR {c} > 9999", "siccd"),
    ("LENGTH({c}) > 10", "primaryexch"),
    ("LENGTH({c}) > 20", "ticker"),
    ("LENGTH({c}) > 30", "tradingsymbol"),
    ("LENGTH({c}) NOT IN (6, 8, 9)", "cusip hdrcusip"),
    ("LENGTH({c}) != 9", "cusip9 hdrcusip9"),
    ("LENGTH({c}) > 200", "securitynm issuernm"),
]
UNIVERSE_FAMILIES = [
    (NOT_POSITIVE, "dollar_volume dollar_volume_for_universe adv20 avg_volume_20d "
                   "market_cap_rank adv20_rank trading_age_obs"),
    (NEGATIVE, "hist_ret_obs_252"),
]
OHLC_RULE_NAME = "price_ohlc_consistency"
OHLC_RULE = (
    "dlyhigh IS NOT NULL AND dlylow IS NOT NULL AND dlyopen IS NOT NULL AND dlyclose IS NOT NULL "
    "AND (dlyhigh < dlylow OR dlyopen > dlyhigh OR dlyopen < dlylow OR dlyclose > dlyhigh OR dlyclose < dlylow)"
)
# ---- end of fixed values ----


@dataclass(frozen=True)
class Rule:
    """``columns`` is what must exist; ``variable`` is what the rule reports on.
    A rule over several columns has a variable that is no column itself."""

    variable: str
    predicate: str
    columns: tuple[str, ...]

    @property
    def cross_column(self) -> bool:
        return self.variable not in self.columns

    def applies_to(self, df: DataFrame) -> bool:
        return set(self.columns) <= set(df.columns)

    def hit(self) -> Column:
        """True where the rule fires; NULL values never fire."""
        return F.coalesce(F.expr(f"({self.predicate})"), F.lit(False))


def expand(families) -> dict[str, Rule]:
    return {
        name: Rule(name, template.format(c=name), (name,))
        for template, names in families
        for name in names.split()
    }


OHLC_CHECK = Rule(OHLC_RULE_NAME, OHLC_RULE, ("dlyopen", "dlyhigh", "dlylow", "dlyclose"))
CORE_RULES: dict[str, Rule] = {**expand(CORE_FAMILIES), OHLC_RULE_NAME: OHLC_CHECK}
UNIVERSE_RULES: dict[str, Rule] = {**expand(CORE_FAMILIES + UNIVERSE_FAMILIES), OHLC_RULE_NAME: OHLC_CHECK}


def column_rule(variable: str, predicate: str | None = None, registry=CORE_RULES, df: DataFrame | None = None) -> Rule:
    """The caller's predicate for a variable, else the registered one.

    As a filter the variable itself must be present: ``x IS NOT NULL AND (...)``.
    With ``df`` the predicate is analysed over that table first, see
    ``predicate_columns``.
    """
    if predicate is None:
        if variable not in registry:
            raise ValueError(f"no rule is registered for {variable}; pass a predicate")
        return registry[variable]
    columns = (variable,) if df is None else tuple(dict.fromkeys((variable, *predicate_columns(df, predicate))))
    return Rule(variable, f"{variable} IS NOT NULL AND ({predicate})", columns)


def predicate_columns(df: DataFrame, predicate: str) -> list[str]:
    """The columns of a table that a predicate reads, in the table's order.

    The predicate is analysed, not run: unknown columns and functions, text
    that is no expression, what is not true or false, aggregates, windows and
    generators, subqueries, and anything that may change from one run to the
    next raise ``ValueError`` with the reason before any job starts. A rule is
    about the values of one row, and a report of it can be repeated.
    """
    try:
        plan = df.filter(F.expr(predicate))._jdf.queryExecution().analyzed()
    except (AnalysisException, ParseException) as why:
        reason = why.getMessage() if hasattr(why, "getMessage") else str(why)
        raise ValueError(f"not a rule over this table: {predicate}: {reason}") from why
    condition = plan.condition()
    if not plan.subqueriesAll().isEmpty():
        raise ValueError(f"a rule is about one row and may not hold a subquery: {predicate}")
    if not condition.deterministic():
        raise ValueError(f"a rule must give the same answer again: {predicate}")
    names, read = set(), condition.references().iterator()
    while read.hasNext():
        names.add(read.next().name())
    if not names:
        raise ValueError(f"a rule must read a column: {predicate}")
    return [c for c in df.columns if c in names]


def rules_for(df: DataFrame, registry=CORE_RULES) -> list[Rule]:
    """Registered rules whose columns the table has, in registry order."""
    return [r for r in registry.values() if r.applies_to(df)]
