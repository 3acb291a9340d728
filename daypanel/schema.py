"""What a panel is: its key columns and the logical type of each variable."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Logical type -> Spark type. "decimal" is a double on purpose: the source
# dictionary calls every non-integer number a decimal.
SPARK_TYPES: Mapping[str, T.DataType] = {
    "int": T.LongType(),
    "decimal": T.DoubleType(),
    "date": T.DateType(),
    "char": T.StringType(),
}

# ---- fixed values: the variable dictionary of the daily stock file, in file order ----
DAILY_STOCK_VARIABLES = """
permno:int secinfostartdt:date secinfoenddt:date securitybegdt:date securityenddt:date
securityhdrflg:char hdrcusip:char hdrcusip9:char cusip:char cusip9:char primaryexch:char
conditionaltype:char exchangetier:char tradingstatusflg:char securitynm:char shareclass:char
usincflg:char issuertype:char securitytype:char securitysubtype:char sharetype:char
securityactiveflg:char delactiontype:char delstatustype:char delreasontype:char
delpaymenttype:char ticker:char tradingsymbol:char permco:int siccd:int naics:char
icbindustry:char issuernm:char yyyymmdd:int dlycaldt:date dlydelflg:char dlyprc:decimal
dlyprcflg:char dlycap:decimal dlycapflg:char dlyprevprc:decimal dlyprevprcflg:char
dlyprevdt:date dlyprevcap:decimal dlyprevcapflg:char dlyret:decimal dlyretx:decimal
dlyreti:decimal dlyretmissflg:char dlyretdurflg:char dlyorddivamt:decimal
dlynonorddivamt:decimal dlyfacprc:decimal dlydistretflg:char dlyvol:decimal dlyclose:decimal
dlylow:decimal dlyhigh:decimal dlybid:decimal dlyask:decimal dlyopen:decimal dlynumtrd:int
dlymmcnt:int dlyprcvol:decimal shrstartdt:date shrenddt:date shrout:int shrsource:char
shrfactype:char shradrflg:char disexdt:date disseqnbr:int disordinaryflg:char distype:char
disfreqtype:char dispaymenttype:char disdetailtype:char distaxtype:char disorigcurtype:char
disdivamt:decimal disfacpr:decimal disfacshr:decimal disdeclaredt:date disrecorddt:date
dispaydt:date dispermno:int dispermco:int nasdcompno:int nasdissuno:int vwretd:decimal
vwretx:decimal ewretd:decimal ewretx:decimal sprtrn:decimal
"""
# ---- end of fixed values ----


@dataclass(frozen=True)
class PanelSchema:
    """Ordered ``name -> logical type`` dictionary of a raw file."""

    variables: tuple[tuple[str, str], ...]

    def __post_init__(self) -> None:
        unknown = {t for _, t in self.variables} - set(SPARK_TYPES)
        if unknown:
            raise ValueError(f"unknown logical types: {sorted(unknown)}")

    @classmethod
    def parse(cls, text: str) -> PanelSchema:
        return cls(tuple(tuple(item.split(":")) for item in text.split()))

    def __iter__(self) -> Iterator[tuple[str, str]]:
        return iter(self.variables)

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.variables]

    @property
    def castable(self) -> list[tuple[str, str]]:
        """Variables whose cast can fail; text never does."""
        return [(n, t) for n, t in self.variables if t != "char"]

    def raw_struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in self.names])

    def typed_struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK_TYPES[t]) for n, t in self.variables])


DAILY_STOCK = PanelSchema.parse(DAILY_STOCK_VARIABLES)


@dataclass(frozen=True)
class PanelKey:
    """Names of the key columns of a panel.

    ``order`` ranks rows that share one (entity, date): the first one is kept.
    """

    entity: str = "permno"
    date: str = "dlycaldt"
    order: tuple[str, ...] = ("source_file", "raw_row_id")

    @property
    def pair(self) -> list[str]:
        return [self.entity, self.date]

    def check_date(self, df: DataFrame) -> None:
        """Insist on a calendar-day column.

        Several operators lean on it: once (entity, date) is unique an entity
        has at most one row per calendar day, and per-date statistics have at
        most one row per calendar day, so both are bounded by the calendar.
        """
        kind = df.schema[self.date].dataType
        if not isinstance(kind, T.DateType):
            raise TypeError(f"{self.date} must be a DATE column, not {kind.simpleString()}")


DEFAULT_KEY = PanelKey()


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise ``ValueError`` for names the DataFrame lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")


def columns_of(df: DataFrame) -> DataFrame:
    """Schema listing: one row per column with its position and type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


class Names:
    """Maps the standard column names used by the flag and label formulas to
    the names a given table uses: ``Names(prc="close_price")``."""

    def __init__(self, **renamed: str) -> None:
        self.renamed = renamed

    def __call__(self, standard: str):
        return F.col(self.renamed.get(standard, standard))


STANDARD_NAMES = Names()
