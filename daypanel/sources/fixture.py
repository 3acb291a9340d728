"""A stock-day panel derived from the ``lineitem`` table, and an all-text table
derived from ``part``.

Both are plain SELECTs that Spark and the checking database run alike, so a
query over them grows with the tables it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PANEL_SELECT = """
SELECT
  CAST(l_suppkey AS BIGINT) AS permno,
  CAST(l_partkey AS BIGINT) AS permco,
  concat('S', CAST(l_suppkey AS STRING)) AS ticker,
  CAST(l_shipdate AS DATE) AS dlycaldt,
  CAST(year(CAST(l_shipdate AS DATE)) AS INT) AS year,
  concat('part_', CAST(l_linenumber AS STRING)) AS source_file,
  CAST((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS BIGINT) AS raw_row_id,
  CASE l_suppkey % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'Q' WHEN 2 THEN 'A' WHEN 3 THEN 'N' ELSE 'R' END AS primaryexch,
  CASE WHEN l_suppkey % 11 = 10 THEN 'FUND' ELSE 'EQTY' END AS securitytype,
  CASE WHEN l_suppkey % 7 = 6 THEN 'PFD' ELSE 'COM' END AS securitysubtype,
  CASE WHEN l_suppkey % 13 = 12 THEN 'AD' ELSE 'NS' END AS sharetype,
  CASE WHEN l_suppkey % 13 = 12 THEN 'Y' ELSE 'N' END AS shradrflg,
  CASE WHEN l_suppkey % 17 = 16 THEN 'N' ELSE 'Y' END AS usincflg,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'D'
       WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 'H' ELSE 'A' END AS tradingstatusflg,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS dlydelflg,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'DA'
       WHEN l_linestatus = 'F' THEN 'BA' ELSE 'TR' END AS dlyprcflg,
  CASE WHEN l_linestatus = 'F' THEN -(l_extendedprice / l_quantity)
       ELSE l_extendedprice / l_quantity END AS dlyprc,
  l_extendedprice / l_quantity AS prc,
  (l_linestatus = 'F') AS dlyprc_negative_flag,
  CASE WHEN l_linestatus = 'F' AND l_linenumber > 3 THEN NULL
       ELSE l_extendedprice / l_quantity * (1e0 + l_discount - l_tax) END AS dlyopen,
  CASE WHEN l_linestatus = 'F' AND l_linenumber > 3 THEN NULL
       ELSE l_extendedprice / l_quantity * 1.08e0 END AS dlyhigh,
  CASE WHEN l_linestatus = 'F' AND l_linenumber > 3 THEN NULL
       ELSE l_extendedprice / l_quantity * 0.95e0 END AS dlylow,
  CASE WHEN l_linestatus = 'F' AND l_linenumber > 3 THEN NULL
       ELSE l_extendedprice / l_quantity END AS dlyclose,
  CASE WHEN l_discount = 0 THEN NULL
       ELSE l_extendedprice / l_quantity * (1e0 - l_discount) END AS dlybid,
  l_extendedprice / l_quantity * (1e0 + l_tax - 0.02e0) AS dlyask,
  l_quantity AS dlyvol,
  l_extendedprice * 100e0 AS dlycap,
  CASE WHEN l_discount = 0.05e0 THEN NULL ELSE l_extendedprice END AS dlyprcvol,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_discount - l_tax END AS dlyret,
  CASE WHEN l_tax = 0 THEN CASE l_returnflag WHEN 'A' THEN 'NT' WHEN 'N' THEN 'DM' ELSE NULL END
       ELSE NULL END AS dlyretmissflg,
  CASE WHEN l_linenumber > 4 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS dlynumtrd,
  CAST(l_quantity * 1000 AS BIGINT) AS shrout,
  CASE WHEN l_linenumber = 2 THEN 'CD' WHEN l_linenumber = 3 THEN 'FRS' ELSE NULL END AS distype,
  CASE WHEN l_linenumber IN (2, 3) THEN CAST(l_linenumber AS BIGINT) ELSE NULL END AS disseqnbr,
  CASE WHEN l_linenumber = 2 THEN l_discount * 10 - 0.05e0 ELSE NULL END AS disdivamt,
  CASE WHEN l_linenumber = 3 THEN l_tax - 0.04e0 ELSE NULL END AS disfacpr,
  CASE WHEN l_linenumber = 3 THEN l_discount - 0.05e0 ELSE NULL END AS disfacshr,
  CASE WHEN l_linenumber = 2 THEN 'Y' WHEN l_linenumber = 3 THEN 'N' ELSE NULL END AS disordinaryflg,
  CASE WHEN l_linenumber IN (2, 3) THEN CAST(l_shipdate AS DATE) ELSE NULL END AS disexdt,
  CASE WHEN l_linenumber = 2 THEN 'USD' ELSE NULL END AS dispaymenttype,
  CASE WHEN l_linenumber = 2 THEN 'CASH' WHEN l_linenumber = 3 THEN 'STK' ELSE NULL END AS disdetailtype,
  CASE WHEN l_linenumber = 3 THEN 1e0 - l_tax WHEN l_linenumber = 7 THEN NULL ELSE 1e0 END AS dlyfacprc,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_discount - l_tax - 0.01e0 END AS dlyretx,
  CASE WHEN l_tax = 0 OR l_quantity = 50 THEN NULL ELSE 0.01e0 END AS dlyreti,
  CASE WHEN l_linenumber > 5 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 7 END AS dlymmcnt,
  CASE WHEN l_linenumber > 4 THEN NULL ELSE 'T1' END AS exchangetier,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'GLI' ELSE NULL END AS delactiontype,
  CASE WHEN l_suppkey % 4 = 0 THEN 'A' ELSE NULL END AS shareclass,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'N' ELSE 'Y' END AS securityactiveflg
FROM {lineitem}
"""

RAW_SELECT = """
SELECT
  p_partkey AS raw_row_id,
  CASE p_partkey % 12 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN ' 42 ' WHEN 3 THEN '1.5' WHEN 4 THEN '-2.5'
       WHEN 5 THEN '1e3' WHEN 6 THEN 'abc' WHEN 7 THEN '7.0' WHEN 8 THEN '99999999999999999999' WHEN 9 THEN NULL
       WHEN 10 THEN '9007199254740993' ELSE CAST(p_size AS STRING) END AS s_int,
  CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN '1.0d' WHEN 2 THEN '2.5f' WHEN 3 THEN '1,000' WHEN 4 THEN '.'
       WHEN 5 THEN '-0.5' WHEN 6 THEN '1e-3' WHEN 7 THEN ' 3.25 ' WHEN 8 THEN NULL ELSE CAST(p_retailprice AS STRING) END AS s_dec,
  CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN '2019' WHEN 2 THEN '2019-01' WHEN 3 THEN '2019-1-2' WHEN 4 THEN '2019/01/02'
       WHEN 5 THEN '20190102' WHEN 6 THEN '2019-02-30' WHEN 7 THEN ' 2020-02-29 ' WHEN 8 THEN NULL ELSE '2024-12-31' END AS s_date,
  p_name AS s_char
FROM {part}
"""

# Lines of a CSV file without a header: every eleventh has a field too many, every seventh of the others lacks its last
# one. The name holds the separator, within quotes.
CSV_SELECT = """
SELECT
  concat(CAST(p_partkey AS STRING), ',"', replace(p_name, ' ', ', '), '",', CAST(p_size AS STRING), CASE
    WHEN p_partkey % 11 = 4 THEN ',2019-01-02,surplus'
    WHEN p_partkey % 7 = 3 THEN ''
    WHEN p_partkey % 5 = 0 THEN ',soon'
    ELSE ',2019/1/2' END) AS value
FROM {part}
"""
CSV_VARIABLES = "raw_key:int s_name:char s_size:int s_date:date"

RAW_VARIABLES = "s_int:int s_dec:decimal s_date:date s_char:char"


def for_duckdb(select: str) -> str:
    return select.replace("AS STRING)", "AS VARCHAR)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier = security, ship date = day."""
    return spark.sql(PANEL_SELECT, lineitem=table(spark, sf_dir, "lineitem"))


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CSV_SELECT, part=table(spark, sf_dir, "part"))


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_SELECT, part=table(spark, sf_dir, "part"))
