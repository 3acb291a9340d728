"""Reading raw files and stage tables."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from daypanel.operators.ingest import normalise_names
from daypanel.schema import PanelKey, PanelSchema


def read_raw_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: PanelSchema | None = None,
    multi_line: bool = False,
    header: bool = True,
    record: str | None = None,
) -> DataFrame:
    """Every column as text: inference would damage identifiers. With a schema
    the header is not even read to find the names, and files may have none. A
    quote within quotes is doubled and a backslash is a character like any
    other. ``multi_line`` lets quoted values hold line breaks; each file is then
    read by one task.

    ``record`` names a column for the whole text of records whose number of
    fields is not that of the table, NULL for all others. Without it such
    records pass unnoticed, filled with NULL or cut.
    """
    reader = (
        spark.read.option("header", header)
        .option("inferSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    paths = path if isinstance(path, str) else list(path)
    if schema is not None:
        columns = schema.raw_struct()
        reader = reader.option("enforceSchema", False)
    elif record is not None:
        columns = reader.csv(paths).schema
    else:
        return reader.csv(paths)
    if record is None:
        return reader.schema(columns).csv(paths)
    if record in columns.names:
        raise ValueError(f"the table has a column {record} already")
    declared = StructType([*columns.fields, StructField(record, StringType())])
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", record).schema(declared).csv(paths)


def scan_raw(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw Parquet parts, matched by column name in any letter case, with the
    file and the position in the file of every row.

    The position comes with the scan: no sort, no shuffle, and the same number
    whenever the file is read. The file's name is its path below the scanned
    folder, or below what several scanned folders share, so that equal names in
    different folders stay apart.
    """
    paths = [path] if isinstance(path, str) else list(path)
    above = paths[0] if len(paths) == 1 else posixpath.commonpath([p.rstrip("/") for p in paths])
    plain = re.sub(r"^[a-zA-Z0-9]+:/*(?=/)", "", above).rstrip("/")
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.substring_index(full, f"{plain}/", -1)
    name = F.when(F.endswith(full, F.lit(plain)), F.col("_metadata.file_name")).otherwise(below)
    parts = spark.read.option("mergeSchema", True).parquet(*paths)
    return normalise_names(
        parts.select(
            name.alias("source_file"), F.col("_metadata.row_index").alias("raw_row_id"), "*"
        )
    )


def scan_panel(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A stage table; ``year`` comes from the directories and prunes them."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_series(spark: SparkSession, path: str, schema: StructType, key: PanelKey, buckets: int) -> DataFrame:
    """A table that ``write_series`` dealt out, in another session."""
    name = f"series_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key.entity}`) "
        f"SORTED BY (`{key.entity}`, `{key.date}`) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
