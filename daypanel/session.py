"""Session settings that suit wide panels."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# The JIT does not compile methods above 8,000 bytes of bytecode. A projection
# of a hundred flags exceeds that as one fused method; below this limit Spark
# splits it into small methods instead.
# Tables dealt out by security serve joins by security and day as well; by
# default Spark deals both sides of such a join again, by both columns.
WIDE_PANEL_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in WIDE_PANEL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


METHOD_LIMIT, SPARK_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "65535"


def split_methods(spark: SparkSession) -> SparkSession:
    """The setting of ``tune`` that wide projections need, where the session leaves it as Spark has it."""
    if spark.conf.get(METHOD_LIMIT) == SPARK_METHOD_LIMIT:
        spark.conf.set(METHOD_LIMIT, WIDE_PANEL_SETTINGS[METHOD_LIMIT])
    return spark


#: Shuffle files go at the end of the query they belong to. Else they stay until the driver collects its garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: the setting of ``tune`` that joins of tables dealt out by security need
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
JOINED_AS_DEALT = {CO_PARTITION: WIDE_PANEL_SETTINGS[CO_PARTITION]}


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[SparkSession]:
    """For what runs within: the settings of the session are as they were afterwards."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield spark
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def with_settings(spark: SparkSession, wanted: Mapping[str, str]) -> SparkSession:
    """A session beside the given one, with its settings but for those wanted: a DataFrame that is planned later, when it is
    written, takes them along, and no other query sees them. A join by day of a whole market must not be dealt by day only."""
    own = spark.newSession()
    for name, value in (dict(spark.conf.getAll) | dict(wanted)).items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    return own
