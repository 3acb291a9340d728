"""Missing and abnormal values of every variable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daypanel.functions.rules import CORE_RULES, OHLC_RULE_NAME, Rule, rules_for
from daypanel.schema import DEFAULT_KEY, PanelKey, PanelSchema, require_columns

CROSS_COLUMN = "cross_column_rule"
#: conditions in one long
WORD = 63


def _packed(conditions: Sequence[Column]) -> list[Column]:
    """What holds of a row, a bit each, in as many longs as it takes."""

    def either(bits: list[Column]) -> Column:
        # Halved, not chained: an expression of a hundred levels is slow to plan.
        half = len(bits) // 2
        return bits[0] if len(bits) == 1 else either(bits[:half]).bitwiseOR(either(bits[half:]))

    bits = [F.when(c, F.lit(1 << k % WORD).cast("long")).otherwise(F.lit(0).cast("long")) for k, c in enumerate(conditions)]
    return [either(bits[i : i + WORD]) for i in range(0, len(bits), WORD)]


def _held(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """One row with a map ``held``: for the number of each condition, how many
    rows meet it, if any do.

    Rows are alike when they meet the same conditions, so patterns are counted,
    in every task first, and only then taken apart: one scan and one small
    shuffle, whatever the number of conditions.
    """
    words = [f"w{k}" for k in range(-(-len(conditions) // WORD))]
    patterns = df.select(*[c.alias(w) for w, c in zip(words, _packed(conditions), strict=True)]).groupBy(*words).agg(F.count("*").alias("n"))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("word", b) == 1)
    bits = patterns.select("n", F.posexplode(F.array(*words)).alias("at", "word")).select("n", "at", F.explode(set_bits).alias("bit"))
    counts = bits.groupBy((F.col("at") * WORD + F.col("bit")).alias("at")).agg(F.sum("n").alias("n"))
    # At most one entry a condition.
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("held"))


def _counts(df: DataFrame, types: Mapping[str, str], rules: Mapping[str, Rule]) -> DataFrame:
    """The lines of the given variables."""
    conditions = [F.lit(True)]
    places: dict[tuple[str, str], int] = {}
    for name, kind in types.items():
        if kind != CROSS_COLUMN:
            places["missing", name] = len(conditions)
            conditions.append(F.col(name).isNull())
        if name in rules:
            places["abnormal", name] = len(conditions)
            conditions.append(rules[name].hit())

    def held(what: str, name: str) -> Column:
        return F.coalesce(F.col("held")[places[what, name]], F.lit(0).cast("long"))

    def line(name: str, kind: str) -> Column:
        rule = rules.get(name)
        return F.struct(
            F.lit(name).alias("variable"),
            F.lit(kind).alias("type"),
            F.coalesce(F.col("held")[0], F.lit(0).cast("long")).alias("n_total"),
            (F.lit(None).cast("bigint") if kind == CROSS_COLUMN else held("missing", name)).alias("missing_count"),
            (held("abnormal", name) if rule else F.lit(0).cast("bigint")).alias("abnormal_count"),
            F.lit(rule.predicate if rule else "").alias("abnormal_rule"),
        )

    return _held(df, conditions).select(F.inline(F.array(*[line(c, t) for c, t in types.items()])))


def profile(df: DataFrame, schema: PanelSchema | None = None, registry: Mapping[str, Rule] = CORE_RULES) -> DataFrame:
    """One row per variable: how many values are missing or abnormal.

    Variables and their types come from the dictionary, or from the table's
    own schema. Rules over several columns follow as lines of their own, with
    NULL missing counts. All of it comes from one scan.
    """
    types = dict(schema) if schema else {f.name: f.dataType.simpleString() for f in df.schema.fields}
    require_columns(df, types)
    rules = {r.variable: r for r in rules_for(df, registry) if r.cross_column or r.variable in types}
    return with_rates(_counts(df, types | {name: CROSS_COLUMN for name, r in rules.items() if r.cross_column}, rules))


def cross_column_profile(df: DataFrame, registry: Mapping[str, Rule] = CORE_RULES) -> DataFrame:
    """The lines of the rules over several columns alone."""
    rules = {r.variable: r for r in rules_for(df, registry) if r.cross_column}
    return with_rates(_counts(df, dict.fromkeys(rules, CROSS_COLUMN), rules))


def with_rates(lines: DataFrame) -> DataFrame:
    return lines.select(
        "variable",
        "type",
        "n_total",
        "missing_count",
        F.try_divide("missing_count", "n_total").alias("missing_pct"),
        "abnormal_count",
        F.try_divide("abnormal_count", "n_total").alias("abnormal_pct"),
        "abnormal_rule",
    ).orderBy(F.desc_nulls_last("abnormal_pct"), F.desc_nulls_last("missing_pct"), "variable")


def evidence_text(df: DataFrame, column: str):
    """A value as text; doubles with six decimals, so that the text does not
    depend on how an engine spells a double. What has no such form, an infinity
    or a huge number, stands as Spark writes it."""
    plain = F.col(column).cast("string")
    if isinstance(df.schema[column].dataType, T.DoubleType):
        return F.coalesce(F.col(column).try_cast("decimal(38,6)").cast("string"), plain)
    return plain


def ohlc_evidence(df: DataFrame):
    parts = {"open": "dlyopen", "high": "dlyhigh", "low": "dlylow", "close": "dlyclose"}
    return F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), evidence_text(df, c)) for n, c in parts.items()])


def abnormal_examples(
    df: DataFrame,
    n: int | None = 20,
    registry: Mapping[str, Rule] = CORE_RULES,
    key: PanelKey = DEFAULT_KEY,
    label: str = "ticker",
) -> DataFrame:
    """Up to ``n`` rows per rule that breaks it, all for None: variable, key and
    value.

    One scan tests all rules. Each broken rule becomes a small record, its name
    and the value as text, and the records are exploded and cut to ``n`` a rule,
    in every map task first; no other column of the table goes along.
    """
    rules = rules_for(df, registry)
    order = [key.date, key.entity, *key.order]

    def record(rule: Rule):
        value = ohlc_evidence(df) if rule.variable == OHLC_RULE_NAME else evidence_text(df, rule.variable)
        return F.when(rule.hit(), F.struct(F.lit(rule.variable).alias("variable"), value.alias("value")))

    broken = F.array_compact(F.array(*[record(r) for r in rules]))
    hits = df.select(*dict.fromkeys([*order, label]), F.explode(broken).alias("_hit"))
    hits = hits.select("*", F.col("_hit.variable").alias("variable"), F.col("_hit.value").alias("value"))
    if n is not None:
        first = Window.partitionBy("variable").orderBy(*[F.asc_nulls_last(c) for c in order])
        hits = hits.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= n)
    return hits.select("variable", key.entity, key.date, label, "value")
