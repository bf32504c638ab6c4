"""Declarative data-quality rules.

A rule yields (rule_name, severity, passed, failed_count, total_count, message). All
row-level rules of a table are evaluated by one aggregation over one scan. Over several tables
(``evaluate_tables``) the key and relationship rules of all of them share one shuffle: a
second scan of each table deals a cell (rule, 128-bit hash of the key) per rule that reads it,
as child or as parent, and cells are counted with map-side combine. A rule whose column
does not exist fails on every row, and an empty table passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslode.functions import missing_or_negative, not_accepted, truthy
from saleslode.functions.coerce import number_column
from saleslode.operators.keys import duplicate_key_rows, orphan_rows

CRITICAL, WARNING, INFORMATIONAL = "critical", "warning", "informational"


@dataclass(frozen=True)
class RowRule:
    """Counts rows for which ``fails`` is true."""

    rule_name: str
    column: str
    fails: Callable[[DataFrame], Column]
    message: str
    severity: str = CRITICAL
    absent_message: str | None = None


@dataclass(frozen=True)
class KeyRule:
    """Counts rows whose key occurs more than once."""

    columns: tuple[str, ...]
    severity: str = CRITICAL
    name: str | None = None

    @property
    def rule_name(self) -> str:
        return self.name or f"{'_'.join(self.columns)}_unique"


@dataclass(frozen=True)
class RelationRule:
    """Counts child rows without a parent."""

    rule_name: str
    child_column: str
    parent: DataFrame = field(compare=False)
    parent_column: str
    severity: str = CRITICAL


@dataclass(frozen=True)
class NotEmptyRule:
    """Fails once when the table has no row."""

    dataset: str
    severity: str = CRITICAL

    @property
    def rule_name(self) -> str:
        return f"{self.dataset}_not_empty"


Rule = RowRule | KeyRule | RelationRule | NotEmptyRule


def not_null(column: str, severity: str = CRITICAL) -> RowRule:
    return RowRule(
        f"{column}_not_null", column, lambda df: F.col(column).isNull(),
        f"null values found in {column}", severity,
    )


def non_negative(column: str, severity: str = CRITICAL) -> RowRule:
    return RowRule(
        f"{column}_non_negative", column,
        lambda df: missing_or_negative(number_column(df, column)),
        f"negative or invalid values found in {column}", severity,
    )


def between(column: str, low: float, high: float, severity: str = CRITICAL) -> RowRule:
    def outside(df: DataFrame) -> Column:
        return ~truthy(number_column(df, column).between(low, high))

    return RowRule(
        f"{column}_between_{low}_{high}", column, outside,
        f"values outside [{low}, {high}] found in {column}", severity,
    )


def accepted_values(column: str, values: Iterable[str], severity: str = CRITICAL) -> RowRule:
    accepted = frozenset(values)
    return RowRule(
        f"{column}_accepted_values", column,
        lambda df: not_accepted(F.col(column), accepted),
        f"values outside accepted set found in {column}", severity,
        f"Missing accepted-values column: {column}",
    )


def false_flag(column: str, severity: str = CRITICAL) -> RowRule:
    return RowRule(
        f"{column}_false", column, lambda df: truthy(F.col(column).cast("boolean")),
        f"rows flagged by {column}", severity, f"Missing quality flag column: {column}",
    )


def unique_key(*columns: str, severity: str = CRITICAL, name: str | None = None) -> KeyRule:
    return KeyRule(tuple(columns), severity, name)


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Result rows of all rules on one table."""
    row_rules = [r for r in rules if isinstance(r, (RowRule, NotEmptyRule))]
    parts = [_row_results(df, row_rules)] if row_rules else []
    for rule in rules:
        if isinstance(rule, KeyRule):
            parts.append(_key_result(df, rule))
        elif isinstance(rule, RelationRule):
            parts.append(_relation_result(df, rule))
    return union_results(parts)


def evaluate_tables(frames: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]],
                    label: str = "dataset") -> DataFrame:
    """Result rows of the rules of every table, its name first, from two scans of a table.

    Relations to a table among ``frames`` (the same object) are met in its own scan.
    """
    parts, shared, cells = [], [], {}
    scanned = dict(frames)

    def deal(name: str, cell: Column) -> None:
        cells.setdefault(name, []).append(cell)

    for name, df in frames.items():
        row_rules = [r for r in rules.get(name, ()) if isinstance(r, (RowRule, NotEmptyRule))]
        if row_rules:
            parts.append(_row_results(df, row_rules).withColumn(label, F.lit(name)))
        for rule in rules.get(name, ()):
            number = len(shared)
            if isinstance(rule, KeyRule) and set(rule.columns) <= set(df.columns):
                deal(name, _cell(number, df, rule.columns, child=True))
                text = f" duplicate key rows found for {list(rule.columns)}"
                shared.append((number, name, rule.rule_name, rule.severity, True, text))
            elif isinstance(rule, RelationRule) and _same_kind(df, rule):
                owner = next((n for n, f in scanned.items() if f is rule.parent), None)
                if owner is None:
                    owner = f"parent {number}"
                    scanned[owner] = rule.parent
                deal(name, _cell(number, df, [rule.child_column], child=True))
                deal(owner, _cell(number, rule.parent, [rule.parent_column], child=False))
                text = f" orphan rows found for {rule.child_column} -> {rule.parent_column}"
                shared.append((number, name, rule.rule_name, rule.severity, False, text))
            elif isinstance(rule, (KeyRule, RelationRule)):
                parts.append(evaluate(df, [rule]).withColumn(label, F.lit(name)))
    if shared:
        parts.append(_shared_results(scanned, cells, shared, label))
    columns = [label, "rule_name", "severity", "passed", "failed_count", "total_count", "message"]
    return union_results([part.select(*columns) for part in parts])


def _same_kind(child: DataFrame, rule: RelationRule) -> bool:
    """Both columns are there and of one type, so that equal values have equal hashes."""
    return (rule.child_column in child.columns and rule.parent_column in rule.parent.columns
            and child.schema[rule.child_column].dataType
            == rule.parent.schema[rule.parent_column].dataType)


def _cell(number: int, df: DataFrame, columns: Sequence[str], child: bool) -> Column:
    """A row's key for one rule; the key of a relation is NULL where its column is."""
    parts = [p for c in columns for p in (df[c], df[c].isNull())]
    known = F.lit(True) if len(columns) > 1 else df[columns[0]].isNotNull()
    return F.struct(
        F.lit(number).alias("rule"), known.alias("known"), F.xxhash64(*parts).alias("hash1"),
        F.xxhash64(F.lit(number), F.lit("second"), *parts).alias("hash2"),
        F.lit(int(child)).cast("bigint").alias("children"), F.lit(not child).alias("parent"))


def _shared_results(frames: Mapping[str, DataFrame], cells: Mapping[str, Sequence[Column]],
                    shared: Sequence[tuple], label: str) -> DataFrame:
    spark = next(iter(frames.values())).sparkSession
    dealt = union_results([frames[name].select(F.explode(F.array(*made)).alias("c")).select("c.*")
                           for name, made in cells.items()])
    keys = dealt.groupBy("rule", "known", "hash1", "hash2").agg(
        F.sum("children").alias("n"), F.bool_or("parent").alias("has_parent"))
    table = F.broadcast(spark.createDataFrame(
        shared, f"rule int, {label} string, rule_name string, severity string, is_key boolean,"
                " text string"))
    failed = F.when(F.col("is_key"), F.when(F.col("n") > 1, F.col("n"))).otherwise(
        F.when(F.col("known") & ~F.col("has_parent"), F.col("n")))
    counted = keys.join(table.select("rule", "is_key"), "rule").groupBy("rule").agg(
        F.sum(failed).alias("failed_count"), F.sum("n").alias("total_count"))
    zero = F.lit(0).cast("bigint")
    return table.join(counted, "rule", "left").select(
        label, "rule_name", "severity", (F.coalesce("failed_count", zero) == 0).alias("passed"),
        F.coalesce("failed_count", zero).alias("failed_count"),
        F.coalesce("total_count", zero).alias("total_count"),
        F.concat(F.coalesce("failed_count", zero).cast("string"), "text").alias("message"))


def union_results(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _row_results(df: DataFrame, rules: Sequence[RowRule | NotEmptyRule]) -> DataFrame:
    total = F.count(F.lit(1))
    counts = []
    for i, rule in enumerate(rules):
        if isinstance(rule, NotEmptyRule):
            failed = F.when(total > 0, F.lit(0)).otherwise(F.lit(1)).cast("bigint")
        elif rule.column in df.columns:
            failed = F.count_if(rule.fails(df))
        else:
            failed = total
        counts.append(failed.alias(f"_f{i}"))
    counted = df.agg(total.alias("total_count"), *counts)
    entries = []
    for i, rule in enumerate(rules):
        failed = F.col(f"_f{i}")
        if isinstance(rule, NotEmptyRule):
            message = F.concat(
                F.lit(f"{rule.dataset} has "), F.col("total_count").cast("string"), F.lit(" rows")
            )
        elif rule.column not in df.columns and rule.absent_message:
            message = F.lit(rule.absent_message)
        else:
            message = F.concat(failed.cast("string"), F.lit(f" {rule.message}"))
        entries.append(_entry(rule.rule_name, rule.severity, failed, message))
    return counted.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def _key_result(df: DataFrame, rule: KeyRule) -> DataFrame:
    absent = [column for column in rule.columns if column not in df.columns]
    if absent:
        total = F.count(F.lit(1))
        counted = df.agg(total.alias("failed_count"), total.alias("total_count"))
        message = F.lit(f"Missing key columns: {absent}")
    else:
        counted = duplicate_key_rows(df, rule.columns)
        message = F.concat(
            F.col("failed_count").cast("string"),
            F.lit(f" duplicate key rows found for {list(rule.columns)}"),
        )
    return _result(counted, rule, message)


def _relation_result(child: DataFrame, rule: RelationRule) -> DataFrame:
    if rule.child_column not in child.columns or rule.parent_column not in rule.parent.columns:
        total = F.count(F.lit(1))
        counted = child.agg(total.alias("failed_count"), total.alias("total_count"))
        message = F.lit(
            f"Missing relationship columns: {rule.child_column}, {rule.parent_column}"
        )
    else:
        counted = orphan_rows(child, rule.child_column, rule.parent, rule.parent_column)
        message = F.concat(
            F.col("failed_count").cast("string"),
            F.lit(f" orphan rows found for {rule.child_column} -> {rule.parent_column}"),
        )
    return _result(counted, rule, message)


def _result(counted: DataFrame, rule: KeyRule | RelationRule, message: Column) -> DataFrame:
    entry = _entry(rule.rule_name, rule.severity, F.col("failed_count"), message)
    return counted.select(entry.alias("r")).select("r.*")


def _entry(name: str, severity: str, failed: Column, message: Column) -> Column:
    return F.struct(
        F.lit(name).alias("rule_name"),
        F.lit(severity).alias("severity"),
        (failed == 0).alias("passed"),
        failed.cast("bigint").alias("failed_count"),
        F.col("total_count").cast("bigint").alias("total_count"),
        message.alias("message"),
    )


def severity_rollup(results: DataFrame) -> DataFrame:
    """One row: rules checked, critical and warning failures, and the overall verdict."""
    def failures(level: str) -> Column:
        return F.count_if(~F.col("passed") & (F.col("severity") == level))

    return results.agg(
        F.count(F.lit(1)).alias("rules_checked"),
        failures(CRITICAL).alias("critical_failures"),
        failures(WARNING).alias("warning_failures"),
        (failures(CRITICAL) == 0).alias("passed"),
    )
