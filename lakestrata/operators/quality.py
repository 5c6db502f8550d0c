"""Data-quality checks with failure rates, thresholds and actions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestrata.functions.text import glob_regex
from lakestrata.session import materialize

# Column-name fragments and the condition their columns must meet.
CHECK_RULES = {"amount": ">= 0", "quantity": ">= 0", "rate": ">= 0 AND <= 1"}

# Names that must not be NULL and names that must be unique.
NOT_NULL_GLOBS = ("*_id", "*_key", "dt", "etl_time", "*_sk", "*_bk")
UNIQUE_GLOBS = ("*_sk", "*_bk")


@dataclass(frozen=True)
class Check:
    """One rule over a table.

    ``kind`` is null_check, range_check, uniqueness or expression. A row fails when the rule is not
    true for it, NULL included. The check passes while failed rows / all rows <= ``threshold``; an
    empty table passes. ``action`` says what a failed check does: fail, warn or skip.
    """

    check_id: str
    kind: str
    columns: tuple[str, ...] = ()
    expression: str = ""
    low: object = None
    high: object = None
    threshold: float = 0.0
    action: str = "fail"


class DataQualityError(Exception):
    """A check with action ``fail`` did not pass."""


def failing(check: Check) -> Column:
    """True on rows that break a row-level check."""
    if check.kind == "null_check":
        broken = F.lit(False)
        for c in check.columns:
            broken = broken | F.col(c).isNull()
        return broken
    if check.kind == "range_check":
        (c,) = check.columns
        return ~F.coalesce(F.col(c).between(F.lit(check.low), F.lit(check.high)), F.lit(False))
    if check.kind == "expression":
        return ~F.coalesce(F.expr(check.expression), F.lit(False))
    raise ValueError(f"{check.kind!r} is not a row-level check")


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One report row per check.

    All row-level checks share one pass over the columns they use. A uniqueness check counts per
    key before its shuffle; its failed rows are those whose key occurs more than once.
    """
    row_level = [c for c in checks if c.kind != "uniqueness"]
    parts = []
    if row_level:
        found = [
            F.struct(*_labels(c), F.count("*").alias("total"), F.count_if(failing(c)).alias("failed")) for c in row_level
        ]
        parts.append(df.agg(F.array(*found).alias("f")).select(F.inline("f")))
    for c in checks:
        if c.kind == "uniqueness":
            per_key = df.groupBy(*c.columns).agg(F.count("*").alias("n"))
            total = F.coalesce(F.sum("n"), F.lit(0)).alias("total")
            failed = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("failed")
            parts.append(per_key.agg(*_labels(c), total, failed))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    rate = F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    scored = report.withColumn("failed_rate", rate)
    return scored.withColumn("passed", F.col("failed_rate") <= F.col("threshold"))


def _labels(c: Check) -> list[Column]:
    return [
        F.lit(c.check_id).alias("check_id"),
        F.lit(c.kind).alias("check_type"),
        F.lit(",".join(c.columns)).alias("column_name"),
        F.lit(float(c.threshold)).alias("threshold"),
        F.lit(c.action).alias("action"),
    ]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def enforce(
    df: DataFrame, checks: Sequence[Check], publish: Callable[[DataFrame], None] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run the checks, publish the report, then act on it; returns (passing, quarantined) rows.

    A failed ``fail`` check raises, after the report is out. A failed ``warn`` check stays in the
    report. Rows that break a failed ``skip`` check go to the quarantined frame. They are flagged in one pass and written once;
    both frames read what was written.
    """
    report = run_checks(df, checks)
    if publish:
        publish(report)
    outcome = {r["check_id"]: r["passed"] for r in report.select("check_id", "passed").collect()}  # one row per check
    broken = [c for c in checks if not outcome[c.check_id]]
    fatal = [c.check_id for c in broken if c.action == "fail"]
    if fatal:
        raise DataQualityError(f"failed checks: {', '.join(fatal)}")
    flagged = df.withColumn("_bad", F.lit(False))
    for i, c in enumerate(c for c in broken if c.action == "skip"):
        if c.kind != "uniqueness":
            flagged = flagged.withColumn("_bad", F.col("_bad") | failing(c))
            continue
        repeated = duplicate_keys(df, c.columns).select(
            *[F.col(k).alias(f"_k{i}_{j}") for j, k in enumerate(c.columns)], F.lit(True).alias(f"_dup{i}")
        )
        same = F.lit(True)
        for j, k in enumerate(c.columns):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}_{j}"))
        flagged = flagged.join(repeated, same, "left").withColumn("_bad", F.col("_bad") | F.coalesce(F.col(f"_dup{i}"), F.lit(False)))
    split = materialize(flagged.select(*df.columns, "_bad"), "flagged")
    return split.where(~F.col("_bad")).select(*df.columns), split.where("_bad").select(*df.columns)


def convention_checks(columns: Sequence[str], rules: Mapping[str, str] = CHECK_RULES) -> list[Check]:
    """Expression checks for the columns whose name contains a rule's fragment.

    Each side of an AND applies to the column, so ``>= 0 AND <= 1`` is a full range.
    """
    checks = []
    for fragment, rule in rules.items():
        for c in columns:
            if fragment in c.lower():
                condition = " AND ".join(f"`{c}` {part.strip()}" for part in rule.split("AND"))
                checks.append(Check(f"check.{fragment}.{c}", "expression", (c,), condition))
    return checks


def not_null_checks(columns: Sequence[str], globs: Sequence[str] = NOT_NULL_GLOBS) -> list[Check]:
    """NULL checks for the columns whose name fits a pattern."""
    import re

    patterns = [re.compile(glob_regex(g)) for g in globs]
    return [Check(f"not_null.{c}", "null_check", (c,)) for c in columns if any(p.match(c.lower()) for p in patterns)]


def verify_table(df: DataFrame, expected_rows: int | None = None, expected_columns: Sequence[str] = ()) -> list[str]:
    """Messages for a wrong row count or missing columns; names compare exactly."""
    problems = []
    if expected_rows is not None:
        actual = df.count()
        if actual != expected_rows:
            problems.append(f"expected {expected_rows} rows, found {actual}")
    missing = sorted(set(expected_columns) - set(df.columns))
    if missing:
        problems.append(f"missing columns: {', '.join(missing)}")
    return problems


def verify_query(spark: SparkSession, sql: str, expected_columns: Sequence[str] = ()) -> list[str]:
    """Expected columns a query does not return. The query is analysed, not run; case is ignored."""
    returned = {f.name.lower() for f in spark.sql(sql).schema.fields}
    return sorted(c for c in expected_columns if c.lower() not in returned)


def produced_rows(df: DataFrame) -> bool:
    """Whether a job produced anything; stops at the first row."""
    return not df.isEmpty()


def _is_exact(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DecimalType, T.IntegralType))


def _in_full(c: str, kind: T.DataType) -> Column:
    """A measure as it is summed: decimals in their own scale, integers as decimals, all else as doubles."""
    return F.col(c).cast("decimal(20,0)") if isinstance(kind, T.IntegralType) else F.col(c) if _is_exact(kind) else F.col(c).cast("double")


def reconcile(detail: DataFrame, summary: DataFrame, measures: Mapping[str, str], tolerance: float = 1e-9) -> DataFrame:
    """Totals of detail measures against the summary columns that should add up to them.

    No row is rounded. Decimals and integers must agree exactly. Where a side is a double, whose sum depends on the
    order of rows, totals may differ by ``tolerance`` times the larger sum of absolute values; NaN agrees with NaN. All totals
    are listed as doubles if one measure has a double, but each is judged in its own type.
    """
    exact = {m: _is_exact(detail.schema[m[0]].dataType) and _is_exact(summary.schema[m[1]].dataType) for m in measures.items()}
    sides = []
    for side, df, at in (("d", detail, 0), ("s", summary, 1)):
        sums = []
        for i, m in enumerate(measures.items()):
            value = _in_full(m[at], df.schema[m[at]].dataType)
            value = value if exact[m] else value.cast("double")
            sums += [F.sum(value).alias(f"{side}{i}"), F.sum(F.abs(value)).alias(f"{side}{i}_size")]
        sides.append(df.agg(*sums))
    both = sides[0].crossJoin(sides[1])  # one row each
    scale = max([f.dataType.scale for f in both.schema.fields if isinstance(f.dataType, T.DecimalType)], default=0)
    listed = T.DecimalType(38, scale) if all(exact.values()) else T.DoubleType()
    found = []
    for i, m in enumerate(measures.items()):
        d, s = F.col(f"d{i}"), F.col(f"s{i}")
        balanced = d.eqNullSafe(s)
        if not exact[m]:
            size = F.greatest(f"d{i}_size", f"s{i}_size")
            close = F.abs(d - s) <= F.lit(tolerance) * size
            balanced = balanced | F.coalesce(close & (size < float("inf")), F.lit(False))
        totals = (d.cast(listed).alias("detail_total"), s.cast(listed).alias("summary_total"))
        found.append(F.struct(F.lit(m[0]).alias("measure"), *totals, balanced.alias("balanced")))
    return both.select(F.inline(F.array(*found)))
