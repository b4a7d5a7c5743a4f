"""One-pass scan for sensitive columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions import contains_any, round2
from tableflow.operators.aggregates import match_ratios
from tableflow.sources.scan import describe_table

# The value patterns, the words that make a column name
# suspicious, and the share of values that confirms a pattern.
VALUE_PATTERNS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone_number": r"^\+?1?[-. (]*\d{3}[-. )]*\d{3}[-. ]*\d{4}$",
    "ssn_like": r"^\d{3}-\d{2}-\d{4}$",
    "credit_card_like": r"^\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
}
NAME_HINTS = ["email", "phone", "ssn", "social", "name", "address", "dob", "birth", "card", "account"]
CONFIRM_SHARE = 0.5

# The verdicts; {n} is a number of columns.
VERDICT_CONFIRMED = (
    "{n} column(s) match a sensitive-data pattern -- treat this file as restricted before sharing it anywhere"
)
VERDICT_HINT = (
    "no confirmed pattern matches, but {n} column name(s) hint at something sensitive -- worth a manual look"
)
VERDICT_CLEAN = "no sensitive-looking columns found by these checks (not a guarantee)"


def profile(df: DataFrame) -> DataFrame:
    """Columns with types and the row count of the table."""
    n = df.agg(F.count(F.lit(1)).alias("row_count")).scalar()
    return describe_table(df).withColumn("row_count", n)


def scan_sensitive(df: DataFrame) -> DataFrame:
    """Findings per string column: confirmed patterns with their share, and the name hint.

    All columns and patterns are counted in a single scan. A column with only
    a name hint has one row without a pattern; a column without any value is
    not reported.
    """
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    counts = match_ratios(df, VALUE_PATTERNS, cols).filter("non_null > 0")
    share = F.col("matches") / F.col("non_null")
    hit = share >= CONFIRM_SHARE
    per_column = counts.groupBy("column_name", "position").agg(
        F.collect_list(
            F.when(hit, F.struct("pattern", round2(share).alias("ratio")))
        ).alias("hits"),
        F.first(contains_any(F.col("column_name"), NAME_HINTS)).alias("name_hint"),
    )
    return (
        per_column.filter((F.size("hits") > 0) | F.col("name_hint"))
        .select("column_name", "position", "name_hint", F.inline_outer("hits"))
    )


def triage_report(df: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: confirmed columns, columns worth a look, the patterns found with their ratios, and the verdict."""
    by_column = findings.groupBy("column_name", "position").agg(
        F.count("pattern").alias("n"),
        F.sort_array(F.collect_list(F.struct("pattern", "ratio"))).alias("found"),
    )
    names = by_column.agg(
        _in_order(F.col("n") > 0).alias("confirmed"),
        _in_order(F.col("n") == 0).alias("worth_a_look"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("position", "column_name", "found")))).alias("detail"),
    )
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    sure, maybe = F.size("confirmed"), F.size("worth_a_look")
    verdict = (
        F.when(sure > 0, _filled(VERDICT_CONFIRMED, sure))
        .when(maybe > 0, _filled(VERDICT_HINT, maybe))
        .otherwise(VERDICT_CLEAN)
    )
    return names.select(
        rows.alias("n_rows"),
        F.lit(len(df.columns)).alias("columns_scanned"),
        "confirmed",
        "worth_a_look",
        F.transform("detail", lambda d: F.struct(d.column_name.alias("column_name"), d.found.alias("found"))).alias("detail"),
        verdict.alias("verdict"),
    )


def _filled(text: str, n: Column) -> Column:
    return F.replace(F.lit(text), F.lit("{n}"), n.cast("string"))


def _in_order(cond: Column) -> Column:
    """Names of the matching columns, in table order."""
    picked = F.collect_list(F.when(cond, F.struct("position", "column_name")))
    return F.transform(F.sort_array(picked), lambda c: c.column_name)
