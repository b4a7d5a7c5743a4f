"""Column functions. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Memory tiers in MB, and the share of a tier a job may fill.
MEMORY_TIERS_MB = [128, 256, 512, 1024, 1536, 2048, 3008, 4096]
TIER_FILL = 0.8


def as_date(ts: Column) -> Column:
    return ts.cast("date")


def day_start(ts: Column) -> Column:
    """Truncate to the day. By way of the date: ``date_trunc`` would go through a zoned type."""
    return ts.cast("date").cast("timestamp_ntz")


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def round2(value: Column) -> Column:
    return F.round(value, 2)


def total(value: Column) -> Column:
    return F.sum(value)


def mean(value: Column) -> Column:
    return F.avg(value)


def cents(amount: Column) -> Column:
    """A computed amount rounded to cents. Noise below a millionth goes first, so that half a cent goes up in any task order."""
    return F.round(F.round(amount, 6), 2)


def money_sum(value: Column) -> Column:
    return cents(F.sum(value))


def matches(value: Column, pattern: str) -> Column:
    """Regex match. A closing ``$`` must not match before a last newline, so it becomes ``\\z``."""
    if pattern.endswith("$") and not pattern.endswith(r"\$"):
        pattern = pattern[:-1] + r"\z"
    return value.rlike(pattern)


def label_of(code: Column, labels: Mapping[int, str], default: str = "Other") -> Column:
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def slug(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit(" "), F.lit("_"))


def contains_any(value: Column, words: Sequence[str]) -> Column:
    return F.lower(value).rlike("|".join(re.escape(word) for word in words))


def modulo(value: Column, divisor: int) -> Column:
    return value % divisor


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1000.0)


def array_map(arr: Column, step) -> Column:
    return F.transform(arr, step)


def array_bucket(arr: Column, divisor: int, rest: int) -> Column:
    return F.filter(arr, lambda x: x % divisor == rest)


def array_join(*arrs: Column) -> Column:
    return F.concat(*arrs)


def encode_rows(rows: Column) -> Column:
    return F.to_json(rows)


def decode_rows(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def open_end() -> Column:
    """The end time of a run that has not ended."""
    return F.lit(None).cast("timestamp_ntz")


def chain_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each one followed by a zero byte."""
    pieces = [p for part in parts for p in (F.coalesce(part.cast("string"), F.lit("")), F.lit("\0"))]
    return F.sha2(F.concat(*pieces), 256)


def memory_tier(peak_mb: Column) -> Column:
    """Smallest tier that keeps headroom above the peak; the top tier takes the rest."""
    ladder = F.when(peak_mb <= MEMORY_TIERS_MB[0] * TIER_FILL, MEMORY_TIERS_MB[0])
    for tier in MEMORY_TIERS_MB[1:]:
        ladder = ladder.when(peak_mb <= tier * TIER_FILL, tier)
    return ladder.otherwise(MEMORY_TIERS_MB[-1])


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(operator.and_, conditions)
