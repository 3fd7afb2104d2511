"""Read filters: the first rule a read breaks is its reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.errors import OptionError
from readweave.functions.exprs import mean_quality

#: The reasons in the order they are tested.
REASONS = ("empty_read", "short_read", "long_read", "low_mean_quality", "bad_alignment")


@dataclass(frozen=True)
class FilterConfig:
    """Thresholds; None leaves a rule out."""

    filter_empty: bool = True
    min_length: int | None = None
    max_length: int | None = None
    min_quality: float | None = None
    min_forward_score: int | None = None
    min_reverse_score: int | None = None


def filter_reason(config: FilterConfig, paired: bool) -> Column:
    """Null for reads to keep. The two length rules and quality compare strictly; either read of a pair can break a rule."""
    sides = ["f", "r"] if paired else ["f"]
    length = {s: F.length(f"{s}_seq") for s in sides}

    def any_side(test) -> Column:
        out = test(sides[0])
        for s in sides[1:]:
            out = out | test(s)
        return out

    rules: list[tuple[Column, str]] = []
    if config.filter_empty:
        rules.append((any_side(lambda s: length[s] == 0), "empty_read"))
    if config.min_length is not None:
        rules.append((any_side(lambda s: length[s] < config.min_length), "short_read"))
    if config.max_length is not None:
        rules.append((any_side(lambda s: length[s] > config.max_length), "long_read"))
    if config.min_quality is not None:
        rules.append((any_side(lambda s: mean_quality(f"{s}_qual") < F.lit(config.min_quality).cast("float")), "low_mean_quality"))
    reason = F.lit(None).cast("string")
    for test, name in reversed(rules):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    return reason


def with_reason(reads: DataFrame, config: FilterConfig) -> DataFrame:
    """Add ``reason``. A read pair whose reverse read is null counts as single."""
    paired = "r_seq" in reads.columns
    single = filter_reason(config, False)
    reason = F.when(F.col("r_seq").isNull(), single).otherwise(filter_reason(config, True)) if paired else single
    return reads.withColumn("reason", reason)


def alignment_reason(config: FilterConfig, f_score: Column, r_score: Column | None) -> Column:
    """``bad_alignment`` where a score lies below its threshold."""
    bad = F.lit(False)
    if config.min_forward_score is not None:
        bad = bad | (f_score < config.min_forward_score)
    if config.min_reverse_score is not None and r_score is not None:
        bad = bad | (r_score < config.min_reverse_score)
    return F.when(bad, F.lit("bad_alignment"))


def alignment_threshold(expected_score: int, tolerance: float) -> int:
    """The least score kept: the expected one times the tolerance in single precision, cut to an integer."""
    import numpy as np

    if not 0 <= tolerance <= 1:
        raise OptionError(f"alignment tolerance must lie between 0 and 1, not {tolerance}")
    return int(np.float32(expected_score) * np.float32(tolerance))


def filtered_counts(dropped: DataFrame, weight: str | None = None) -> DataFrame:
    """Dropped reads per sequence pair and group, with one column per reason and their share of all dropped.

    The total is one row, taken as a scalar; the counts combine map-side.
    """
    n = F.col(weight) if weight else F.lit(1)
    each = [F.sum(F.when(F.col("reason") == r, n).otherwise(0)).cast("bigint").alias(r) for r in REASONS]
    out = dropped.groupBy("grp", "f_seq", "r_seq").agg(F.sum(n).cast("bigint").alias("count"), *each)
    total = out.agg(F.sum("count").alias("t")).scalar()
    return out.select(
        F.col("grp").alias("group"), F.col("f_seq").alias("forward"), F.col("r_seq").alias("reverse"), "count",
        (F.col("count") / F.nullif(total, F.lit(0))).alias("proportion"), *REASONS,
    )
