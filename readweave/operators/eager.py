"""Aggregation over a join whose keys are skewed, by eager aggregation of both inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_join_aggregate(
    left: DataFrame, right: DataFrame, on: str, right_on: str, group_by: Sequence[str], value: str, right_value: str | None = None,
    how: str = "left", weight: str | None = None, right_weight: str | None = None, splits: int = 16,
) -> DataFrame:
    """Sum and count ``left JOIN right`` per group without joining single rows.

    Both inputs are reduced to compact states per join key first (the left one per join key
    and group), the states are joined, and the joined measures follow algebraically: the sum
    of the left value is ``left sum * right rows``, the number of joined rows is ``left rows *
    right rows``, the sum of a right value is ``left rows * right sum``. A roll-up to
    ``group_by`` ends it. A key holding a third of the rows reaches the shuffle as at most one
    state per map task and group. The states of one key over many groups are spread over
    ``splits`` parts, to each of which the key's one right state is sent, so neither the
    aggregation nor the join leaves a key to one task. An input may hold states already:
    ``weight`` names the column that says how many rows each of its rows stands for.

    Result: the group columns; ``left_rows`` and ``left_total``, the group's own rows and sum; and
    of the join ``n_rows``, ``total`` and, with ``right_value``, ``right_total``, as decimals, since
    products outgrow 64 bits. Null values count as 0. Null groups are groups. A null join key
    matches nothing: with ``how="left"`` its rows count once, with ``"inner"`` they fall away.
    Empty inputs give an empty result. Only the named columns are read, so further columns of
    any name do no harm.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")

    def number(df: DataFrame, name: str | None, default: int) -> Column:
        return F.coalesce(df[name], F.lit(0)).cast("bigint") if name else F.lit(default).cast("bigint")

    groups = [f"__g{i}" for i in range(len(group_by))]
    left_states = (
        left.select(left[on].alias("__k"), *[left[g].alias(a) for g, a in zip(group_by, groups)], number(left, value, 0).alias("__v"), number(left, weight, 1).alias("__w"))
        .groupBy("__k", *groups)
        .agg(F.sum("__v").alias("__s"), F.sum("__w").alias("__n"))
        .withColumn("__split", F.pmod(F.xxhash64(*groups), F.lit(splits)).cast("int"))
    )
    right_states = (
        right.where(right[right_on].isNotNull())
        .select(right[right_on].alias("__k"), number(right, right_value, 0).alias("__v"), number(right, right_weight, 1).alias("__w"))
        .groupBy("__k")
        .agg(F.sum("__w").alias("__m"), F.sum("__v").alias("__rs"))
        .withColumn("__split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    )
    joined = left_states.join(right_states, ["__k", "__split"], how)
    wide = lambda name, default: F.coalesce(F.col(name), F.lit(default)).cast("decimal(19,0)")
    out = joined.groupBy(*groups).agg(
        F.sum("__n").alias("left_rows"), F.sum("__s").alias("left_total"),
        F.sum(wide("__n", 0) * wide("__m", 1)).alias("n_rows"),
        F.sum(wide("__s", 0) * wide("__m", 1)).alias("total"),
        F.sum(wide("__n", 0) * wide("__rs", 0)).alias("right_total"),
    )
    names = [F.col(a).alias(g) for g, a in zip(group_by, groups)]
    return out.select(*names, "left_rows", "left_total", "n_rows", "total", *(["right_total"] if right_value else []))
