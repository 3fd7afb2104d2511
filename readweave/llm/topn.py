"""The N items with the highest score within every group, by descending score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Parts over which the items of one band of a group are spread in the anti-join.
SALTS = 8


def score_band(score: Column) -> Column:
    """The band of a score: its power of two, so at most 130 bands; it never falls as the score rises. Null scores lie lowest."""
    s = score.cast("double")
    return (
        F.when(s.isNull(), F.lit(-2000))
        .when(s > 0, F.floor(F.log2(s)).cast("int") + 1100)
        .when(s == 0, F.lit(0))
        .otherwise(-1100 - F.floor(F.log2(-s)).cast("int"))
    )


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest score of every group; ties go to the smaller item.

    Scores are range-partitioned into bands. A histogram of (group, band), combined map-side
    and at most a band table per group, says from which band on a group is filled by the
    bands above it; rows of filled groups leave by an anti-join on (group, band), which cuts
    a group of millions to its top bands without sorting it. The join is spread over SALTS parts
    of a band by item, so a group whose items share one band is no task of its own. What remains, the boundary bands,
    is ranked exactly by (score descending, item ascending); Spark limits the ranks before the
    shuffle, so ties within a hot group's boundary band stay small as well.

    Result: ``group, item, score, rank``. The input holds one row per (group, item); repeated
    rows compete as rows. The null group is a group, null items come last among ties, null
    scores last of all. Fewer than n rows: all come out. Extra columns are dropped.
    """
    rows = df.select(df[group].alias("group"), df[item].alias("item"), df[score].alias("score"))
    rows = rows.withColumn("__band", score_band(F.col("score")))
    bands = rows.groupBy(F.col("group").alias("__g"), F.col("__band").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    above = Window.partitionBy("__g").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    filled = bands.withColumn("__have", F.sum("__n").over(above)).where(F.col("__have") >= n).select("__g", "__b")
    filled = filled.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("item", "score"), F.lit(SALTS)).cast("int"))
    same = F.col("group").eqNullSafe(F.col("__g")) & (F.col("__band") == F.col("__b")) & (F.col("__salt") == F.col("__s"))
    open_rows = rows.join(filled, same, "left_anti")
    order = Window.partitionBy("group").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("item"))
    return (
        open_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("group", "item", "score", "rank")
    )
