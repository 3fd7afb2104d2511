"""Counts of distinct region combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.operators.spec import LibrarySpec


def count_combinations(extracted: DataFrame, regions: list[str], full_seq: bool, weight: str | None = None) -> DataFrame:
    """Reads per (group, optional read sequences, regions): one hash aggregate that combines map-side.

    ``f_seq`` and ``r_seq`` are null without ``full_seq``. Null regions are regions not seen."""
    keys = [F.col("f_seq") if full_seq else F.lit(None).cast("string").alias("f_seq")]
    keys.append(F.col("r_seq") if full_seq and "r_seq" in extracted.columns else F.lit(None).cast("string").alias("r_seq"))
    n = F.sum(weight) if weight else F.count(F.lit(1))
    picked = extracted.select("grp", *[k.alias(a) for k, a in zip(keys, ("f_seq", "r_seq"))], *regions, *([weight] if weight else []))
    return picked.groupBy("grp", "f_seq", "r_seq", *regions).agg(n.cast("bigint").alias("count"))


def preaggregate_reads(reads: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct reads with their number ``n``: extraction then runs once per distinct single-end read."""
    return reads.groupBy(*keep).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """One table of counts from several, each with all columns but ``count`` as key."""
    out = parts[0]
    for p in parts[1:]:
        if p.columns != out.columns:
            raise ValueError("the tables differ in their columns")
        out = out.unionByName(p)
    keys = [c for c in out.columns if c != "count"]
    return out.groupBy(*keys).agg(F.sum("count").cast("bigint").alias("count"))


def observed_regions(combinations: DataFrame, spec: LibrarySpec) -> DataFrame:
    """Distinct (region_id, seq, kind, split) over all regions: what has to be looked up."""
    ids = [r.id for r in spec.variable]
    parts = F.array(*[F.struct(F.lit(i).alias("region_id"), F.col(f"reg_{i}").alias("r")) for i in ids])
    # the counts are asked for although every one is above 0, so that this reading of the
    # combinations is the same as any other and Spark makes them once
    rows = combinations.where("count > 0").select(F.explode(parts).alias("x")).where(F.col("x.r").isNotNull())
    return rows.select("x.region_id", "x.r.seq", "x.r.kind", "x.r.split").dropDuplicates()
