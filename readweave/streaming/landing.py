"""Counts over a folder in which read tables keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.operators.extract import ExtractOptions, extract, region_columns
from readweave.operators.filters import FilterConfig, with_reason
from readweave.operators.spec import LibrarySpec


def stream_counts(
    spark: SparkSession, folder: str, schema: str, spec: LibrarySpec | None = None, options: ExtractOptions = ExtractOptions("inframe"),
    config: FilterConfig = FilterConfig(), paired: bool = False,
) -> DataFrame:
    """A streaming table of counts per group and region combination, to be written in complete or update mode.

    Files are parquet tables of reads; the state is one row per combination."""
    reads = spark.readStream.schema(schema).parquet(folder)
    kept = with_reason(reads, config).where(F.col("reason").isNull()).drop("reason")
    names = region_columns(spec) if options.mode != "full-read" else []
    extracted = extract(kept, spec if names else None, options, paired, config)
    keys = names or [c for c in ("f_seq", "r_seq") if c in extracted.columns]
    return extracted.groupBy("grp", *keys).agg(F.count(F.lit(1)).alias("count"))
