"""The four output tables, and their TSV files."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.errors import OptionError
from readweave.functions.exprs import region_text
from readweave.operators.classify import combination_columns, variants_column
from readweave.operators.library import MATCH, MULTI, OVER
from readweave.session import with_place

OUTPUTS = ("counts", "library_counts", "summary", "filtered")


def counts_table(classified: DataFrame, region_ids: Sequence[str], compared: bool, with_variants: bool = True) -> DataFrame:
    """The counts output: one row per group and combination, in the order of its columns."""
    columns: list[Column] = [F.col("grp").alias("group"), F.col("f_seq").alias("forward"), F.col("r_seq").alias("reverse")]
    none = F.lit(None).cast("string")
    for r in region_ids:
        reg = F.col(f"reg_{r}")
        columns.append(region_text(reg).alias(r))
        m = F.col(f"match_{r}") if compared else None
        shown = m["match"].isin(MATCH, MULTI) if compared else None
        columns.append((F.when(shown, F.array_join(m["hits"], ",")) if compared else none).alias(f"{r}_nearest"))
        if with_variants:
            columns.append((variants_column(r) if compared else none).alias(f"{r}_variants"))
        columns.append((F.when(shown | (m["match"] == OVER), m["distance"]) if compared else none.cast("bigint")).alias(f"{r}_distance"))
        columns.append((F.when(reg.isNotNull(), m["n_matches"]) if compared else none.cast("bigint")).alias(f"{r}_n_matches"))
    if compared:
        columns += combination_columns()
    else:
        columns += [F.lit("uncompared").alias("combination_status"), none.cast("bigint").alias("combination_distance"),
                    none.cast("bigint").alias("combinations_in_library"), none.alias("combination_id")]
    return classified.select(*columns, F.col("count"))


#: Parts over which the groups of one key are spread while its total is joined to them.
SALTS = 16


def sort_by_total(df: DataFrame, count: str = "count", group: str = "group", place: str | None = None) -> DataFrame:
    """Rows by their key's total over all groups, largest first; a key's groups stay together, ties follow the key.

    A total is one row per key, sent to each of SALTS parts of the key's groups, so that a key with very many groups is
    no task of its own. ``place`` names a column for the row's number in that order."""
    drop = (count, group, "proportion", "empty_read", "short_read", "long_read", "low_mean_quality", "bad_alignment")
    keys = [c for c in df.columns if c not in drop]
    rows = df.withColumn("__key", F.struct(*keys)).withColumn("__salt", F.pmod(F.xxhash64(group), F.lit(SALTS)).cast("int"))
    totals = rows.groupBy("__key").agg(F.sum(count).alias("__total")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(totals, ["__key", "__salt"]).select(*df.columns, "__total")
    order = [F.desc("__total"), *[F.asc_nulls_first(k) for k in keys], F.asc_nulls_first(group)]
    if place is None:
        return rows.orderBy(*order).drop("__total")
    return with_place(rows, place, *order).drop("__total")


def _cell(value, decimals: int | None) -> str:
    if value is None:
        return ""
    if isinstance(value, float):
        return f"%.{decimals}f" % float(np.float32(value)) if decimals is not None else repr(value)
    return str(value)


def write_tsv(df: DataFrame, path: str, decimals: int | None = 4) -> None:
    """One tab-separated file with header, streamed partition by partition through the driver."""
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write("\t".join(df.columns) + "\n")
        for row in df.toLocalIterator(prefetchPartitions=True):
            out.write("\t".join(_cell(v, decimals) for v in row) + "\n")


def write_parts(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Tab-separated part files written by the executors: the way for outputs beyond one machine."""
    df.write.csv(folder, sep="\t", header=True, emptyValue="", nullValue="", quote="\u0000", mode="overwrite" if overwrite else "errorifexists")


def output_paths(base: str, parts: bool = False) -> dict[str, str]:
    """Where each output goes: a file, or with ``parts`` a folder of part files."""
    return {name: f"{base}.{name}" + ("" if parts else ".tsv") for name in OUTPUTS}


def guard_outputs(base: str, overwrite: bool, parts: bool = False) -> None:
    """Refuse to start if an output exists and may not be overwritten. Folders on other file systems are guarded by the writer."""
    there = [p for p in output_paths(base, parts).values() if os.path.exists(p)]
    if there and not overwrite:
        raise OptionError(f"output exists: {', '.join(there)}")
