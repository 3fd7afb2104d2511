"""Joins to lookup tables that no hot key brings into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that more than one row in HOT has is hot; there are fewer than HOT of them.
HOT = 1024


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key and in column ``n`` the number of rows of that key.

    The keys that more than one row in HOT has are fewer than HOT whatever the size of the input:
    they are broadcast, so their rows stay where they are. To the other keys' join no key brings
    more than that share. Keys with a null match nothing; with ``how="left"`` their rows stay, with
    nulls. Empty inputs give an empty result.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    told = [c for c in table.columns if c not in on]
    every = table.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).scalar()
    hot = table.where(F.col(n) * HOT > every).withColumn("__hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), list(on), "left")
    found = tagged.where("__hot").select(*rows.columns, *told)
    rest = tagged.where(F.col("__hot").isNull()).select(*rows.columns).join(table, list(on), how)
    return found.unionByName(rest.select(*rows.columns, *told))
