"""Records of the counts table: one row per rec_id however often it was delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQUENCES = ("forward", "reverse", "region1", "region2")


def clean_sequence(col: Column) -> Column:
    """A sequence without surrounding blanks and in upper case; null stays null."""
    return F.upper(F.trim(col))


def distinct_records(expected: DataFrame, *columns: str) -> DataFrame:
    """``rec_id`` and the named columns, once per record.

    Redeliveries carry the same content, so the records are the distinct rows of the
    columns in use: a hash aggregate whose map side already drops repeats of hot keys, and
    whose shuffle is keyed by rec_id (unique keys, hence even). Sequences are cleaned, a
    null cnt is 0. Rows without rec_id identify no record and are left out. An empty table
    gives an empty result; further columns are pruned at the scan.
    """
    picked = []
    for name in columns:
        col = expected[name]
        if name in SEQUENCES:
            col = clean_sequence(col)
        elif name == "cnt":
            col = F.coalesce(col, F.lit(0)).cast("bigint")
        picked.append(col.alias(name))
    rows = expected.where(expected["rec_id"].isNotNull()).select(expected["rec_id"], *picked)
    return rows.dropDuplicates()
