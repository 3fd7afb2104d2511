"""Session helpers: settings every plan of the package relies on."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readweave.errors import OptionError


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    A cluster names a folder all executors share in ``spark.checkpoint.dir``. Only a local
    master, whose executors are this process, gets a temporary folder where neither the setting
    nor the context has one; anywhere else a missing folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise OptionError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="readweave-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however many later expressions and filters use them.

    A projection may be folded into every place that reads it, and repeats what it holds there; a
    generator is not folded. It stays within generated code and moves no rows.
    """
    packed = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")
    return df.select("*", packed).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("__once")[n].alias(n) for n in columns])


def with_place(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Number the rows from 1 in their order, or in ``order``, without bringing them into one task.

    The ordered rows are written once; each part of them counts its own and starts after those of
    the parts before it (one row per part, hence a broadcast as small as the number of tasks).
    """
    rows = cut(df.orderBy(*order) if order else df).withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumn("__part", F.shiftright("__id", 33))
    ends = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(starts), "__part").select(*df.columns, place.alias(name))


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers of all executors, once per Spark context.

    Functions that run in workers are found by import there, so their caches last from task to task.
    """
    sc = spark.sparkContext
    if getattr(sc, "_readweave_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="readweave-"), "readweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("readweave", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._readweave_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
