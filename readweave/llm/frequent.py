"""Most frequent values of text columns by external sort and run-length counting."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.session import shuffle_partitions

_RUNS = "field string, value string, n bigint"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of equal (field, value) within each batch, before anything is shuffled."""
    for batch in batches:
        t = pa.table({"field": batch.column(0), "value": batch.column(1)}).group_by(["field", "value"]).aggregate([([], "count_all")])
        yield pa.RecordBatch.from_arrays(
            [c.combine_chunks().cast(k) for c, k in zip((t["field"], t["value"], t["count_all"]), (pa.string(), pa.string(), pa.int64()))],
            ["field", "value", "n"],
        )


def _heap_of_range(keep: int):
    """Run lengths of one sorted range; the ``keep`` longest of each field survive.

    Runs at the range's ends survive as well: they may go on in a neighbouring range. A row
    with a null value carries the field's rows in this range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list] = {}
        totals: dict[str, int] = {}
        edges: list[tuple] = []
        first = True
        current, count = None, 0

        def close() -> None:
            nonlocal first
            field, value = current
            totals[field] = totals.get(field, 0) + count
            if first:
                edges.append((field, value, count))
                first = False
                return
            heap = heaps.setdefault(field, [])
            if len(heap) < keep:
                heapq.heappush(heap, (count, value))
            elif count > heap[0][0]:
                heapq.heapreplace(heap, (count, value))

        for batch in batches:
            t = pa.table({"field": batch.column(0), "value": batch.column(1), "n": batch.column(2)})
            # runs of one batch, in order; equal neighbours across batches are merged below
            t = t.group_by(["field", "value"], use_threads=False).aggregate([("n", "sum")])
            for field, value, n in zip(t["field"].to_pylist(), t["value"].to_pylist(), t["n_sum"].to_pylist()):
                if current == (field, value):
                    count += n
                else:
                    if current is not None:
                        close()
                    current, count = (field, value), n
        if current is not None:
            last = (*current, count)
            totals[current[0]] = totals.get(current[0], 0) + count
            edges.append(last)
        rows = edges + [(f, v, n) for f, heap in heaps.items() for n, v in heap] + [(f, None, n) for f, n in totals.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["field", "value", "n"]
            )

    return run


def most_frequent(df: DataFrame, columns: Sequence[str], k: int, partitions: int | None = None) -> DataFrame:
    """Exact counts of the most frequent values of each text column, within bounded memory.

    Batches are combined to (value, count) before the shuffle, so a value holding a third of
    the rows moves as one row per batch; the combined rows are range-partitioned by value and
    sorted (Spark's sort spills), equal neighbours are merged to runs, and each range keeps a
    heap of ``k`` runs per column plus its two edge runs, which may continue next door. The
    survivors' counts are added up. Any value among the k most frequent survives: its complete
    run is among the k longest of its range, or its parts are edge runs.

    Result: ``field`` (column name), ``value``, ``n`` and ``rows`` (the column's non-null rows)
    of at least the k most frequent values per column; the caller ranks or cuts them. Nulls are
    not values; '' is one. Repeated rows count. An empty column gives no row.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), df[c].cast("string").alias("value")) for c in columns])).alias("x")
    ).select("x.field", "x.value").where(F.col("value").isNotNull())
    runs = (
        long.mapInArrow(_combine, _RUNS)
        .repartitionByRange(n, "field", "value")
        .sortWithinPartitions("field", "value")
        .mapInArrow(_heap_of_range(k), _RUNS)
    )
    # at most k + 3 rows per range and column come this far. What tells totals from values is an aggregate, below which
    # no filter is pushed, so that both are read from one shuffle and the ranges are gone through once
    merged = runs.groupBy("field", "value").agg(F.sum("n").alias("n"), F.max(F.col("value").isNull()).alias("__total"))
    totals = merged.where("__total").select(F.col("field"), F.col("n").alias("rows"))
    return merged.where("not __total").join(totals, "field").select("field", "value", "n", "rows")


def frequent_from_share(df: DataFrame, columns: Sequence[str], per_mille: int, partitions: int | None = None) -> DataFrame:
    """Values that hold at least ``per_mille`` thousandths of their column's non-null rows.

    At most 1000 / per_mille values can, which bounds the heaps; the share is compared in integers.
    """
    if per_mille <= 0:
        raise ValueError("per_mille must be positive")
    found = most_frequent(df, columns, 1000 // per_mille + 1, partitions)
    return found.where(F.col("n") * 1000 >= F.col("rows") * per_mille)
