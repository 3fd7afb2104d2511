"""Filling containers of fixed capacity with whole items: sum-of-squares online packing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.session import cut

#: Lanes of each round: the first must hold what one task can pack at the largest scale, the last joins all that is left.
LANES = (16_384, 128, 1)
#: Share of the capacity from which a container is done; the items of others are packed anew in the next round.
TIGHT = 0.995
#: Rows a batch of results holds, and copies of one row that are numbered together; matters of memory, not of results.
ROWS, COPIES = 50_000, 4_096


class Packer:
    """Sum-of-squares packing of a stream of sizes into containers of one capacity.

    ``levels[h]`` is the number of open containers filled to h. An item of size s goes to the
    level h (0: a new container) for which the sum of squares of the levels afterwards is
    least; among equal ones to the fullest. Full containers are closed.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.fill: list[int] = []

    def place(self, size: int) -> int:
        """The container the item goes to. A size of 0 joins any container, the first if there is one."""
        cap = self.capacity
        if size <= 0:
            if not self.fill:
                self.fill.append(0)
                self.open.setdefault(0, []).append(0)
            return 0
        old = self.levels[: cap - size + 1]
        cost = 2 * self.levels[size : cap + 1] + 1
        cost[-1] = 0  # a full container counts no more
        cost[1:] += 1 - 2 * old[1:]
        cost[1:][old[1:] == 0] = np.iinfo(np.int64).max
        h = len(cost) - 1 - int(cost[::-1].argmin())
        if self.open.get(h):
            number = self.open[h].pop()
            if h:
                self.levels[h] -= 1
        else:
            number = len(self.fill)
            self.fill.append(0)
        level = h + size
        self.fill[number] = level
        if level < cap:
            self.levels[level] += 1
            self.open.setdefault(level, []).append(number)
        return number


_IN = ("lane", "item", "copy", "piece", "start", "size")
_SCHEMA = "lane bigint, item bigint, copy bigint, piece bigint, start bigint, size bigint, container bigint, done boolean"
_ARROW = pa.schema([*[(c, pa.int64()) for c in (*_IN, "container")], ("done", pa.bool_())])


def pack_lanes(capacity: int, least: int):
    """Pack rows that come sorted by lane, every lane as a stream of its own.

    An item above the capacity fills whole containers first. Containers filled to at least
    ``least`` are done. A lane's containers are held until it ends, nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        packer, lane, first = Packer(capacity), None, 0

        def close() -> None:
            fill = packer.fill
            out[first:] = [(*row, fill[row[-1]] >= least) for row in out[first:]]

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _IN)):
                if row[0] != lane:
                    close()
                    while len(out) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[:ROWS]), _ARROW.types)], schema=_ARROW)
                        del out[:ROWS]
                    packer, lane, first = Packer(capacity), row[0], len(out)
                number, item, copy, piece, start, size = row
                while size > capacity:
                    out.append((number, item, copy, piece, start, capacity, packer.place(capacity)))
                    size, piece, start = size - capacity, piece + 1, start + capacity
                out.append((number, item, copy, piece, start, size, packer.place(size)))
        close()
        for at in range(0, len(out), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + ROWS]), _ARROW.types)], schema=_ARROW)

    return run


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows told apart by a number of their own, the same however the table is partitioned."""
    counts = rows.groupBy("item", "size").agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.select("item", "size", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES))).alias("block"))
    inner = F.sequence(F.col("block") * COPIES, F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1)
    return blocks.select("item", "size", F.explode(inner).alias("copy"))


def pack(df: DataFrame, item: str, size: str, capacity: int, lanes: Sequence[int] = LANES, tight: float = TIGHT) -> DataFrame:
    """Assign every item to a container whose sizes add up to at most ``capacity``.

    Items are spread over ``lanes[0]`` lanes by a hash, and each lane is packed as a stream by
    :class:`Packer`. Containers at least ``tight`` full are done. The items of the others are
    packed anew, whole, in the fewer lanes of the next round, each of which joins neighbouring
    ones of the last, until the last round keeps everything. Many lanes over few items thus
    cost no space: their containers are not done and their items meet in a later round. All
    rounds are the same at every size of the input. A lane's task holds its own rows only, and
    the work is linear in the items.

    Result: one row per piece: ``item, piece, start, size, container_id``. Items of at most the
    capacity have one piece; larger ones are cut every ``capacity`` from ``start`` 0 and only
    their last piece shares a container. Null and negative sizes are 0 and share a container
    with others. Repeated items are separate items; null items are kept. The result does not
    depend on the table's partitioning. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    if any(a < b or a % b for a, b in zip(lanes, lanes[1:])) or not lanes or lanes[-1] < 1:
        raise ValueError("every number of lanes must be a multiple of the next")
    wide = lambda name: F.lit(0).cast("bigint").alias(name)
    rows = _numbered(df.select(df[item].cast("bigint").alias("item"), F.greatest(F.coalesce(df[size], F.lit(0)), F.lit(0)).cast("bigint").alias("size")))
    lane = F.pmod(F.xxhash64("item", "size", "copy"), F.lit(lanes[0])).alias("lane")
    todo = rows.select(lane, "item", "copy", wide("piece"), wide("start"), "size")
    parts = []
    for turn, n in enumerate(lanes):
        least = 0 if turn == len(lanes) - 1 else min(int(np.ceil(tight * capacity)), capacity)
        packed = todo.repartition("lane").sortWithinPartitions("lane", F.asc_nulls_last("item"), "copy", "piece").mapInArrow(pack_lanes(capacity, least), _SCHEMA)
        if least:
            packed = cut(packed)  # read twice below, and packed only once
            todo = packed.where("not done").select(F.floor(F.col("lane") / (n // lanes[turn + 1])).alias("lane"), *_IN[1:])
        number = F.lit(turn << 60) + F.shiftleft("lane", 40) + F.col("container")
        parts.append(packed.where("done").select("item", F.col("piece").cast("int").alias("piece"), "start", "size", number.alias("container_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
