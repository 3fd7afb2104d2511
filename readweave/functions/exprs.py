"""Column expressions over reads and regions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNGROUPED, UNMATCHED = "", "_unmatched_"
#: Bases and their complements.
_BASES, _PAIRED = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, _BASES, _PAIRED))


def read_group(pattern: str | None, read_id: Column, description: Column) -> Column:
    """Group 1 of the first match of ``pattern`` in id and description of the forward read.

    Without a pattern all reads are ungrouped (''); without a match, or if group 1 takes no part
    in it, the group is ``_unmatched_``.
    """
    if pattern is None:
        return F.lit(UNGROUPED)
    if re.compile(pattern).groups < 1:
        return F.lit(UNMATCHED)
    text = F.concat_ws(" ", read_id, description)
    return F.coalesce(F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))), F.lit(UNMATCHED))


@F.arrow_udf(T.FloatType())
def _mean_quality(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        data = part.cast(pa.large_binary())
        bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
        sums = np.r_[0, np.cumsum(raw[: bounds[-1]], dtype=np.int64)] if len(bounds) else np.zeros(1, np.int64)
        lens = np.diff(bounds)
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        with np.errstate(all="ignore"):
            mean = np.where(lens > 0, total.astype(np.float32) / lens.astype(np.float32) - np.float32(33), np.float32(0))
        yield pa.array(mean.astype(np.float32), pa.float32(), mask=np.asarray(part.is_null()))


_MEAN_QUALITY = _mean_quality.asNondeterministic()


def mean_quality(quality: Column | str) -> Column:
    """Mean Phred+33 quality in single precision; 0 for an empty string, null for null.

    Bytes of whole batches are summed at once in Arrow, since Spark has no expression that sums the bytes of a string but
    by a function per letter. Spark may not push it below other steps, where more rows would pay for it."""
    return _MEAN_QUALITY(quality)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing places of two strings of one length; null if the lengths differ."""
    differing = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    count = F.aggregate(differing, F.lit(0), lambda s, v: s + v)
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(count))


#: Bases that fit into one packed number, two bits each.
PACKED = 31


def packed_bases(seq: Column) -> Column:
    """A number of two bits a base of a sequence of at most 31 of A, C, G and T; null for any other."""
    fits = (F.length(seq) <= PACKED) & (F.length(seq) > 0) & (F.translate(seq, "ACGT", "") == "")
    return F.when(fits, F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("bigint"))


def hamming_packed(a: Column, b: Column) -> Column:
    """Number of differing places of two packed sequences of one length, in generated code."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def region(seq: Column, kind: Column | str, split: Column | None = None) -> Column:
    """A found region: its bases, how complete it is, and where two fragments part."""
    return F.struct(
        seq.cast("string").alias("seq"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (split if split is not None else F.lit(None)).cast("int").alias("split"),
    )


COMPLETE, PARTIAL5, PARTIAL3, CENTER, OVERLAP = "complete", "partial_5", "partial_3", "missing_center", "overlapping"
REGION = "struct<seq:string,kind:string,split:int>"


def merge_evidence(f: Column, r: Column, f_quality: Column, r_quality: Column, length: int) -> Column:
    """One region from what the forward and the reverse read show of it.

    Complete evidence beats partial; of two complete ones the better quality wins, of two
    fragments from one end the longer, ties go to the forward read. A fragment from each end
    is joined with a slash: a gap is missing between them, or they overlap, depending on
    ``length``. A fragment longer than ``length`` leaves no room and overlaps.
    """
    fk, rk, fs, rs = f["kind"], r["kind"], f["seq"], r["seq"]
    fl, rl = F.length(fs), F.length(rs)

    def joined(left: Column, right: Column, own: Column, other: Column) -> Column:
        room = F.greatest(F.lit(length) - other, F.lit(0))
        kind = F.when(room >= own, CENTER).otherwise(OVERLAP)
        return region(F.concat(left, F.lit("/"), right), kind, F.length(left))

    return (
        F.when(f.isNull(), r)
        .when(r.isNull(), f)
        .when((fk == COMPLETE) & (rk == COMPLETE), F.when(r_quality > f_quality, r).otherwise(f))
        .when(fk == COMPLETE, f)
        .when(rk == COMPLETE, r)
        .when(fk == rk, F.when(rl > fl, r).otherwise(f))
        .when(fk == PARTIAL5, joined(rs, fs, rl, fl))
        .otherwise(joined(fs, rs, fl, rl))
    )


def region_text(reg: Column) -> Column:
    """How a region is shown: a caret marks the end that is missing."""
    return (
        F.when(reg["kind"] == PARTIAL5, F.concat(F.lit("^"), reg["seq"]))
        .when(reg["kind"] == PARTIAL3, F.concat(reg["seq"], F.lit("^")))
        .otherwise(reg["seq"])
    )
