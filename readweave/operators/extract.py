"""Variable regions of reads: whole reads, in frame, by flanks, or by alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readweave.errors import OptionError
from readweave.functions.alignment import KINDS, Scorer, aligned_regions, semiglobal
from readweave.functions.exprs import COMPLETE, PARTIAL3, PARTIAL5, mean_quality, merge_evidence, region, reverse_complement
from readweave.functions.flanks import pattern_regions
from readweave.operators.filters import FilterConfig, alignment_reason, alignment_threshold
from readweave.operators.spec import LibrarySpec
from readweave.session import once

MODES = ("full-read", "inframe", "pattern", "align")
_FOUND = "struct<seq:string,kind:string,split:int,quality:float>"
_ARROW = pa.struct([("seq", pa.string()), ("kind", pa.string()), ("split", pa.int32()), ("quality", pa.float32())])


@dataclass(frozen=True)
class ExtractOptions:
    mode: str = "align"
    pattern_length: int = 10
    pattern_tolerance: int = 1
    scorer: Scorer = Scorer()
    strict_offset: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise OptionError(f"unknown mode {self.mode!r}; one of {', '.join(MODES)}")


def region_columns(spec: LibrarySpec | None) -> list[str]:
    return [] if spec is None else [f"reg_{r.id}" for r in spec.variable]


def _inframe_forward(spec: LibrarySpec, options: ExtractOptions) -> list[Column]:
    """Regions at their template places in the forward read; the first one out of reach ends the row of regions.

    Places count from the start region's offset, which is added as the established results have
    it (it is 0 in every usual construct) or subtracted with ``strict_offset``."""
    offset = spec.position(spec.forward_start_region)[0]
    offset = -offset if options.strict_offset else offset
    n, out, reached = F.length("f_seq"), [], F.lit(True)
    for r in spec.variable:
        start, end = (p + offset for p in spec.position(r.id))
        if start < 0:
            out.append(F.lit(None).cast(_plain()))
            continue
        seq = F.substring("f_seq", start + 1, end - start)
        found = F.when(n > end, region(seq, COMPLETE)).when(n > start, region(seq, PARTIAL3))
        out.append(F.when(reached, found))
        reached = reached & (n > start)
    return out


def _inframe_reverse(spec: LibrarySpec) -> list[tuple[Column, Column]]:
    """Regions counted back from the end of the reverse read in template orientation, and their qualities."""
    far = spec.position(spec.reverse_start_region)[1]
    seq, qual, n = reverse_complement(F.col("r_seq")), F.reverse("r_qual"), F.length("r_seq")
    out = []
    for r in spec.variable:
        start, end = (abs(p - far) for p in spec.position(r.id))
        low = F.greatest(n - start, F.lit(0))
        size = n - end - low
        part, quality = (F.substr(c, low + 1, size) for c in (seq, qual))
        found = F.when((n > start) & (n > end), region(part, COMPLETE)).when((n <= start) & (n > end), region(part, PARTIAL5))
        out.append((found, quality))
    return out


def _plain() -> str:
    return "struct<seq:string,kind:string,split:int>"


def _inframe(reads: DataFrame, spec: LibrarySpec, paired: bool, options: ExtractOptions) -> DataFrame:
    if spec.n_variable_length():
        raise OptionError("in-frame extraction needs regions of fixed length")
    forward = _inframe_forward(spec, options)
    names = region_columns(spec)
    if not paired:
        return reads.select("*", *[f.alias(n) for f, n in zip(forward, names)])
    offset = spec.position(spec.forward_start_region)[0]
    offset = -offset if options.strict_offset else offset
    seen, texts = {}, []
    for i, (r, (back, back_quality)) in enumerate(zip(spec.variable, _inframe_reverse(spec))):
        start, end = (p + offset for p in spec.position(r.id))
        # here the forward read's regions stand each for itself
        seq, n = F.substring("f_seq", max(start, 0) + 1, end - start), F.length("f_seq")
        f = F.when(n > end, region(seq, COMPLETE)).when(n > start, region(seq, PARTIAL3)) if start >= 0 else F.lit(None).cast(_plain())
        seen |= {f"__f{i}": f, f"__b{i}": back}
        texts.append((F.substring("f_qual", max(start, 0) + 1, end - start), back_quality))
    rows = once(reads, **seen)
    qualities = []
    for i, pair in enumerate(texts):
        # qualities decide only where both ends show all of the region; elsewhere nulls are handed over, at no cost
        both = (F.col(f"__f{i}.kind") == COMPLETE) & (F.col(f"__b{i}.kind") == COMPLETE)
        qualities += [mean_quality(F.when(both, q)).alias(f"__{side}q{i}") for side, q in zip("fb", pair)]
    rows = rows.select("*", *qualities)
    merged = [merge_evidence(F.col(f"__f{i}"), F.col(f"__b{i}"), F.col(f"__fq{i}"), F.col(f"__bq{i}"), r.longest) for i, r in enumerate(spec.variable)]
    return rows.select(*[F.col(c) for c in reads.columns], *[m.alias(n) for m, n in zip(merged, names)])


def _found_array(seqs: list[str | None], quals: list[str | None], starts: np.ndarray, stops: np.ndarray, kinds: np.ndarray) -> pa.ListArray:
    """Evidence of every region of every read, row by row: bases, kind and mean quality (0 without quality)."""
    n, width = kinds.shape
    flat = kinds.ravel()
    low, high = starts.ravel().tolist(), stops.ravel().tolist()
    bases, means = [None] * len(flat), np.zeros(len(flat), np.float32)
    for at in np.flatnonzero(flat >= 0).tolist():
        row = at // width
        bases[at] = seqs[row][low[at] : high[at]]
        if quals[row]:
            raw = quals[row][low[at] : high[at]].encode("latin-1", "replace")
            means[at] = np.float32(sum(raw)) / np.float32(len(raw)) - np.float32(33) if raw else 0
    names = pa.DictionaryArray.from_arrays(pa.array(np.maximum(flat, 0), pa.int8()), pa.array(KINDS)).cast(pa.string())
    body = pa.StructArray.from_arrays(
        [pa.array(bases, pa.string()), names, pa.nulls(len(flat), pa.int32()), pa.array(means)], fields=list(_ARROW), mask=pa.array(flat < 0)
    )
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), body)


def _pattern_column(spec: LibrarySpec, options: ExtractOptions, seq: Column, qual: Column) -> Column:
    flanks = spec.all_flanks(options.pattern_length)
    tolerance = options.pattern_tolerance

    @F.arrow_udf(T._parse_datatype_string(f"array<{_FOUND}>"))
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for seqs, quals in parts:
            s = seqs.to_pylist()
            shape = (len(s), len(flanks))
            starts, stops, kinds = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.full(shape, -1, np.int8)
            for i, found in enumerate(pattern_regions(s, flanks, tolerance)):
                for k, f in enumerate(found):
                    if f is not None:
                        starts[i, k], stops[i, k], kinds[i, k] = f[0], f[1], KINDS.index(f[2])
            yield _found_array(s, quals.to_pylist(), starts, stops, kinds)

    return run(seq, qual)


def _align_column(spec: LibrarySpec, options: ExtractOptions, seq: Column, qual: Column) -> Column:
    template, scorer = spec.template(), options.scorer
    regions = [(a + 1, b + 1) for a, b in (spec.position(r.id) for r in spec.variable)]

    @F.arrow_udf(T._parse_datatype_string(f"struct<score:int,regions:array<{_FOUND}>>"))
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for seqs, quals in parts:
            s = seqs.to_pylist()
            # one alignment per distinct read of the batch
            distinct = list(dict.fromkeys(x for x in s if x is not None))
            places = {x: k for k, x in enumerate(distinct)}
            scores, starts, stops, kinds = aligned_regions([*distinct, ""], template, scorer, regions)
            at = np.array([places.get(x, len(distinct)) for x in s], np.int64)
            found = _found_array(s, quals.to_pylist(), starts[at] - 1, stops[at] - 1, kinds[at])
            yield pa.StructArray.from_arrays([pa.array(scores[at]), found], ["score", "regions"], mask=seqs.is_null())

    # a filter on the score would else be pushed down to the scan, and repeat the alignment there for every repeated read
    return run.asNondeterministic()(seq, qual)


def _from_arrays(reads: DataFrame, spec: LibrarySpec, paired: bool) -> DataFrame:
    """Region columns from the arrays ``__f`` and ``__r`` of both reads' evidence."""
    out = []
    for i, r in enumerate(spec.variable):
        f = F.get("__f", F.lit(i))
        plain_f = F.when(f.isNotNull(), region(f["seq"], f["kind"]))
        if paired:
            b = F.get("__r", F.lit(i))
            plain_b = F.when(b.isNotNull(), region(b["seq"], b["kind"]))
            plain_f = merge_evidence(plain_f, plain_b, f["quality"], b["quality"], r.longest)
        out.append(plain_f.alias(f"reg_{r.id}"))
    return reads.select("*", *out).drop("__f", "__r")


def extract(
    reads: DataFrame, spec: LibrarySpec | None, options: ExtractOptions, paired: bool, config: FilterConfig | None = None
) -> DataFrame:
    """Add one ``reg_<id>`` struct (seq, kind, split) per variable region, null where it is not seen.

    Without a specification, and in full-read mode, there are no regions. In align mode a
    ``reason`` is added too: reads that score below the configuration's thresholds carry
    ``bad_alignment`` and no regions count for them. Reads must have ``f_seq, f_qual`` and, if
    ``paired``, ``r_seq, r_qual``. Null reads show no region.
    """
    if spec is None or options.mode == "full-read":
        return reads
    if options.mode == "inframe":
        return _inframe(reads, spec, paired, options)
    back = (reverse_complement(F.col("r_seq")), F.reverse("r_qual"))
    if options.mode == "pattern":
        out = reads.withColumn("__f", _pattern_column(spec, options, F.col("f_seq"), F.col("f_qual")))
        if paired:
            out = out.withColumn("__r", _pattern_column(spec, options, *back))
        return _from_arrays(out, spec, paired)
    out = reads.withColumn("__fa", _align_column(spec, options, F.col("f_seq"), F.col("f_qual")))
    out = out.withColumn("__f", F.col("__fa.regions")).withColumn("f_score", F.col("__fa.score"))
    if paired:
        out = out.withColumn("__ra", _align_column(spec, options, *back))
        out = out.withColumn("__r", F.col("__ra.regions")).withColumn("r_score", F.col("__ra.score"))
    reason = alignment_reason(config or FilterConfig(), F.col("f_score"), F.col("r_score") if paired else None)
    return _from_arrays(out.withColumn("reason", reason), spec, paired).drop("__fa", "__ra")


def alignment_scores(spec: LibrarySpec, options: ExtractOptions, tolerance: float, paired: bool) -> tuple[int, int]:
    """Least scores of forward and reverse reads: the tolerance times what the expected reads score."""
    template = spec.template()
    forward = semiglobal([spec.expected_forward()], template, options.scorer)[0][0]
    # the expected reverse read is aligned as it is read, as the established thresholds have it
    reverse = semiglobal([spec.expected_reverse()], template, options.scorer)[0][0] if paired else 0
    return alignment_threshold(forward, tolerance), alignment_threshold(reverse, tolerance)


def explain_alignment(read: str, spec: LibrarySpec, options: ExtractOptions = ExtractOptions()) -> str:
    """The alignment of one read to the template as three lines of text."""
    ((score, path),) = semiglobal([read], spec.template(), options.scorer)
    template, top, mid, low = spec.template(), "", "", ""
    for x, y, op in path:
        top += "-" if op == "D" else read[x - 1]
        low += "-" if op == "I" else template[y - 1]
        mid += "|" if op == "M" else " "
    return f"{top}\n{mid}\n{low}\nscore {score}"
