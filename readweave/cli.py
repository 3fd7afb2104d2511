"""Command line: count reads of FASTA or FASTQ files."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import Observation, SparkSession

from readweave.api import count_reads
from readweave.errors import OptionError, ReadweaveError
from readweave.functions.alignment import Scorer
from readweave.operators.extract import MODES, ExtractOptions
from readweave.operators.filters import FilterConfig
from readweave.operators.library import METRICS, compile_library, read_library_tsv
from readweave.operators.outputs import guard_outputs
from readweave.operators.spec import LibrarySpec
from readweave.sources.fastx import read_reads


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("readweave", description=__doc__)
    p.add_argument("forward")
    p.add_argument("reverse", nargs="?")
    p.add_argument("-l", "--library-spec")
    p.add_argument("-f", "--format", choices=("auto", "fasta", "fastq"), default="auto")
    p.add_argument("-z", "--compression", choices=("auto", "gzip", "none"), default="auto")
    p.add_argument("--forward-start")
    p.add_argument("--forward-length", type=int)
    p.add_argument("--reverse-start")
    p.add_argument("--reverse-length", type=int)
    p.add_argument("-o", "--output", default="read_counts")
    p.add_argument("-s", "--sort", action="store_true")
    p.add_argument("-w", "--overwrite", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-m", "--mode", choices=MODES, default="align")
    p.add_argument("-F", "--full-seq", action="store_true")
    p.add_argument("-g", "--group")
    p.add_argument("-c", "--library", nargs="+", default=[])
    p.add_argument("-d", "--distance-metric", choices=METRICS, default="hamming")
    p.add_argument("-x", "--max-distance", type=int, default=3)
    p.add_argument("-t", "--max-matches", type=int, default=10)
    p.add_argument("--skip-variants", action="store_true")
    p.add_argument("-q", "--mean-quality-threshold", type=float)
    p.add_argument("-r", "--alignment-tolerance", type=float)
    p.add_argument("-L", "--minimum-read-length", type=int)
    p.add_argument("-M", "--maximum-read-length", type=int)
    p.add_argument("--pattern-length", type=int, default=10)
    p.add_argument("--pattern-tolerance", type=int, default=1)
    p.add_argument("--match-score", type=int, default=6)
    p.add_argument("--n-match-score", type=int, default=-2)
    p.add_argument("--mismatch-score", type=int, default=-3)
    p.add_argument("--gap-open-score", type=int, default=-10)
    p.add_argument("--gap-extend-score", type=int, default=-4)
    p.add_argument("--no-cache", action="store_true", help="accepted; results never depend on a cache")
    p.add_argument("--max-reads", type=int, default=0)
    p.add_argument("--default-phred", type=int, default=73)
    p.add_argument("-T", "--threads", type=int, default=1, help="local Spark threads if no session is running")
    p.add_argument("--parts", action="store_true", help="write folders of part files by the executors instead of single files")
    p.add_argument("--split-bytes", type=int, default=0, help="read plain single-end files in pieces of about this many bytes")
    return p


def run(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    try:
        guard_outputs(a.output, a.overwrite, a.parts)
        if a.library and not a.library_spec:
            raise OptionError("a library needs a specification")
        spec = None
        if a.library_spec:
            spec = LibrarySpec.from_json(
                a.library_spec, forward_start_region=a.forward_start, forward_read_length=a.forward_length,
                reverse_start_region=a.reverse_start, reverse_read_length=a.reverse_length,
            )
            if a.mode == "inframe" and spec.n_variable_length():
                raise OptionError("in-frame extraction needs regions of fixed length")
        if a.threads < 1:
            raise OptionError("at least one thread is needed")
        spark = SparkSession.builder.master(f"local[{a.threads}]").appName("readweave").getOrCreate()
        reads = read_reads(
            spark, a.forward, a.reverse, format=a.format, compression=a.compression,
            default_phred=a.default_phred, max_reads=a.max_reads, group=a.group, split_bytes=a.split_bytes,
        )
        scorer = Scorer(a.match_score, a.n_match_score, a.mismatch_score, a.gap_open_score, a.gap_extend_score)
        options = ExtractOptions(a.mode, a.pattern_length, a.pattern_tolerance, scorer)
        config = FilterConfig(True, a.minimum_read_length, a.maximum_read_length, a.mean_quality_threshold)
        if a.alignment_tolerance is not None and spec is None:
            print("readweave: --alignment-tolerance without a specification has no effect", file=sys.stderr)
            a.alignment_tolerance = None
        seen = Observation("reads") if a.verbose else None
        started = time.time()
        counts = count_reads(
            spark, reads, spec, options, config, a.full_seq, bool(a.reverse), a.alignment_tolerance, write_once=True, observation=seen
        )
        if a.library:
            library = compile_library(spec, *[read_library_tsv(spark, p) for p in a.library])
            counts = counts.compare(library, a.distance_metric, a.max_distance, a.max_matches, not a.skip_variants)
        counts = counts.written()
        if (counts.classified if counts.compared else counts.combinations).isEmpty():
            if not counts.total_filtered():
                raise OptionError("no reads")
            print("readweave: all reads were filtered; check the files and the filters", file=sys.stderr)
        if seen is not None:
            n, took = seen.get, time.time() - started
            print(f"readweave: {n['reads']} reads, {n['filtered']} filtered, {n['reads'] / took:.0f} reads/s", file=sys.stderr)
        counts.write(a.output, a.sort, a.overwrite, a.parts)
    except ReadweaveError as e:
        print(f"readweave: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
