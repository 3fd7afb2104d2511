"""FASTA and FASTQ files as a Spark data source, singly or in pairs."""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readweave.errors import OptionError, PairError, RecordError
from readweave.functions.exprs import read_group
from readweave.session import ship_package

READS = "file_no int, read_no bigint, f_id string, f_desc string, f_seq string, f_qual string, r_id string, r_desc string, r_seq string, r_qual string"
_ARROW = pa.schema([
    ("file_no", pa.int32()), ("read_no", pa.int64()), *[(f"{side}_{what}", pa.string()) for side in "fr" for what in ("id", "desc", "seq", "qual")],
])
#: File name endings of each format.
ENDINGS = {".fa": "fasta", ".fasta": "fasta", ".fq": "fastq", ".fastq": "fastq"}


@dataclass(frozen=True)
class SeqPath:
    """A sequence file with its format and compression, given or told by its (case-sensitive) ending."""

    path: str
    format: str = "auto"
    compression: str = "auto"

    def resolved(self) -> SeqPath:
        compression = self.compression
        if compression == "auto":
            compression = "gzip" if self.path.endswith(".gz") else "none"
        fmt = self.format
        if fmt == "auto":
            name = self.path[:-3] if self.path.endswith(".gz") else self.path
            fmt = ENDINGS.get(os.path.splitext(name)[1], "")
            if not fmt:
                raise OptionError(f"cannot tell the format of {self.path}")
        if fmt not in ("fasta", "fastq") or compression not in ("gzip", "none"):
            raise OptionError(f"unknown format {fmt!r} or compression {compression!r}")
        return SeqPath(self.path, fmt, compression)


def _header(line: str) -> tuple[str, str | None]:
    name, _, desc = line[1:].partition(" ")
    return name, desc or None


def _fastq(lines: Iterator[str], path: str) -> Iterator[tuple]:
    """Records of four or more lines. Quality ends where it is as long as the sequence, so it may begin with @;
    an empty sequence has one quality line whatever it holds."""
    for line in lines:
        if not line:
            continue
        if line[0] != "@":
            raise RecordError(f"{path}: expected @ but found {line[:20]!r}")
        name, desc = _header(line)
        seq = []
        for line in lines:
            if line.startswith("+"):
                break
            seq.append(line)
        else:
            raise RecordError(f"{path}: record {name!r} ends before its quality")
        bases = "".join(seq)
        qual = next(lines, None)
        if qual is None:
            raise RecordError(f"{path}: record {name!r} has no quality")
        while len(qual) < len(bases):
            more = next(lines, None)
            if more is None:
                raise RecordError(f"{path}: quality of {name!r} is too short")
            qual += more
        yield name, desc, bases, qual


def _fasta(lines: Iterator[str], path: str, quality: str) -> Iterator[tuple]:
    """Records of any number of sequence lines, with a constant quality."""
    name = desc = None
    seq: list[str] = []
    started = False
    for line in lines:
        if line.startswith(">"):
            if started:
                bases = "".join(seq)
                yield name, desc, bases, quality * len(bases)
            (name, desc), seq, started = _header(line), [], True
        elif line:
            if not started:
                raise RecordError(f"{path}: expected > but found {line[:20]!r}")
            seq.append(line)
    if started:
        bases = "".join(seq)
        yield name, desc, bases, quality * len(bases)


def _opened(path: str) -> BinaryIO:
    """A file of the machine, or of any file system that pyarrow knows by its URI (hdfs, s3, gs and others)."""
    if "://" not in path:
        return open(path, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _size(path: str) -> int:
    if "://" not in path:
        return os.path.getsize(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.get_file_info(inner).size


def records(path: SeqPath, default_phred: int = 73) -> Iterator[tuple]:
    """(id, description, sequence, quality) of one file; gzip files may have several members."""
    path = path.resolved()
    with _opened(path.path) as raw:
        stream = gzip.open(raw, "rb") if path.compression == "gzip" else raw
        lines = (line.rstrip("\r\n") for line in io.TextIOWrapper(stream, encoding="latin-1", newline="\n"))
        yield from _fastq(lines, path.path) if path.format == "fastq" else _fasta(lines, path.path, chr(default_phred))


def _piece(path: SeqPath, start: int, stop: int, default_phred: int) -> Iterator[tuple[int, tuple]]:
    """(byte offset, record) of the records whose header begins in [start, stop) of a plain file.

    A FASTA header is a line that begins with >. A FASTQ header is a line that begins with @ two
    lines before one that begins with +; records must have four lines here, and a quality line
    that begins with @ is no header, as the line after next holds bases."""
    mark = b"@" if path.format == "fastq" else b">"
    with _opened(path.path) as raw:
        raw.seek(max(start - 1, 0))
        if start:
            raw.readline()
        ahead: deque[tuple[int, bytes]] = deque()

        def line(k: int) -> tuple[int, bytes] | None:
            while len(ahead) <= k:
                at = raw.tell()
                text = raw.readline()
                if not text:
                    return None
                ahead.append((at, text.rstrip(b"\r\n")))
            return ahead[k]

        def is_header() -> bool:
            if not ahead[0][1].startswith(mark):
                return False
            return path.format == "fasta" or ((two := line(2)) is not None and two[1].startswith(b"+"))

        while line(0) is not None and not is_header():
            if not start and ahead[0][1] and path.format == "fasta":
                raise RecordError(f"{path.path}: expected > but found {ahead[0][1][:20]!r}")
            if not start and ahead[0][1]:
                break
            ahead.popleft()
        while line(0) is not None and ahead[0][0] < stop:
            at = ahead[0][0]
            if not ahead[0][1]:
                ahead.popleft()
                continue
            if path.format == "fastq":
                if not is_header() or line(3) is None:
                    raise RecordError(f"{path.path}: at byte {at} there is no record of four lines; read it without split_bytes")
                own = [ahead.popleft()[1].decode("latin-1") for _ in range(4)]
                if len(own[1]) > len(own[3]):
                    raise RecordError(f"{path.path}: quality of {own[0]!r} is too short")
            else:
                own = [ahead.popleft()[1].decode("latin-1")]
                while (more := line(0)) is not None and not more[1].startswith(mark):
                    own.append(ahead.popleft()[1].decode("latin-1"))
            parse = _fastq(iter(own), path.path) if path.format == "fastq" else _fasta(iter(own), path.path, chr(default_phred))
            yield at, next(parse)


class _Files(InputPartition):
    """A file or a pair of files, or the piece [start, stop) of a plain file."""

    def __init__(self, number: int, forward: SeqPath, reverse: SeqPath | None, start: int = 0, stop: int = 0) -> None:
        super().__init__(number)
        self.number, self.forward, self.reverse, self.start, self.stop = number, forward, reverse, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        get = options.get
        self.phred, self.most, self.split = int(get("default_phred", "73")), int(get("max_reads", "0")), int(get("split_bytes", "0"))
        paths, backs = _expand(get("path", "")), _expand(get("reverse", ""))
        if not paths:
            raise OptionError("no forward file")
        if backs and len(backs) != len(paths):
            raise PairError("as many reverse as forward files are needed")
        fmt, compression = get("format", "auto"), get("compression", "auto")
        make = lambda p: SeqPath(p, fmt, compression).resolved()
        self.files = [(make(p), make(backs[i]) if backs else None) for i, p in enumerate(paths)]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for i, (f, r) in enumerate(self.files):
            if self.split and not self.most and r is None and f.compression == "none":
                size = _size(f.path)
                out += [_Files(i, f, None, at, min(at + self.split, size)) for at in range(0, size, self.split)]
            else:
                out.append(_Files(i, f, r))
        return out

    def _rows(self, p: _Files) -> Iterator[tuple]:
        if p.stop:
            return ((p.number, at, *f, None, None, None, None) for at, f in _piece(p.forward, p.start, p.stop, self.phred))
        forward = records(p.forward, self.phred)
        if p.reverse is None:
            return ((p.number, i, *f, None, None, None, None) for i, f in enumerate(forward))
        return self._pairs(p, forward, records(p.reverse, self.phred))

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows = self._rows(partition)
        if self.most:
            rows = islice(rows, self.most)
        while some := list(islice(rows, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), _ARROW.types)], schema=_ARROW)

    def _pairs(self, partition: _Files, forward: Iterator, reverse: Iterator) -> Iterator[tuple]:
        """Both files in lock-step: reads pair by place, whatever their names."""
        end = object()
        i = 0
        while True:
            f, r = next(forward, end), next(reverse, end)
            if f is end and r is end:
                return
            if f is end or r is end:
                raise PairError(f"{(partition.forward if f is end else partition.reverse).path} ends before its partner")
            yield (partition.number, i, *f, *r)
            i += 1


def _expand(text: str) -> list[str]:
    out: list[str] = []
    for part in text.split(","):
        if part:
            out += sorted(glob.glob(part)) if any(c in part for c in "*?[") else [part]
    return out


class FastxSource(DataSource):
    """``spark.read.format("fastx")``: options path, reverse, format, compression, default_phred, max_reads, split_bytes.

    A partition per file or pair of files; several files are given with commas or a pattern.
    ``max_reads`` stops each file early. With ``split_bytes`` a plain single-end file is read in
    pieces of that size by as many tasks, and ``read_no`` is the record's byte offset instead of
    its number; gzip files and pairs, which go in lock-step, are read whole. Paths may be URIs of
    file systems that pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_reads(
    spark: SparkSession, forward: str, reverse: str | None = None, *, format: str = "auto", compression: str = "auto",
    default_phred: int = 73, max_reads: int = 0, group: str | None = None, split_bytes: int = 0,
) -> DataFrame:
    """Reads of sequence files with their group; the pair columns are null for single reads.

    ``max_reads`` counts over all files in their order."""
    ship_package(spark)
    spark.dataSource.register(FastxSource)
    reader = spark.read.format("fastx").option("format", format).option("compression", compression)
    reader = reader.option("default_phred", default_phred).option("max_reads", max_reads).option("path", forward).option("split_bytes", split_bytes)
    if reverse:
        reader = reader.option("reverse", reverse)
    reads = reader.load()
    if max_reads and len(_expand(forward)) > 1:
        reads = reads.orderBy("file_no", "read_no").limit(max_reads)
    return reads.withColumn("grp", read_group(group, F.col("f_id"), F.col("f_desc")))
