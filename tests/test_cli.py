"""The command line end to end: files in, tables out."""

import json
import random

import pytest

from readweave import cli
from readweave.api import count_reads
from readweave.errors import OptionError
from readweave.operators.extract import ExtractOptions, explain_alignment
from readweave.operators.filters import FilterConfig
from readweave.operators.library import compile_library
from readweave.operators.spec import LibrarySpec
from readweave.sources.fastx import read_reads

from .test_engine import SPEC, fastq

#: Reads, library and counts of the established cases.
READS = [
    ("GGCCGAAAGTTTAAGAGAATTTCT", "CCGGCAAAGAAATTCTCTTAAACT", 4), ("GGCCAAGAGTTTAAGAGAATTTAA", "CCGGCTGTTAAATTCTCTTAAACT", 3),
    ("GGCCATGTCTTTAAGAGAATTTGC", "CCGGCCAGCAAATTCTCTTAAAGA", 2), ("GGCCAAAAATTTAAGAGAATTTAA", "CCGGTTTTTAAATTCTCTTAAATT", 1),
]
LIBRARY = "# members\n_id\tregion1\tregion2\nseq1\tGAAAG\tCTTTG\nseq2\tAAGAG\tAACAG\nseq3\tATGTC\tGCTGG\nseqX\tGGCCG\tTTAAT\n"
REGIONS = [("GAAAG", "CTTTG", "seq1", 4), ("AAGAG", "AACAG", "seq2", 3), ("ATGTC", "GCTGG", "seq3", 2)]


@pytest.fixture
def files(tmp_path):
    f = fastq(tmp_path / "f.fq", [(f"a{i}", x, "I" * 24) for i, (x, _, n) in enumerate(READS) for _ in range(n)])
    r = fastq(tmp_path / "r.fq", [(f"b{i}", y, "I" * 24) for i, (_, y, n) in enumerate(READS) for _ in range(n)])
    (tmp_path / "spec.json").write_text(json.dumps(SPEC))
    (tmp_path / "library.tsv").write_text(LIBRARY)
    return [f, r, "-l", str(tmp_path / "spec.json"), "-c", str(tmp_path / "library.tsv"), "-s", "-F"]


def rows(path):
    return [line.split("\t") for line in path.read_text().rstrip("\n").split("\n")]


def test_inframe_with_library(spark, tmp_path, files):
    assert cli.run([*files, "-m", "inframe", "-o", str(tmp_path / "out")]) == 0
    head, *body = rows(tmp_path / "out.counts.tsv")
    assert head == ["group", "forward", "reverse", *[f"region{i}{x}" for i in (1, 2) for x in ("", "_nearest", "_variants", "_distance", "_n_matches")],
                    "combination_status", "combination_distance", "combinations_in_library", "combination_id", "count"]
    want = [["", f, r, a, a, "", "0", "1", b, b, "", "0", "1", "match", "0", "1", i, str(n)] for (f, r, _), (a, b, i, n) in zip(READS, REGIONS)]
    want.append(["", *READS[3][:2], "AAAAA", "", "", "", "0", "AAAAA", "", "", "", "0", "mismatch", "", "0", "", "1"])
    assert body == want
    assert rows(tmp_path / "out.library_counts.tsv")[1:] == [["", a, b, "match", "1", i, str(n)] for a, b, i, n in REGIONS] + [["", "", "", "mismatch", "0", "", "1"]]
    summary = {(r[0], r[1]): r[2:] for r in rows(tmp_path / "out.summary.tsv")[1:]}
    assert summary["all", "total"] == ["10", "1.0000", "1.0000"] and summary["unfiltered", "exact_match"] == ["9", "0.9000", "0.9000"]
    assert summary["unfiltered", "mismatch"] == ["1", "0.1000", "0.1000"] and len(summary) == 16
    assert len(rows(tmp_path / "out.filtered.tsv")) == 1
    # outputs that are there are not overwritten unasked
    assert cli.run([*files, "-m", "inframe", "-o", str(tmp_path / "out")]) == 1
    assert cli.run([*files, "-m", "inframe", "-o", str(tmp_path / "out"), "-w", "--skip-variants"]) == 0
    assert not any("variants" in c for c in rows(tmp_path / "out.counts.tsv")[0])


def test_paired_alignment_with_library(spark, tmp_path, files, capsys):
    """The same reads aligned: both ends show the regions the constructs hold."""
    assert cli.run([*files, "-r", "0.8", "-v", "-o", str(tmp_path / "out")]) == 0
    body = rows(tmp_path / "out.counts.tsv")[1:]
    assert [(r[3], r[8], r[13], r[-1]) for r in body] == [("GAAAG", "CTTTG", "match", "4"), ("AAGAG", "AACAG", "match", "3"), ("ATGTC", "GCTGG", "match", "2"), ("AAAAA", "AAAAA", "mismatch", "1")]
    assert "10 reads, 0 filtered" in capsys.readouterr().err


def test_parts_ids_and_warnings(spark, tmp_path, files, capsys):
    (tmp_path / "library.tsv").write_text("region1\tregion2\nGAAAG\tCTTTG\nAAGAG\tAACAG\n")
    assert cli.run([*files, "-m", "inframe", "-o", str(tmp_path / "p"), "--parts"]) == 0
    lines = [r for f in sorted((tmp_path / "p.counts").glob("part-*")) for r in rows(f) if r[0] != "group"]
    assert {(r[-2], r[-1]) for r in lines} == {("lib0_0", "4"), ("lib0_1", "3"), ("", "2"), ("", "1")}
    assert cli.run([*files, "-m", "inframe", "-o", str(tmp_path / "p"), "--parts"]) == 1
    (tmp_path / "library.tsv").write_text("_id\tregion1\nx\tGAAAG\nx\tAAGAG\n")
    assert cli.run([*files, "-m", "inframe", "-o", str(tmp_path / "q")]) == 1
    assert "repeated ids" in capsys.readouterr().err
    assert cli.run([files[0], "-m", "full-read", "-L", "30", "-o", str(tmp_path / "none")]) == 0
    assert "all reads were filtered" in capsys.readouterr().err
    (tmp_path / "empty.fq").write_text("")
    assert cli.run([str(tmp_path / "empty.fq"), "-m", "full-read", "-o", str(tmp_path / "no")]) == 1
    assert cli.run([files[0], "-c", files[5], "-o", str(tmp_path / "no")]) == 1


def test_merge_guard_and_accessors(spark, files):
    spec, reads = LibrarySpec.from_dict(SPEC), read_reads(spark, files[0])
    make = lambda config, some=reads: count_reads(spark, some.drop("r_seq", "r_qual"), spec, ExtractOptions("inframe"), config)
    one, other = make(FilterConfig(True, 10)), make(FilterConfig(True, 11))
    with pytest.raises(OptionError, match="different filters"):
        one.merge(other)
    both = one.merge(make(FilterConfig(True, 10)))
    assert both.n_combinations() == 4 and sum(r["count"] for r in both.counts().collect()) == 20 and not both.is_empty()
    none = make(FilterConfig(True, 30))
    assert none.is_empty() and none.total_filtered() == 10 and not none.compared
    library = compile_library(spec, spark.createDataFrame([("s", "GAAAG", "CTTTG")], "_id string, region1 string, region2 string"))
    with pytest.raises(OptionError):
        both.compare(library).merge(both)
    assert "score 88" in explain_alignment("GGCCNNNNNTTTAAGAGAATTTNN", spec)


def test_split_files(spark, tmp_path):
    """Pieces of any size give the records of the whole file; quality lines that begin with @ are no headers."""
    rng = random.Random(1)
    records = [(f"r{i} x", "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 90)))) for i in range(300)]
    path = fastq(tmp_path / "a.fq", [(n, s, "@" + "".join(rng.choice("@I+") for _ in range(len(s) - 1)) if s else "@") for n, s in records])
    fasta = tmp_path / "a.fa"
    fasta.write_text("".join(f">{n}\n{s[:40]}\n{s[40:]}\n" for n, s in records))
    for p in (path, str(fasta)):
        whole = read_reads(spark, p).select("f_id", "f_desc", "f_seq", "f_qual").collect()
        assert len(whole) == 300
        for size in (611, 10**6):
            got = read_reads(spark, p, split_bytes=size).orderBy("read_no").select("f_id", "f_desc", "f_seq", "f_qual").collect()
            assert got == whole, size
    (tmp_path / "b.fq").write_text("@a\nAC\nGT\n+\nIIII\n")
    assert [r["f_seq"] for r in read_reads(spark, str(tmp_path / "b.fq")).collect()] == ["ACGT"]
    with pytest.raises(Exception, match="four lines"):
        read_reads(spark, str(tmp_path / "b.fq"), split_bytes=100).collect()
    assert read_reads(spark, f"{path},{path}", max_reads=301).count() == 301
    assert read_reads(spark, f"file://{path}").count() == 300
