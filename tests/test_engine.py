import gzip

import pytest
from pyspark.sql import functions as F

from readweave import cli
from readweave.api import count_reads
from readweave.errors import LibraryError, OptionError, PairError, SpecError
from readweave.functions.exprs import mean_quality, merge_evidence, read_group, region
from readweave.operators.extract import ExtractOptions
from readweave.operators.filters import FilterConfig
from readweave.operators.library import compile_library, lookup
from readweave.operators.spec import LibrarySpec
from readweave.sources.fastx import SeqPath, read_reads, records

SPEC = {
    "id": "t", "forward_start_region": "primer_f", "forward_read_length": 24, "reverse_start_region": "primer_r", "reverse_read_length": 24,
    "regions": [
        {"id": "primer_f", "seq_type": "Fixed", "seq": "GGCC"},
        {"id": "region1", "seq_type": "Library", "min_length": 5, "max_length": 5, "max_distance": 0},
        {"id": "scaffold", "seq_type": "Fixed", "seq": "TTTAAGAGAATTT"},
        {"id": "region2", "seq_type": "Library", "min_length": 5, "max_length": 5, "max_distance": 0},
        {"id": "primer_r", "seq_type": "Fixed", "seq": "CCGG"},
    ],
}


def fastq(path, rows):
    path.write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows))
    return str(path)


def test_spec():
    spec = LibrarySpec.from_dict(SPEC)
    assert spec.expected_forward() == "GGCCNNNNNTTTAAGAGAATTTNN"
    assert spec.position("region2") == (22, 27)
    with pytest.raises(SpecError) as e:
        LibrarySpec.from_dict({**SPEC, "forward_start_region": "x", "reverse_start_region": "y"})
    assert len(e.value.problems) == 2


def test_full_read_golden(spark, tmp_path):
    seqs = ["GAAAGGACGAAACACCTTTG"] * 5 + ["AAGAGCTAAGCTGGAAACAG"] * 3 + ["ATGTCGTAAAGTAGTTGTTT"] * 2
    forward = fastq(tmp_path / "f.fq", [(f"r{i}", s, "@" * len(s)) for i, s in enumerate(seqs)])
    assert cli.run([forward, "-m", "full-read", "-o", str(tmp_path / "out"), "-s"]) == 0
    lines = (tmp_path / "out.counts.tsv").read_text().split("\n")
    assert lines[1] == "\tGAAAGGACGAAACACCTTTG\t\tuncompared\t\t\t\t5"
    assert [x.rsplit("\t", 1)[1] for x in lines[1:4]] == ["5", "3", "2"]
    summary = (tmp_path / "out.summary.tsv").read_text().split("\n")
    assert summary[1] == "all\ttotal\t10\t1.0000\t1.0000" and len(summary) == 18
    assert cli.run([forward, "-m", "full-read", "-o", str(tmp_path / "out")]) == 1


def test_inframe_golden(spark, tmp_path):
    rows = [("GGCCGAAAGTTTAAGAGAATTTCT", "CCGGCAAAGAAATTCTCTTAAACT", 4), ("GGCCAAGAGTTTAAGAGAATTTAA", "CCGGCTGTTAAATTCTCTTAAACT", 3),
            ("GGCCATGTCTTTAAGAGAATTTGC", "CCGGCCAGCAAATTCTCTTAAAGA", 2), ("GGCCAAAAATTTAAGAGAATTTAA", "CCGGTTTTTAAATTCTCTTAAATT", 1)]
    f = fastq(tmp_path / "f.fq", [("a", x, "I" * 24) for x, _, n in rows for _ in range(n)])
    r = fastq(tmp_path / "r.fq", [("b", y, "I" * 24) for _, y, n in rows for _ in range(n)])
    reads = read_reads(spark, f, r)
    members = [("seq1", "GAAAG", "CTTTG"), ("seq2", "AAGAG", "AACAG"), ("seq3", "ATGTC", "GCTGG"), ("seqX", "GGCCG", "TTAAT")]
    spec = LibrarySpec.from_dict(SPEC)
    library = compile_library(spec, spark.createDataFrame(members, "_id string, region1 string, region2 string"))
    counts = count_reads(spark, reads, spec, ExtractOptions("inframe"), full_seq=True, paired=True).compare(library).written()
    got = {x["region1"]: x for x in counts.counts().collect()}
    assert (got["GAAAG"]["count"], got["GAAAG"]["combination_id"], got["GAAAG"]["region2_nearest"]) == (4, "seq1", "CTTTG")
    assert (got["AAAAA"]["combination_status"], got["AAAAA"]["combinations_in_library"], got["AAAAA"]["region1_n_matches"]) == ("mismatch", 0, 0)
    lib = {(x["region1"], x["combination_status"]): x["count"] for x in counts.library_counts().collect()}
    assert lib == {("GAAAG", "match"): 4, ("AAGAG", "match"): 3, ("ATGTC", "match"): 2, (None, "mismatch"): 1}
    rows = {(x["group"], x["metric"]): x["count"] for x in counts.summary().collect()}
    assert (rows["all", "total"], rows["unfiltered", "exact_match"], rows["unfiltered", "mismatch"]) == (10, 9, 1)


def test_filtering_golden(spark, tmp_path):
    good = "GGCCGAAAGTTTAAGAGAATTTCTTTGCCGG"
    bad = "GGCCGAAAGTGTGCATAGCTTTGGGCC"
    long = "GGCCGAAAGTTTAAGACGACGACGACGAAGAATTTCTTTGCCGG"
    rows = [(good, "I" * 31)] * 8 + [("GGCCG", "IGFDI")] * 5 + [(long, "I" * 44)] * 4 + [(good, "#" * 31)] * 3 + [(bad, "I" * 27)] * 2 + [("", "I")]
    reads = read_reads(spark, fastq(tmp_path / "f.fq", [("x", s, q) for s, q in rows])).drop("r_seq", "r_qual")
    spec = LibrarySpec.from_dict(SPEC)
    library = compile_library(spec, spark.createDataFrame([("seq1", "GAAAG", "CTTTG"), ("seqX", "GGCCG", "TTAAT")], "_id string, region1 string, region2 string"))
    config = FilterConfig(True, 10, 31, 30.0)
    counts = count_reads(spark, reads, spec, ExtractOptions("align"), config, True, False, 0.8).compare(library)
    got = {x["metric"]: x["count"] for x in counts.summary().collect()}
    assert [got[m] for m in ("exact_match", "empty_read", "short_read", "long_read", "low_mean_quality", "bad_alignment")] == [8, 1, 5, 4, 3, 2]


def test_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("@a d e\nACGT\n+\n@III\n")
    with gzip.open(tmp_path / "a.fq.gz", "at") as f:
        f.write("@b\nAC\n+\nII\n")
    assert list(records(SeqPath(str(tmp_path / "a.fq.gz")))) == [("a", "d e", "ACGT", "@III"), ("b", None, "AC", "II")]
    (tmp_path / "a.fa").write_text(">x y\nAC\nGT\n>z\nA\n")
    assert [r["f_seq"] for r in read_reads(spark, str(tmp_path / "a.fa"), max_reads=1).collect()] == ["ACGT"]
    short = fastq(tmp_path / "s.fq", [("a", "A", "I")])
    with pytest.raises(Exception, match="ends before"):
        read_reads(spark, str(tmp_path / "a.fq.gz"), short).collect()
    with pytest.raises(OptionError):
        SeqPath("reads.txt").resolved()
    assert PairError is not None


def test_expressions(spark):
    df = spark.createDataFrame([("r1", "cell=A x"), ("r2", None)], "i string, d string")
    assert [r[0] for r in df.select(read_group(r"cell=(\w+)", F.col("i"), F.col("d"))).collect()] == ["A", "_unmatched_"]
    q = spark.createDataFrame([("II",), ("",), (None,)], "q string")
    assert [r[0] for r in q.select(mean_quality("q")).collect()] == [40.0, 0.0, None]

    def merged(f, r, length=6):
        row = spark.range(1).select(merge_evidence(region(F.lit(f[0]), f[1]), region(F.lit(r[0]), r[1]), F.lit(0.0), F.lit(40.0), length).alias("m")).first()["m"]
        return tuple(row)

    assert merged(("AAAA", "complete"), ("TTTT", "complete")) == ("TTTT", "complete", None)
    assert merged(("AAA", "partial_3"), ("TT", "partial_5")) == ("AAA/TT", "missing_center", 3)
    assert merged(("AAAA", "partial_3"), ("TTTT", "partial_5")) == ("AAAA/TTTT", "overlapping", 4)


def test_lookup_tables(spark):
    library = spark.createDataFrame([(0, "r1", s, [s.lower()]) for s in ("AAAA", "AAAT", "TTAA", "GGAA", "CCCC")], "sublib int, region_id string, seq string, ids array<string>")
    cases = [("hamming", "full", "AAAG", 2, (1, "AAAA,AAAT")), ("hamming", "full", "GGGG", 1, None), ("hamming", "head", "AG", 1, (1, "AAAA,AAAT,GGAA")),
             ("hamming", "tail", "GA", 1, (1, "AAAA,GGAA,TTAA")), ("levenshtein", "full", "AAA", 2, (1, "AAAA,AAAT")), ("exact", "head", "AA", 2, (0, "AAAA,AAAT")),
             ("exact", "tail", "AT", 2, (0, "AAAT")), ("levenshtein", "head", "AA", 1, (0, "AAAA,AAAT")), ("bounded-levenshtein", "full", "GGGGGG", 1, None)]
    for metric, anchor, seq, limit, expected in cases:
        probes = spark.createDataFrame([("r1", seq, anchor)], "region_id string, seq string, anchor string")
        got = [(r["distance"], ",".join(r["hits"])) for r in lookup(probes, library, metric, limit).collect()]
        assert got == ([expected] if expected else []), (metric, anchor, seq)


def test_library_checks(spark):
    spec = LibrarySpec.from_dict(SPEC)
    a = spark.createDataFrame([("x", "GAAAG")], "_id string, region1 string")
    with pytest.raises(LibraryError):
        compile_library(spec, a, a)
    with pytest.raises(LibraryError):
        compile_library(spec, a.withColumnRenamed("region1", "other"))


def test_stream(spark, tmp_path):
    from readweave.streaming.landing import stream_counts

    spark.createDataFrame([("A", "ACGT", "IIII"), ("A", "ACGT", "IIII"), ("B", "", "")], "grp string, f_seq string, f_qual string").write.parquet(str(tmp_path / "in"))
    out = stream_counts(spark, str(tmp_path / "in"), "grp string, f_seq string, f_qual string", options=ExtractOptions("full-read"))
    q = out.writeStream.outputMode("complete").format("memory").queryName("landing").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT grp, f_seq, count FROM landing").collect()] == [("A", "ACGT", 2)]


def test_hgvs_strings_of_all_regions(spark, tmp_path):
    """A region of 28 letters with an insertion and a deletion, and region2, have their variants shown too."""
    from readweave.plans.reference import hgvs_strings

    r1, r2 = "CATCTATACAACCTAGCCGGGCCACCAA", "CGTTGACCCCAG"
    gapped, short, sub = r1[:3] + r1[4:24] + "G" + r1[24:], r1[:10] + r1[11:], "A" + r2[1:]
    spark.createDataFrame([(1, "kx1", r1, r2)], "member_no bigint, _id string, region1 string, region2 string").write.parquet(f"{tmp_path}/library.parquet")
    rows = [(1, "g", gapped, sub), (2, "g", short, r2), (3, None, None, None), (4, "g", "G" * 28, None)]
    spark.createDataFrame(rows, "rec_id bigint, grp string, region1 string, region2 string").write.parquet(f"{tmp_path}/expected.parquet")
    got = {(r["region"], r["seq"]): (r["hit"], r["variants"]) for r in hgvs_strings(spark, str(tmp_path)).collect()}
    assert set(got) == {("region1", gapped), ("region1", short), ("region1", "G" * 28), ("region2", sub), ("region2", r2)}
    assert got["region1", gapped][0] == got["region1", short][0] == r1 and got["region2", sub][0] == r2
    assert "ins" in got["region1", gapped][1] and "del" in got["region1", gapped][1] and "del" in got["region1", short][1]
    assert ">" in got["region2", sub][1] and got["region2", r2][1] is None and got["region1", "G" * 28][1] is None


def test_checkpoint_folder_must_be_shared():
    from readweave.session import ensure_checkpoint_dir

    class Context:
        def __init__(self, master, folder):
            self.master, self.folder = master, folder

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {"spark.checkpoint.dir": self.folder} if self.folder else {}

        def setCheckpointDir(self, folder):
            self.set = folder

    class Session:
        def __init__(self, *what):
            self.sparkContext = Context(*what)

    with pytest.raises(OptionError):
        ensure_checkpoint_dir(Session("spark://host:7077", None))
    assert ensure_checkpoint_dir(Session("spark://host:7077", "/shared")) == "/shared"
    assert ensure_checkpoint_dir(Session("local[4]", None))


def test_places_follow_the_order(spark):
    from readweave.operators.outputs import sort_by_total
    from readweave.session import with_place

    df = spark.range(1000, numPartitions=7).withColumn("v", -F.col("id"))
    got = with_place(df, "place", F.asc("v")).collect()
    assert sorted(r["place"] for r in got) == list(range(1, 1001)) and all(r["place"] == 1000 - r["id"] for r in got)
    rows = [("g1", "a", 5), ("g2", "a", 1), ("g1", "b", 4), (None, None, 6), ("g3", "c", 1)]
    table = spark.createDataFrame(rows, "`group` string, forward string, count int")
    want = [("g1", "a"), ("g2", "a"), (None, None), ("g1", "b"), ("g3", "c")]
    assert [(r["group"], r["forward"]) for r in sort_by_total(table).collect()] == [(None, None), ("g1", "a"), ("g2", "a"), *want[3:]]
    assert [(r["group"], r["forward"]) for r in sort_by_total(table.where("forward is not null"), place="n").orderBy("n").collect()] == [w for w in want if w[1]]


def test_packed_hamming(spark):
    from readweave.functions.exprs import hamming, hamming_packed, packed_bases

    rows = [("ACGT", "ACGA"), ("T" * 31, "A" * 31), ("ACGT", "ACGT"), ("ACNT", "ACGT"), ("A" * 32, "C" * 32), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(hamming_packed(packed_bases(F.col("a")), packed_bases(F.col("b"))), hamming(F.col("a"), F.col("b")))
    assert [tuple(r) for r in df.collect()] == [(1, 1), (31, 31), (0, 0), (None, 1), (None, 32), (None, 0)]
