"""Queries of the counting engine over the driver's tables, and their SQL.

The reads are the forward and reverse sequences of table expected, the library is table library;
qualities and names are derived by string functions both engines have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.api import Counts, count_reads
from readweave.functions.exprs import COMPLETE, mean_quality, read_group, region, region_text, reverse_complement
from readweave.operators import classify as c
from readweave.operators.extract import ExtractOptions, extract
from readweave.operators.filters import FilterConfig, filtered_counts, with_reason
from readweave.operators.library import FULL, HEAD, TAIL, compile_library, lookup, match_regions
from readweave.operators.observe import count_combinations, merge_counts, observed_regions
from readweave.operators.outputs import sort_by_total
from readweave.operators.records import clean_sequence
from readweave.operators.spec import LibrarySpec
from readweave.session import cut, table

#: The construct of the reads.
SPEC = LibrarySpec.from_dict({
    "id": "pool", "forward_start_region": "primer_f", "forward_read_length": 80, "reverse_start_region": "primer_r", "reverse_read_length": 52,
    "regions": [
        {"id": "primer_f", "seq_type": "Fixed", "seq": "TTCGCGCAGCCCGG"},
        {"id": "region1", "seq_type": "Library", "min_length": 28, "max_length": 28},
        {"id": "scaffold", "seq_type": "Fixed", "seq": "GGATCTAGGACTGCGTCA"},
        {"id": "region2", "seq_type": "Library", "min_length": 12, "max_length": 12, "max_distance": 1},
        {"id": "primer_r", "seq_type": "Fixed", "seq": "CAGTGACT"},
    ],
})
#: Bounds that leave most reads and that reads of every kind break.
CONFIG = FilterConfig(True, 50, 80, 31.2)
INFRAME = ExtractOptions("inframe")


def reads(spark: SparkSession, d: str, paired: bool = False) -> DataFrame:
    """Distinct records as reads; a record without forward sequence is an empty read."""
    e = table(spark, d, "expected").where("rec_id is not null")
    f, r = F.coalesce(clean_sequence(F.col("forward")), F.lit("")), clean_sequence(F.col("reverse"))
    rows = e.select(F.col("rec_id").alias("read_no"), F.concat(F.lit("cell="), F.col("grp")).alias("f_desc"), f.alias("f_seq"), r.alias("r_seq")).dropDuplicates()
    rows = rows.withColumn("f_id", F.concat(F.lit("read"), F.col("read_no").cast("string")))
    rows = rows.withColumn("grp", read_group(r"cell=(\w+)", F.col("f_id"), F.col("f_desc")))
    rows = rows.withColumn("f_qual", F.translate("f_seq", "ACGTN", "5?FK#"))
    if not paired:
        return rows.drop("r_seq")
    return rows.where(F.col("r_seq").isNotNull()).withColumn("r_qual", F.translate("r_seq", "ACGTN", "K5F?#"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """The members of the library; every tenth has a second id, so that some combinations belong to several members."""
    m = table(spark, d, "library").select("member_no", "_id", clean_sequence(F.col("region1")).alias("region1"), clean_sequence(F.col("region2")).alias("region2"))
    again = m.where("member_no % 10 = 0").withColumn("_id", F.concat(F.lit("alt_"), "_id"))
    return m.union(again).drop("member_no")


def library(spark: SparkSession, d: str) -> DataFrame:
    return compile_library(SPEC, members(spark, d), check_ids=False)


def _long() -> FilterConfig:
    return FilterConfig(True)


def full_read_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_reads(spark, reads(spark, d), None, config=_long()).counts().groupBy("forward").agg(F.sum("count").alias("count"))


def paired_full_read_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_reads(spark, reads(spark, d, True), None, config=_long()).counts().select("group", "forward", "reverse", "count")


def grouped_counts(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def group_unmatched(spark: SparkSession, d: str) -> DataFrame:
    group = read_group(r"plate(\d+)_A", F.col("f_id"), F.col("f_desc"))
    return reads(spark, d).groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def revcomp_projection(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, True).select("read_no", reverse_complement(F.col("r_seq")).alias("turned"), F.reverse("r_qual").alias("turned_quality"))


def mean_qualities(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_no", F.round(mean_quality("f_qual").cast("double"), 3).alias("quality"))


def filter_cascade(spark: SparkSession, d: str) -> DataFrame:
    return with_reason(reads(spark, d, True), CONFIG).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def filtered_table(spark: SparkSession, d: str) -> DataFrame:
    judged = with_reason(reads(spark, d, True), CONFIG).where(F.col("reason").isNotNull())
    return filtered_counts(judged).withColumn("proportion", F.round("proportion", 9))


def max_reads(spark: SparkSession, d: str) -> DataFrame:
    first = reads(spark, d).orderBy("read_no").limit(5000)
    return count_reads(spark, first, None, config=_long()).counts().select("group", "forward", "count")


def _found(extracted: DataFrame) -> DataFrame:
    return extracted.select("read_no", *[region_text(F.col(f"reg_{r.id}")).alias(r.id) for r in SPEC.variable])


def inframe_single(spark: SparkSession, d: str) -> DataFrame:
    return _found(extract(reads(spark, d), SPEC, INFRAME, False))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return extract(reads(spark, d, True), SPEC, INFRAME, True)


def inframe_paired_merge(spark: SparkSession, d: str) -> DataFrame:
    return _found(_paired(spark, d))


def _cut_short(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose forward reads end 4 to 27 bases into region1, of which the reverse reads show the last 14."""
    size = 18 + F.col("read_no") % 24
    short = [F.substr(c, F.lit(1), size).alias(c) for c in ("f_seq", "f_qual")]
    rows = reads(spark, d, True)
    return rows.select(*[c for c in rows.columns if c not in ("f_seq", "f_qual")], *short)


def _by_kind(spark: SparkSession, d: str, kind: str) -> DataFrame:
    out = extract(_cut_short(spark, d), SPEC, INFRAME, True).where(F.col("reg_region1.kind") == kind)
    return out.select("read_no", F.col("reg_region1.seq").alias("region1"), F.col("reg_region1.split").alias("split"))


def merge_missing_center(spark: SparkSession, d: str) -> DataFrame:
    return _by_kind(spark, d, "missing_center")


def merge_overlapping(spark: SparkSession, d: str) -> DataFrame:
    return _by_kind(spark, d, "overlapping")


def pattern_exact(spark: SparkSession, d: str) -> DataFrame:
    return _found(extract(reads(spark, d), SPEC, ExtractOptions("pattern", 8, 0), False))


def pattern_tolerant(spark: SparkSession, d: str) -> DataFrame:
    return _found(extract(reads(spark, d), SPEC, ExtractOptions("pattern", 8, 1), False))


def pattern_truncated(spark: SparkSession, d: str) -> DataFrame:
    cut = reads(spark, d).withColumn("f_seq", F.expr("substring(f_seq, 25)")).withColumn("f_qual", F.expr("substring(f_qual, 25)"))
    return _found(extract(cut, SPEC, ExtractOptions("pattern", 8, 1), False))


def pattern_paired(spark: SparkSession, d: str) -> DataFrame:
    return _found(extract(reads(spark, d, True), SPEC, ExtractOptions("pattern", 8, 1), True))


def align_regions(spark: SparkSession, d: str) -> DataFrame:
    counts = count_reads(spark, reads(spark, d), SPEC, ExtractOptions("align"), _long(), alignment_tolerance=0.6)
    return counts.counts().select("group", "region1", "region2", "count")


def align_filter(spark: SparkSession, d: str) -> DataFrame:
    counts = count_reads(spark, reads(spark, d), SPEC, ExtractOptions("align"), _long(), alignment_tolerance=0.9)
    return counts.filtered.groupBy("group").agg(F.sum("bad_alignment").alias("bad_alignment"), F.sum("empty_read").alias("empty_read"))


def align_paired(spark: SparkSession, d: str) -> DataFrame:
    """Both reads of every pair aligned, with the regions they show together."""
    counts = count_reads(spark, reads(spark, d, True), SPEC, ExtractOptions("align"), _long(), alignment_tolerance=0.6)
    return counts.counts().select("group", "region1", "region2", "count")


def library_dedup(spark: SparkSession, d: str) -> DataFrame:
    return library(spark, d).select("region_id", "seq", F.array_join("ids", ",").alias("ids"))


def _probes(spark: SparkSession, d: str, name: str, anchor: str, size: int | None = None) -> DataFrame:
    seq = clean_sequence(F.col(name))
    if size is not None:
        seq = F.substr(seq, F.lit(1), F.lit(size)) if anchor == HEAD else F.right(seq, F.lit(size))
    return table(spark, d, "expected").select(F.lit(name).alias("region_id"), seq.alias("seq"), F.lit(anchor).alias("anchor"))


def _hits(found: DataFrame) -> DataFrame:
    return found.select("seq", F.col("distance").cast("bigint").alias("distance"), F.array_join("hits", ",").alias("hits"))


def _lookup(name: str, anchor: str, metric: str, distance: int, size: int | None = None):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _hits(lookup(_probes(spark, d, name, anchor, size), library(spark, d), metric, distance))

    return query


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of the records' own regions, all taken as complete."""
    e = table(spark, d, "expected").where("rec_id is not null")
    rows = e.select("rec_id", F.coalesce("grp", F.lit("")).alias("grp"), *[clean_sequence(F.col(r)).alias(r) for r in ("region1", "region2")]).dropDuplicates()
    regs = [F.when(F.col(r).isNotNull(), region(F.col(r), COMPLETE)).alias(f"reg_{r}") for r in ("region1", "region2")]
    return count_combinations(rows.select("grp", F.lit(None).cast("string").alias("f_seq"), *regs), ["reg_region1", "reg_region2"], False)


def _classified(spark: SparkSession, d: str, lib: DataFrame, n: int = 1, metric: str = "hamming") -> DataFrame:
    combos = _regions(spark, d)
    matches = match_regions(observed_regions(combos, SPEC), lib, SPEC, metric, 3, 10)
    return c.classify(c.with_matches(combos, matches, ["region1", "region2"]), ["region1", "region2"], n)


def overmatched(spark: SparkSession, d: str) -> DataFrame:
    seen = observed_regions(_regions(spark, d), SPEC)
    m = match_regions(seen, library(spark, d), SPEC, "hamming", 3, 1)
    return m.groupBy("region_id", "match").agg(F.count(F.lit(1)).alias("n"), F.sum("n_matches").alias("hits"))


def merge_matches(spark: SparkSession, d: str) -> DataFrame:
    """Regions of which ten bases at either end were seen."""
    seq = clean_sequence(F.col("region1"))
    gap = F.concat(F.substr(seq, F.lit(1), F.lit(10)), F.lit("/"), F.right(seq, F.lit(10)))
    rows = table(spark, d, "expected").where("region1 is not null").select(
        F.lit("region1").alias("region_id"), gap.alias("seq"), F.lit("missing_center").alias("kind"), F.lit(10).alias("split")
    ).dropDuplicates()
    m = match_regions(rows, library(spark, d), SPEC, "hamming", 2, 1000)
    return m.select("seq", "match", "distance", F.array_join("hits", ",").alias("hits"))


def _shown(classified: DataFrame) -> DataFrame:
    return classified.select(
        F.col("grp").alias("group"), F.col("reg_region1.seq").alias("region1"), F.col("reg_region2.seq").alias("region2"), F.col("status"), "count",
        *c.combination_columns()[1:],
    )


def combination_status(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_classified(spark, d, library(spark, d)))


def multi_sublibrary_product(spark: SparkSession, d: str) -> DataFrame:
    """The two regions as libraries of their own, so that ids combine freely."""
    m = members(spark, d)
    parts = [m.select("_id", r) for r in ("region1", "region2")]
    return _shown(_classified(spark, d, compile_library(SPEC, *parts, check_ids=False), 2))


def library_counts(spark: SparkSession, d: str) -> DataFrame:
    return c.library_counts(_classified(spark, d, library(spark, d)), ["region1", "region2"])


def seq_diff_subs(spark: SparkSession, d: str) -> DataFrame:
    """Variants of regions that match one library sequence of their length."""
    out = _classified(spark, d, library(spark, d)).where((F.col("match_region1.match") == "match") & (F.col("match_region1.distance") > 0))
    return out.select(F.col("reg_region1.seq").alias("seq"), F.array_join("match_region1.hits", ",").alias("hit"), c.variants_column("region1").alias("variants")).dropDuplicates()


def hgvs_strings(spark: SparkSession, d: str) -> DataFrame:
    """Variants of all regions, those with insertions and deletions at an equal length included; null where nothing matches or all agrees."""
    out = cut(_classified(spark, d, library(spark, d), metric="levenshtein"))
    rows = [
        out.where(F.col(f"reg_{r}.seq").isNotNull()).select(
            F.lit(r).alias("region"), F.col(f"reg_{r}.seq").alias("seq"), F.array_join(f"match_{r}.hits", ",").alias("hit"), c.variants_column(r).alias("variants")
        )
        for r in ("region1", "region2")
    ]
    return rows[0].union(rows[1]).dropDuplicates()


def sorted_counts(spark: SparkSession, d: str) -> DataFrame:
    return sort_by_total(count_reads(spark, reads(spark, d), None, config=_long()).counts().select("group", "forward", "count"), place="place")


def sorted_library_counts(spark: SparkSession, d: str) -> DataFrame:
    return sort_by_total(library_counts(spark, d), place="place")


def sorted_filtered(spark: SparkSession, d: str) -> DataFrame:
    return sort_by_total(filtered_table(spark, d).drop("proportion"), place="place")


def merge_partials_union(spark: SparkSession, d: str) -> DataFrame:
    """Counts of reads with and without partner, made apart and merged."""
    e = reads(spark, d, True)
    every = reads(spark, d)
    single = every.join(e.select("read_no"), "read_no", "left_anti")
    parts = [count_combinations(p.withColumn("r_seq", F.lit(None).cast("string")), [], True) for p in (e, single)]
    return merge_counts(*parts).select(F.col("grp").alias("group"), F.col("f_seq").alias("forward"), "count")


def _run(spark: SparkSession, d: str) -> Counts:
    return count_reads(spark, reads(spark, d), SPEC, INFRAME, CONFIG).compare(library(spark, d))


def summary_table(spark: SparkSession, d: str) -> DataFrame:
    out = _run(spark, d).summary()
    return out.select("row_no", "group", "metric", "count", F.round("overall_proportion", 9).alias("overall_proportion"), F.round("group_proportion", 9).alias("group_proportion"))


def counts_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole counts output of paired reads found by pattern and matched by edit distance."""
    return count_reads(spark, reads(spark, d, True), SPEC, ExtractOptions("pattern", 8, 1), _long()).compare(library(spark, d), "bounded-levenshtein").counts()


QUERIES = {
    "full_read_counts": full_read_counts, "paired_full_read_counts": paired_full_read_counts, "grouped_counts": grouped_counts,
    "group_unmatched": group_unmatched, "revcomp_projection": revcomp_projection, "mean_quality": mean_qualities, "filter_cascade": filter_cascade,
    "filtered_table": filtered_table, "summary_table": summary_table, "max_reads": max_reads, "inframe_single": inframe_single,
    "inframe_paired_merge": inframe_paired_merge, "merge_missing_center": merge_missing_center, "merge_overlapping": merge_overlapping,
    "pattern_exact": pattern_exact, "pattern_tolerant": pattern_tolerant, "pattern_truncated": pattern_truncated, "pattern_paired": pattern_paired,
    "align_regions": align_regions, "align_filter": align_filter, "align_paired": align_paired, "library_dedup": library_dedup,
    "lookup_exact": _lookup("region1", FULL, "exact", 0),
    "lookup_exact_5p": _lookup("region2", HEAD, "exact", 0, 8),
    "lookup_hamming_full": _lookup("region1", FULL, "hamming", 3),
    "lookup_hamming_5p": _lookup("region2", HEAD, "hamming", 1, 9),
    "lookup_hamming_3p": _lookup("region2", TAIL, "hamming", 1, 9),
    "lookup_lev_full": _lookup("region2", FULL, "levenshtein", 2),
    "lookup_lev_5p": _lookup("region2", HEAD, "levenshtein", 1, 9),
    "lookup_lev_3p": _lookup("region2", TAIL, "levenshtein", 1, 9),
    "lookup_bounded_lev": _lookup("region1", FULL, "bounded-levenshtein", 2),
    "lookup_bounded_5p": _lookup("region2", HEAD, "bounded-levenshtein", 1, 9),
    "lookup_bounded_3p": _lookup("region2", TAIL, "bounded-levenshtein", 1, 9),
    "lookup_exact_3p": _lookup("region2", TAIL, "exact", 0, 8),
    "overmatched": overmatched, "merge_matches": merge_matches, "combination_status": combination_status,
    "multi_sublibrary_product": multi_sublibrary_product, "library_counts": library_counts, "seq_diff_subs": seq_diff_subs,
    "hgvs_strings": hgvs_strings, "sort_by_total": sorted_counts, "sort_library_counts": sorted_library_counts, "sort_filtered": sorted_filtered,
    "merge_partials_union": merge_partials_union, "counts_table": counts_table,
}

_FROM = r"""
e AS (SELECT DISTINCT rec_id AS read_no, 'cell=' || grp AS f_desc, coalesce(upper(trim(forward)), '') AS f_seq, upper(trim(reverse)) AS r_seq
      FROM expected WHERE rec_id IS NOT NULL),
reads AS (SELECT *, 'read' || read_no AS f_id, coalesce(nullif(regexp_extract('read' || read_no || coalesce(' ' || f_desc, ''), 'cell=(\w+)', 1), ''), '_unmatched_') AS grp,
          translate(f_seq, 'ACGTN', '5?FK#') AS f_qual, translate(r_seq, 'ACGTN', 'K5F?#') AS r_qual FROM e),
pairs AS (SELECT *, reverse(translate(r_seq, 'ACGTUNRYSWKMBDHV', 'TGCAANYRSWMKVHDB')) AS b_seq, reverse(r_qual) AS b_qual FROM reads WHERE r_seq IS NOT NULL)
"""


def _quality(text: str) -> str:
    total = f"list_sum(list_transform(string_split({text}, ''), lambda ch: ascii(ch)))"
    return f"(CASE WHEN length({text}) = 0 THEN CAST(0 AS REAL) ELSE CAST({total} AS REAL) / CAST(length({text}) AS REAL) - CAST(33 AS REAL) END)"


_REASON = f"""CASE WHEN f_seq = '' {{e}} THEN 'empty_read' WHEN length(f_seq) < 50 {{s}} THEN 'short_read'
 WHEN length(f_seq) > 80 {{l}} THEN 'long_read' WHEN {_quality('f_qual')} < CAST(31.2 AS REAL) {{q}} THEN 'low_mean_quality' END"""
_PAIR_REASON = _REASON.format(e="OR r_seq = ''", s="OR length(r_seq) < 50", l="OR length(r_seq) > 80", q=f"OR {_quality('r_qual')} < CAST(31.2 AS REAL)")
_SINGLE_REASON = _REASON.format(e="", s="", l="", q="")

_INFRAME = """
CASE WHEN length(f_seq) > 42 THEN f_seq[15:42] WHEN length(f_seq) > 14 THEN f_seq[15:] || '^' END AS region1,
CASE WHEN length(f_seq) > 72 THEN f_seq[61:72] WHEN length(f_seq) > 60 THEN f_seq[61:] || '^' END AS region2
"""

# forward and reverse evidence of both regions: f, r the bases, fk, rk how complete
_CUT = "cutted AS (SELECT * REPLACE (substr(f_seq, 1, CAST(18 + read_no % 24 AS BIGINT)) AS f_seq, substr(f_qual, 1, CAST(18 + read_no % 24 AS BIGINT)) AS f_qual) FROM pairs)"
_EVIDENCE = f"""
v AS (SELECT read_no, 28 AS size1, 12 AS size2,
  CASE WHEN length(f_seq) > 42 THEN f_seq[15:42] WHEN length(f_seq) > 14 THEN f_seq[15:] END AS f1,
  CASE WHEN length(f_seq) > 42 THEN 'c' WHEN length(f_seq) > 14 THEN '3' END AS fk1,
  CASE WHEN length(r_seq) > 66 THEN b_seq[length(r_seq)-65:length(r_seq)-38] WHEN length(r_seq) > 38 THEN b_seq[1:length(r_seq)-38] END AS r1,
  CASE WHEN length(r_seq) > 66 THEN 'c' WHEN length(r_seq) > 38 THEN '5' END AS rk1,
  CASE WHEN length(f_seq) > 72 THEN f_seq[61:72] WHEN length(f_seq) > 60 THEN f_seq[61:] END AS f2,
  CASE WHEN length(f_seq) > 72 THEN 'c' WHEN length(f_seq) > 60 THEN '3' END AS fk2,
  CASE WHEN length(r_seq) > 20 THEN b_seq[length(r_seq)-19:length(r_seq)-8] WHEN length(r_seq) > 8 THEN b_seq[1:length(r_seq)-8] END AS r2,
  CASE WHEN length(r_seq) > 20 THEN 'c' WHEN length(r_seq) > 8 THEN '5' END AS rk2,
  {_quality('f_qual[15:42]')} AS fq1, {_quality('b_qual[length(r_seq)-65:length(r_seq)-38]')} AS rq1,
  {_quality('f_qual[61:72]')} AS fq2, {_quality('b_qual[length(r_seq)-19:length(r_seq)-8]')} AS rq2
  FROM pairs)
"""


def _merged(i: int) -> str:
    f, r, fk, rk = f"f{i}", f"r{i}", f"fk{i}", f"rk{i}"
    return f"""CASE WHEN {fk} IS NULL THEN {r} || CASE WHEN {rk} = '3' THEN '^' ELSE '' END
 WHEN {rk} IS NULL THEN {f} || CASE WHEN {fk} = '3' THEN '^' ELSE '' END
 WHEN {fk} = 'c' AND {rk} = 'c' THEN CASE WHEN rq{i} > fq{i} THEN {r} ELSE {f} END
 WHEN {fk} = 'c' THEN {f} WHEN {rk} = 'c' THEN {r} ELSE {f} || '/' || {r} END"""


def _shown_merged(i: int) -> str:
    # a lone fragment of the reverse read lacks its 5' end
    return f"CASE WHEN fk{i} IS NULL AND rk{i} = '5' THEN '^' || r{i} ELSE {_merged(i)} END"


def _pattern(source: str, tolerance: int) -> str:
    def fits(flank: str) -> str:
        return f"list_filter(range(1, CAST(greatest(length(s) - 6, 1) AS BIGINT)), lambda i: hamming(substr(s, CAST(i AS BIGINT), 8), '{flank}') <= {tolerance})"

    first = lambda places, start: f"list_min(list_filter({places}, lambda i: i >= {start}))"
    return f"""
src AS ({source}),
w AS (SELECT read_no, s, {fits('CAGCCCGG')} AS b1, {fits('GGATCTAG')} AS a1, {fits('CTGCGTCA')} AS b2, {fits('CAGTGACT')} AS a2 FROM src),
o AS (SELECT *, least(list_min(b1) * 4, list_min(a1) * 4 + 1, list_min(b2) * 4 + 2, list_min(a2) * 4 + 3) AS code FROM w),
p AS (SELECT *, code // 4 AS pos, code % 4 AS what FROM o),
q AS (SELECT *, CASE WHEN what = 0 THEN {first('a1', 'pos + 8')} WHEN what = 1 THEN pos END AS close1 FROM p),
t AS (SELECT *, CASE WHEN what <= 1 THEN {first('b2', 'close1')} WHEN what = 2 THEN pos END AS open2 FROM q),
z AS (SELECT *, {first('a2', 'open2 + 8')} AS close2 FROM t)
SELECT read_no,
  CASE WHEN what = 0 AND close1 IS NULL THEN substr(s, pos + 8) || '^' WHEN what = 0 THEN substr(s, pos + 8, close1 - pos - 8) WHEN what = 1 THEN '^' || substr(s, 1, pos - 1) END AS region1,
  CASE WHEN what = 3 THEN '^' || substr(s, 1, pos - 1) WHEN open2 IS NULL THEN NULL WHEN close2 IS NULL THEN substr(s, open2 + 8) || '^' ELSE substr(s, open2 + 8, close2 - open2 - 8) END AS region2
FROM z
"""


_LIB = """lib AS (SELECT _id, upper(trim(region1)) AS region1, upper(trim(region2)) AS region2 FROM library
UNION ALL SELECT 'alt_' || _id, upper(trim(region1)), upper(trim(region2)) FROM library WHERE member_no % 10 = 0)"""


def _search(probe: str, name: str, shown: str, test: str, distance: int, value: str) -> str:
    return f"""
WITH {_LIB}, p AS (SELECT DISTINCT {probe} AS seq FROM (SELECT upper(trim({name})) AS x FROM expected WHERE {name} IS NOT NULL)),
l AS (SELECT DISTINCT {name} AS hit FROM lib WHERE {name} IS NOT NULL),
x AS (SELECT seq, hit, 0 AS distance FROM p JOIN l ON seq = hit),
rest AS (SELECT seq FROM p WHERE seq NOT IN (SELECT seq FROM x)),
s AS (SELECT seq, hit, {shown} AS shown FROM rest, l WHERE {test}),
y AS (SELECT seq, hit, {value} AS distance FROM s),
a AS (SELECT * FROM x UNION ALL SELECT * FROM y WHERE distance <= {distance}),
m AS (SELECT seq, min(distance) AS distance FROM a GROUP BY seq)
SELECT seq, CAST(distance AS BIGINT) AS distance, string_agg(hit, ',' ORDER BY hit) AS hits FROM a JOIN m USING (seq, distance) GROUP BY seq, distance
"""


_HAMMING = "CASE WHEN length(seq) = 0 THEN 0 ELSE hamming(seq, shown) END"


def _region_matches(limit1: int = 3, limit2: int = 1) -> str:
    """CTEs m1, m2: distance, number and ids of the nearest library sequences of every distinct region in table o."""
    def one(i: int, limit: int) -> str:
        r = f"region{i}"
        return f"""
d{i} AS (SELECT o.seq, l.hit, CASE WHEN length(o.part) = 0 THEN 0 ELSE hamming(o.part, l.hit[1:length(o.part)]) END AS d
  FROM (SELECT DISTINCT {r} AS seq, rtrim({r}, '^') AS part, {r} LIKE '%^' AS open FROM o WHERE {r} IS NOT NULL) o
  JOIN (SELECT DISTINCT {r} AS hit FROM lib WHERE {r} IS NOT NULL) l ON length(o.part) = length(l.hit) OR (o.open AND length(o.part) < length(l.hit))),
b{i} AS (SELECT seq, min(d) AS d FROM d{i} WHERE d <= {limit} GROUP BY seq),
h{i} AS (SELECT seq, d, hit FROM d{i} JOIN b{i} USING (seq, d)),
m{i} AS (SELECT h.seq, h.d, count(DISTINCT hit) AS n, list_sort(list_distinct(list(lib._id))) AS ids, string_agg(DISTINCT hit, ',' ORDER BY hit) AS hits
  FROM h{i} h JOIN lib ON lib.{r} = h.hit GROUP BY h.seq, h.d)"""

    return f"{_LIB}, {one(1, limit1)}, {one(2, limit2)}"


_OWN = """
own AS (SELECT DISTINCT rec_id, coalesce(grp, '') AS grp, upper(trim(region1)) AS region1, upper(trim(region2)) AS region2 FROM expected WHERE rec_id IS NOT NULL),
o AS (SELECT grp, region1, region2, CAST(count(*) AS BIGINT) AS count FROM own GROUP BY ALL)
"""
_STATUS = f"""
k AS (SELECT o.*, m1.d AS d1, m1.n AS n1, m1.ids AS ids1, m1.hits AS hits1, m2.d AS d2, m2.n AS n2, m2.ids AS ids2, m2.hits AS hits2
  FROM o LEFT JOIN m1 ON o.region1 = m1.seq LEFT JOIN m2 ON o.region2 = m2.seq),
j AS (SELECT *, CASE WHEN region1 IS NULL THEN 'nonmatch' WHEN n1 IS NULL OR n1 > 10 THEN 'mismatch' WHEN region2 IS NULL THEN 'nonmatch'
  WHEN n2 IS NULL OR n2 > 10 THEN 'mismatch' END AS early, list_sort(list_intersect(ids1, ids2)) AS common FROM k),
st AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN len(common) = 0 THEN 'recombination' WHEN len(common) = 1 THEN 'match' ELSE 'multimatch' END AS status FROM j)
"""

SQL = {
    "full_read_counts": f"WITH {_FROM} SELECT f_seq AS forward, CAST(count(*) AS BIGINT) AS count FROM reads WHERE f_seq <> '' GROUP BY 1",
    "paired_full_read_counts": f"""WITH {_FROM} SELECT grp AS "group", f_seq AS forward, r_seq AS reverse, CAST(count(*) AS BIGINT) AS count FROM pairs
WHERE f_seq <> '' AND r_seq <> '' GROUP BY ALL""",
    "grouped_counts": f"WITH {_FROM} SELECT grp, CAST(count(*) AS BIGINT) AS n FROM reads GROUP BY 1",
    "group_unmatched": rf"""WITH {_FROM} SELECT coalesce(nullif(regexp_extract(f_id || coalesce(' ' || f_desc, ''), 'plate(\d+)_A', 1), ''), '_unmatched_') AS grp,
CAST(count(*) AS BIGINT) AS n FROM reads GROUP BY 1""",
    "revcomp_projection": f"WITH {_FROM} SELECT read_no, b_seq AS turned, b_qual AS turned_quality FROM pairs",
    "mean_quality": f"WITH {_FROM} SELECT read_no, round(CAST({_quality('f_qual')} AS DOUBLE), 3) AS quality FROM reads",
    "filter_cascade": f"WITH {_FROM} SELECT {_PAIR_REASON} AS reason, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY 1",
    "filtered_table": f"""WITH {_FROM}, d AS (SELECT *, {_PAIR_REASON} AS reason FROM pairs), x AS (SELECT * FROM d WHERE reason IS NOT NULL), n AS (SELECT count(*) AS n FROM x)
SELECT grp AS "group", f_seq AS forward, r_seq AS reverse, CAST(count(*) AS BIGINT) AS count, round(CAST(count(*) AS DOUBLE) / max(n), 9) AS proportion,
{", ".join(f"CAST(count(*) FILTER (reason = '{r}') AS BIGINT) AS {r}" for r in ("empty_read", "short_read", "long_read", "low_mean_quality", "bad_alignment"))}
FROM x, n GROUP BY grp, f_seq, r_seq""",
    "max_reads": f"""WITH {_FROM}, first AS (SELECT * FROM reads ORDER BY read_no LIMIT 5000)
SELECT grp AS "group", f_seq AS forward, CAST(count(*) AS BIGINT) AS count FROM first WHERE f_seq <> '' GROUP BY ALL""",
    "inframe_single": f"WITH {_FROM} SELECT read_no, {_INFRAME} FROM reads",
    "inframe_paired_merge": f"WITH {_FROM}, {_EVIDENCE} SELECT read_no, {_shown_merged(1)} AS region1, {_shown_merged(2)} AS region2 FROM v",
    "merge_missing_center": f"""WITH {_FROM}, {_CUT}, {_EVIDENCE.replace('FROM pairs', 'FROM cutted')} SELECT read_no, f1 || '/' || r1 AS region1, CAST(length(f1) AS INTEGER) AS split FROM v
WHERE fk1 = '3' AND rk1 = '5' AND greatest(28 - length(r1), 0) >= length(f1)""",
    "merge_overlapping": f"""WITH {_FROM}, {_CUT}, {_EVIDENCE.replace('FROM pairs', 'FROM cutted')} SELECT read_no, f1 || '/' || r1 AS region1, CAST(length(f1) AS INTEGER) AS split FROM v
WHERE fk1 = '3' AND rk1 = '5' AND greatest(28 - length(r1), 0) < length(f1)""",
    "pattern_exact": f"WITH {_FROM}, " + _pattern("SELECT read_no, f_seq AS s FROM reads", 0),
    "pattern_tolerant": f"WITH {_FROM}, " + _pattern("SELECT read_no, f_seq AS s FROM reads", 1),
    "pattern_truncated": f"WITH {_FROM}, " + _pattern("SELECT read_no, substr(f_seq, 25) AS s FROM reads", 1),
    "library_dedup": f"""WITH {_LIB} SELECT 'region1' AS region_id, region1 AS seq, string_agg(_id, ',' ORDER BY _id) AS ids FROM lib WHERE region1 IS NOT NULL GROUP BY region1
UNION ALL SELECT 'region2', region2, string_agg(_id, ',' ORDER BY _id) FROM lib WHERE region2 IS NOT NULL GROUP BY region2""",
    "lookup_exact": _search("x", "region1", "hit", "length(hit) = length(seq)", 0, _HAMMING),
    "lookup_exact_5p": _search("x[1:8]", "region2", "hit[1:length(seq)]", "length(hit) >= length(seq)", 0, _HAMMING),
    "lookup_hamming_full": _search("x", "region1", "hit", "length(hit) = length(seq)", 3, _HAMMING),
    "lookup_hamming_5p": _search("x[1:9]", "region2", "hit[1:length(seq)]", "length(hit) >= length(seq)", 1, _HAMMING),
    "lookup_hamming_3p": _search("right(x, 9)", "region2", "right(hit, length(seq))", "length(hit) >= length(seq)", 1, _HAMMING),
    "lookup_lev_full": _search("x", "region2", "hit", "abs(length(hit) - length(seq)) <= 2", 2, "levenshtein(seq, shown)"),
    "lookup_lev_5p": _search("x[1:9]", "region2", "hit[1:least(length(seq), length(hit))]", "length(seq) - length(hit) <= 1", 1, "levenshtein(seq, shown)"),
    "lookup_lev_3p": _search("right(x, 9)", "region2", "right(hit, least(length(seq), length(hit)))", "length(seq) - length(hit) <= 1", 1, "levenshtein(seq, shown)"),
    "lookup_bounded_lev": _search("x", "region1", "hit", "abs(length(hit) - length(seq)) <= 2", 2, "levenshtein(seq, shown)"),
    "lookup_bounded_5p": _search("x[1:9]", "region2", "hit[1:least(length(seq), length(hit))]", "length(seq) - length(hit) <= 1", 1, "levenshtein(seq, shown)"),
    "lookup_bounded_3p": _search("right(x, 9)", "region2", "right(hit, least(length(seq), length(hit)))", "length(seq) - length(hit) <= 1", 1, "levenshtein(seq, shown)"),
    "lookup_exact_3p": _search("right(x, 8)", "region2", "right(hit, length(seq))", "length(hit) >= length(seq)", 0, _HAMMING),
    "overmatched": f"""WITH {_OWN}, {_region_matches()}, u AS (
SELECT 'region1' AS region_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT region1 AS seq FROM o WHERE region1 IS NOT NULL) LEFT JOIN m1 USING (seq)
UNION ALL SELECT 'region2', coalesce(n, 0) FROM (SELECT DISTINCT region2 AS seq FROM o WHERE region2 IS NOT NULL) LEFT JOIN m2 USING (seq))
SELECT region_id, CASE WHEN n = 0 THEN 'unmatched' WHEN n = 1 THEN 'match' ELSE 'overmatched' END AS match, CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS hits FROM u GROUP BY 1, 2""",
    "combination_status": f"""WITH {_OWN}, {_region_matches()}, {_STATUS} SELECT grp AS "group", region1, region2, status, count,
CAST(CASE WHEN status IN ('match', 'multimatch', 'recombination') THEN d1 + d2 END AS BIGINT) AS combination_distance,
CAST(CASE WHEN status IN ('match', 'multimatch') THEN len(common) ELSE 0 END AS BIGINT) AS combinations_in_library,
CASE WHEN status IN ('match', 'multimatch') THEN array_to_string(common, ',') END AS combination_id FROM st""",
    "multi_sublibrary_product": f"""WITH {_OWN}, {_region_matches()}, {_STATUS}, z AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN len(ids1) <= 1 AND len(ids2) <= 1 THEN 'match' ELSE 'multimatch' END AS s2 FROM j)
SELECT grp AS "group", region1, region2, s2 AS status, count, CAST(CASE WHEN early IS NULL THEN d1 + d2 END AS BIGINT) AS combination_distance,
CAST(CASE WHEN early IS NULL THEN len(ids1) * len(ids2) ELSE 0 END AS BIGINT) AS combinations_in_library,
CASE WHEN early IS NULL THEN array_to_string(ids1, ',') || '/' || array_to_string(ids2, ',') END AS combination_id FROM z""",
    "library_counts": f"""WITH {_OWN}, {_region_matches()}, {_STATUS},
g AS (SELECT grp, CASE WHEN n1 <= 10 THEN hits1 END AS region1, CASE WHEN n2 <= 10 THEN hits2 END AS region2, coalesce(n1 > 10, false) AS o1, coalesce(n2 > 10, false) AS o2,
  CAST(sum(count) AS BIGINT) AS count, arg_min(struct_pack(s := status, b := common), CASE WHEN status = 'mismatch' THEN 0 ELSE 1 END) AS x FROM st GROUP BY 1, 2, 3, 4, 5)
SELECT grp AS "group", region1, region2, CASE WHEN x.s = 'multimatch' THEN 'match' ELSE x.s END AS combination_status,
CAST(CASE WHEN x.s IN ('match', 'multimatch') THEN len(x.b) ELSE 0 END AS BIGINT) AS combinations_in_library,
CASE WHEN x.s IN ('match', 'multimatch') THEN array_to_string(x.b, ',') END AS combination_id, count FROM g""",
    "seq_diff_subs": f"""WITH {_OWN}, {_region_matches()}, u AS (SELECT DISTINCT seq, hits AS hit FROM m1 WHERE n = 1 AND d > 0)
SELECT seq, hit, array_to_string(list_filter(list_transform(range(1, CAST(length(seq) + 1 AS BIGINT)), lambda i: CASE WHEN substr(seq, CAST(i AS BIGINT), 1) <> substr(hit, CAST(i AS BIGINT), 1)
THEN i || substr(hit, CAST(i AS BIGINT), 1) || '>' || substr(seq, CAST(i AS BIGINT), 1) END), lambda t: t IS NOT NULL), ';') AS variants FROM u""",
    "sort_by_total": f"""WITH {_FROM}, x AS (SELECT grp AS "group", f_seq AS forward, CAST(count(*) AS BIGINT) AS count FROM reads WHERE f_seq <> '' GROUP BY ALL),
y AS (SELECT *, sum(count) OVER (PARTITION BY forward) AS t FROM x) SELECT "group", forward, count, row_number() OVER (ORDER BY t DESC, forward NULLS FIRST, "group" NULLS FIRST) AS place FROM y""",
    "merge_partials_union": f"""WITH {_FROM} SELECT grp AS "group", f_seq AS forward, CAST(count(*) AS BIGINT) AS count FROM reads GROUP BY ALL""",
    "summary_table": f"""WITH {_FROM}, dd AS (SELECT *, {_SINGLE_REASON} AS reason FROM reads),
o AS (SELECT grp, region1, region2, CAST(count(*) AS BIGINT) AS count FROM (SELECT grp, {_INFRAME} FROM dd WHERE reason IS NULL) GROUP BY ALL),
{_region_matches()}, {_STATUS},
cat AS (SELECT 'unfiltered' AS g, CASE status WHEN 'match' THEN CASE WHEN d1 + d2 = 0 THEN 'exact_match' ELSE 'nearest_match' END
  WHEN 'recombination' THEN CASE WHEN d1 + d2 = 0 THEN 'exact_recombination' ELSE 'nearest_recombination' END ELSE status END AS m, sum(count) AS n FROM st GROUP BY 1, 2
  UNION ALL SELECT 'filtered', reason, count(*) FROM dd WHERE reason IS NOT NULL GROUP BY 1, 2),
al AS (SELECT * FROM cat UNION ALL SELECT g, 'total', sum(n) FROM cat GROUP BY 1 UNION ALL SELECT 'all', 'total', sum(n) FROM cat),
rr AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{g}', '{m}')" for i, (g, m) in enumerate(c.SUMMARY_ROWS))}) t(row_no, g, m)),
f AS (SELECT row_no, g, m, coalesce(n, 0) AS n FROM rr LEFT JOIN al USING (g, m)),
tot AS (SELECT g, n AS t FROM f WHERE m = 'total'), every AS (SELECT n AS a FROM f WHERE g = 'all')
SELECT CAST(row_no AS INTEGER) AS row_no, g AS "group", m AS metric, CAST(n AS BIGINT) AS count, round(CASE WHEN a = 0 THEN 0.0 ELSE CAST(n AS DOUBLE) / a END, 9) AS overall_proportion,
round(CASE WHEN t = 0 THEN 0.0 ELSE CAST(n AS DOUBLE) / t END, 9) AS group_proportion FROM f JOIN tot USING (g), every""",
    "merge_matches": f"""WITH {_LIB}, p AS (SELECT DISTINCT x[1:10] AS a, right(x, 10) AS b FROM (SELECT upper(trim(region1)) AS x FROM expected WHERE region1 IS NOT NULL)),
l AS (SELECT DISTINCT region1 AS hit FROM lib WHERE region1 IS NOT NULL),
ha AS (SELECT a, hit, hamming(a, hit[1:length(a)]) AS d FROM (SELECT DISTINCT a FROM p), l WHERE length(hit) >= length(a) AND hamming(a, hit[1:length(a)]) <= 2),
hb AS (SELECT b, hit, hamming(b, right(hit, length(b))) AS d FROM (SELECT DISTINCT b FROM p), l WHERE length(hit) >= length(b) AND hamming(b, right(hit, length(b))) <= 2),
ba AS (SELECT a, min(d) AS d FROM ha GROUP BY a), bb AS (SELECT b, min(d) AS d FROM hb GROUP BY b),
na AS (SELECT a, d, list(hit) AS hits FROM ha JOIN ba USING (a, d) GROUP BY a, d), nb AS (SELECT b, d, list(hit) AS hits FROM hb JOIN bb USING (b, d) GROUP BY b, d),
j AS (SELECT a || '/' || b AS seq, coalesce(list_sort(list_intersect(na.hits, nb.hits)), []) AS hits, na.d + nb.d AS d FROM p LEFT JOIN na USING (a) LEFT JOIN nb USING (b))
SELECT seq, CASE WHEN len(hits) = 0 THEN 'unmatched' WHEN len(hits) = 1 THEN 'match' ELSE 'multimatch' END AS match, CAST(CASE WHEN len(hits) > 0 THEN d END AS BIGINT) AS distance,
CASE WHEN len(hits) > 0 THEN array_to_string(hits, ',') END AS hits FROM j""",
}
_KEYS = "region1, region2, combination_status, combinations_in_library, combination_id"
SQL["sort_library_counts"] = f"""WITH x AS ({SQL['library_counts']}), y AS (SELECT *, sum(count) OVER (PARTITION BY {_KEYS}) AS t FROM x)
SELECT * EXCLUDE (t), row_number() OVER (ORDER BY t DESC, {", ".join(k + " NULLS FIRST" for k in _KEYS.split(", "))}, "group" NULLS FIRST) AS place FROM y"""
SQL["sort_filtered"] = f"""WITH x AS ({SQL['filtered_table']}), y AS (SELECT *, sum(count) OVER (PARTITION BY forward, reverse) AS t FROM x)
SELECT * EXCLUDE (t, proportion), row_number() OVER (ORDER BY t DESC, forward NULLS FIRST, reverse NULLS FIRST, "group" NULLS FIRST) AS place FROM y"""
