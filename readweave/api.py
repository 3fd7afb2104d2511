"""The engine: reads through filters, extraction, counting and comparison to the four outputs."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readweave.errors import OptionError
from readweave.operators import classify as c
from readweave.operators import outputs
from readweave.operators.extract import ExtractOptions, alignment_scores, extract, region_columns
from readweave.operators.filters import FilterConfig, filtered_counts, with_reason
from readweave.operators.library import homes_of, match_regions
from readweave.operators.observe import count_combinations, merge_counts, observed_regions, preaggregate_reads
from readweave.operators.spec import LibrarySpec
from readweave.session import cut


@dataclass
class Counts:
    """What one run knows, as lazy tables."""

    spark: SparkSession
    spec: LibrarySpec | None
    region_ids: list[str]
    combinations: DataFrame
    filtered: DataFrame
    classified: DataFrame | None = None
    with_variants: bool = True
    config: FilterConfig = FilterConfig()
    stored: bool = False

    @property
    def compared(self) -> bool:
        return self.classified is not None

    def n_combinations(self) -> int:
        """Number of distinct combinations."""
        return self.combinations.count()

    def is_empty(self) -> bool:
        return self.combinations.isEmpty()

    def total_filtered(self) -> int:
        """Number of reads the filters dropped."""
        return int(self.filtered.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])

    def merge(self, other: Counts) -> Counts:
        """Counts of two runs with one specification, before comparison."""
        if self.compared or other.compared:
            raise OptionError("compared counts cannot be merged")
        if self.region_ids != other.region_ids:
            raise OptionError("the counts have different regions")
        if self.config != other.config:
            raise OptionError("the counts were made with different filters")
        filtered = self.filtered.unionByName(other.filtered).drop("proportion")
        keys = ["group", "forward", "reverse"]
        sums = [F.sum(x).cast("bigint").alias(x) for x in filtered.columns if x not in keys]
        filtered = filtered.groupBy(*keys).agg(*sums)
        total = filtered.agg(F.sum("count").alias("t")).scalar()
        filtered = filtered.withColumn("proportion", F.col("count") / F.nullif(total, F.lit(0)))
        return replace(self, combinations=merge_counts(self.combinations, other.combinations), filtered=filtered.select(self.filtered.columns))

    def compare(self, library: DataFrame, metric: str = "hamming", max_distance: int = 3, max_matches: int = 10, with_variants: bool = True) -> Counts:
        """Match all observed regions to the compiled library and classify the combinations: a lazy plan, in which the
        combinations are made once however often they are read."""
        if self.spec is None:
            raise OptionError("a library needs a specification")
        n = max(homes_of(library).values(), default=-1) + 1
        matched = self.combinations
        if self.region_ids:
            matches = match_regions(observed_regions(matched, self.spec), library, self.spec, metric, max_distance, max_matches)
            matched = c.with_matches(matched, matches, self.region_ids)
        return replace(self, classified=c.classify(matched, self.region_ids, n), with_variants=with_variants, stored=False)

    def written(self) -> Counts:
        """The same counts with their tables written once to the checkpoint folder, for all that read them after."""
        if self.stored:
            return self
        name = "classified" if self.compared else "combinations"
        return replace(self, **{name: cut(getattr(self, name))}, filtered=cut(self.filtered), stored=True)

    def counts(self) -> DataFrame:
        return outputs.counts_table(self.classified if self.compared else self.combinations, self.region_ids, self.compared, self.with_variants)

    def library_counts(self) -> DataFrame:
        if self.classified is None:
            raise OptionError("library counts need a comparison")
        return c.library_counts(self.classified, self.region_ids)

    def summary(self) -> DataFrame:
        if self.classified is None:
            plain = self.combinations.withColumn("status", F.lit("uncompared")).withColumn("total_distance", F.lit(None).cast("bigint"))
        else:
            plain = self.classified
        return c.summary(self.spark, plain, self.filtered)

    def write(self, base: str, sort: bool = False, overwrite: bool = False, parts: bool = False) -> None:
        """Write the outputs as <base>.<name>.tsv through the driver, or with ``parts`` as folders <base>.<name> by the executors."""
        outputs.guard_outputs(base, overwrite, parts)
        out, paths = self.written(), outputs.output_paths(base, parts)
        tables = {"counts": out.counts(), "filtered": out.filtered, "summary": out.summary().orderBy("row_no").drop("row_no")}
        if self.compared:
            tables["library_counts"] = out.library_counts()
        for name, df in tables.items():
            ordered = outputs.sort_by_total(df) if sort and name != "summary" else df
            if parts:
                outputs.write_parts(ordered, paths[name], overwrite)
            else:
                outputs.write_tsv(ordered, paths[name])


def count_reads(
    spark: SparkSession, reads: DataFrame, spec: LibrarySpec | None = None, options: ExtractOptions = ExtractOptions(),
    config: FilterConfig = FilterConfig(), full_seq: bool = False, paired: bool | None = None, alignment_tolerance: float | None = None,
    write_once: bool = False, observation: Observation | None = None,
) -> Counts:
    """Count region combinations of ``reads`` (columns f_seq, f_qual, grp and, if paired, r_seq, r_qual).

    Without a specification whole reads are counted. ``paired`` defaults to whether the reads
    have an ``r_seq`` column. Single-end reads are reduced to distinct ones before pattern
    search and alignment. Alignment tells what is counted and what is dropped: where both are
    wanted, ``write_once`` writes the aligned reads to the checkpoint folder (by a job of its
    own), else each of the two aligns when it is read. ``observation`` receives the numbers of
    ``reads`` and of ``filtered`` reads while the counts are made.
    """
    if paired is None:
        paired = "r_seq" in reads.columns
    if not paired:
        reads = reads.withColumn("r_seq", F.lit(None).cast("string")).withColumn("r_qual", F.lit(None).cast("string"))
    mode = "full-read" if spec is None else options.mode
    if alignment_tolerance is not None:
        if mode == "align" and spec is not None:
            low, back = alignment_scores(spec, options, alignment_tolerance, paired)
            config = replace(config, min_forward_score=low, min_reverse_score=back if paired else None)
        else:
            warnings.warn("the alignment tolerance has no effect without alignment", stacklevel=2)
    judged = with_reason(reads, config)
    if observation is not None:
        judged = judged.observe(observation, F.count(F.lit(1)).alias("reads"), F.count("reason").alias("filtered"))
    kept = judged.where(F.col("reason").isNull()).drop("reason")
    dropped = judged.where(F.col("reason").isNotNull()).select("grp", "f_seq", "r_seq", "reason", F.lit(1).alias("n"))
    whole = mode == "full-read"
    names = [] if whole else region_columns(spec)
    weight = None
    if mode in ("pattern", "align") and not paired:
        kept = preaggregate_reads(kept, ["grp", "f_seq", "r_seq"]).withColumn("f_qual", F.lit("")).withColumn("r_qual", F.lit(None).cast("string"))
        weight = "n"
    extracted = extract(kept, None if whole else spec, options, paired, config)
    if mode == "align" and not whole:
        if write_once:
            extracted = cut(extracted)
        more = extracted.where(F.col("reason").isNotNull()).select("grp", "f_seq", "r_seq", "reason", (F.col("n") if weight else F.lit(1)).alias("n"))
        dropped = dropped.unionByName(more)
        extracted = extracted.where(F.col("reason").isNull())
    combinations = count_combinations(extracted, names, full_seq or whole, weight)
    return Counts(spark, spec, [n.removeprefix("reg_") for n in names], combinations, filtered_counts(dropped, "n"), config=config)
