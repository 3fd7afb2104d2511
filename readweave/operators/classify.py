"""Classification of region combinations against libraries, and the summaries that follow."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readweave.functions.alignment import variants as variants_text
from readweave.functions.exprs import safe_divide
from readweave.operators.filters import REASONS
from readweave.operators.library import MATCH, MULTI, NO_LIBRARY, OVER, UNMATCHED, product_of_sizes

UNCOMPARED, RECOMBINATION, MISMATCH, NONMATCH = "uncompared", "recombination", "mismatch", "nonmatch"
#: Rows of the summary in their order.
SUMMARY_ROWS = (
    ("all", "total"),
    *(("unfiltered", m) for m in (
        "total", "uncompared", "exact_match", "nearest_match", "multimatch", "exact_recombination", "nearest_recombination", "mismatch", "nonmatch",
    )),
    ("filtered", "total"),
    *(("filtered", r) for r in REASONS),
)


def with_matches(combinations: DataFrame, matches: DataFrame, region_ids: list[str]) -> DataFrame:
    """Join each region's match to the combinations as ``match_<id>`` structs; null where the region was not seen."""
    out = combinations
    for r in region_ids:
        m = matches.where(F.col("region") == r).select(
            F.col("seq").alias("__s"), F.col("kind").alias("__k"), F.col("split").alias("__p"),
            F.struct("match", "distance", "n_matches", "hits", "ids", "sublib").alias(f"match_{r}"),
        )
        reg = F.col(f"reg_{r}")
        on = (reg["seq"] == F.col("__s")) & (reg["kind"] == F.col("__k")) & reg["split"].eqNullSafe(F.col("__p"))
        out = out.join(m, on, "left").drop("__s", "__k", "__p")
    return out


def classify(matched: DataFrame, region_ids: list[str], n_sublibs: int) -> DataFrame:
    """Add ``status, total_distance, id_sets``: how the regions' matches fit together.

    Regions are judged in their order: the first one that was not seen makes a nonmatch, the
    first one without a usable library match a mismatch; regions outside all libraries are
    passed over. Else the member ids of each library are intersected over its regions: an
    empty set makes a recombination, single members a match, several a multimatch; no library
    touched is a nonmatch.
    """
    verdict = F.lit(None).cast("string")
    for r in reversed(region_ids):
        reg, m = F.col(f"reg_{r}"), F.col(f"match_{r}")
        verdict = F.when(reg.isNull(), NONMATCH).when(m["match"].isin(UNMATCHED, OVER), MISMATCH).otherwise(verdict)
    if not region_ids:
        verdict = F.lit(NONMATCH)
    used = [F.when(F.col(f"match_{r}.match").isin(MATCH, MULTI), F.col(f"match_{r}")) for r in region_ids]
    distance = reduce(lambda a, b: a + b, [F.coalesce(u["distance"], F.lit(0)) for u in used], F.lit(0).cast("bigint"))
    sets = []
    for k in range(n_sublibs):
        own = F.array_compact(F.array(*[F.when(u["sublib"] == k, u["ids"]) for u in used])) if used else F.array().cast("array<array<string>>")
        sets.append(F.when(F.size(own) > 0, F.aggregate(own, F.get(own, F.lit(0)), lambda x, y: F.array_intersect(x, y))))
    id_sets = F.array(*sets) if sets else F.array().cast("array<array<string>>")
    touched = F.exists(id_sets, lambda s: s.isNotNull())
    empty = F.exists(id_sets, lambda s: s.isNotNull() & (F.size(s) == 0))
    several = F.exists(id_sets, lambda s: s.isNotNull() & (F.size(s) > 1))
    status = (
        F.when(verdict.isNotNull(), verdict).when(~touched, NONMATCH).when(empty, RECOMBINATION).when(several, MULTI).otherwise(MATCH)
    )
    out = matched.withColumn("id_sets", id_sets).withColumn("status", status)
    found = F.col("status").isin(MATCH, MULTI)
    return out.withColumn("total_distance", F.when(found | (F.col("status") == RECOMBINATION), distance)).withColumn(
        "id_sets", F.when(found, F.transform("id_sets", lambda s: F.array_sort(s)))
    )


def combination_columns(status: str = "status") -> list[Column]:
    """Columns of a classified combination as the outputs show them; a multimatch is shown as a match of several."""
    s = F.col(status)
    found = s.isin(MATCH, MULTI)
    ids = F.array_join(F.transform("id_sets", lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), ",")), "/")
    return [
        F.when(s == MULTI, MATCH).otherwise(s).alias("combination_status"),
        F.col("total_distance").alias("combination_distance"),
        F.when(s == UNCOMPARED, None).when(found, product_of_sizes(F.col("id_sets"))).otherwise(F.lit(0)).cast("bigint").alias("combinations_in_library"),
        F.when(found, ids).alias("combination_id"),
    ]


def category() -> Column:
    """The summary's row of a classified combination."""
    s, d = F.col("status"), F.col("total_distance")
    return (
        F.when(s == MATCH, F.when(d == 0, "exact_match").otherwise("nearest_match"))
        .when(s == MULTI, "multimatch")
        .when(s == RECOMBINATION, F.when(d == 0, "exact_recombination").otherwise("nearest_recombination"))
        .otherwise(s)
    )


def summary(spark: SparkSession, combinations: DataFrame, filtered: DataFrame | None) -> DataFrame:
    """The 16 rows of the summary: ``row_no, group, metric, count, overall_proportion, group_proportion``.

    The combinations are read once: their categories (seven at most) and the reasons' sums become
    one row, from which all counts, totals and shares follow."""
    parts = combinations.groupBy(category().alias("metric")).agg(F.sum("count").cast("bigint").alias("n")).select(F.concat(F.lit("unfiltered/"), "metric").alias("key"), "n")
    if filtered is not None:
        sums = filtered.agg(*[F.coalesce(F.sum(r), F.lit(0)).cast("bigint").alias(r) for r in REASONS])
        pairs = F.explode(F.array(*[F.struct(F.lit(f"filtered/{r}").alias("key"), F.col(r).alias("n")) for r in REASONS])).alias("x")
        parts = parts.unionByName(sums.select(pairs).select("x.key", "x.n"))
    zero = F.lit(0).cast("bigint")
    one = parts.agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counts"))

    def total(of: str) -> Column:
        return F.aggregate(F.map_values(F.map_filter("counts", lambda k, _: F.startswith(k, F.lit(of)))), zero, lambda a, n: a + n)

    one = one.withColumn("counts", F.map_concat("counts", F.create_map(*[F.lit(f"{g}/total") if i == 0 else total(f"{g}/" if g != "all" else "") for g in ("all", "unfiltered", "filtered") for i in (0, 1)])))
    rows = F.array(*[F.struct(F.lit(i).alias("row_no"), F.lit(g).alias("group"), F.lit(m).alias("metric")) for i, (g, m) in enumerate(SUMMARY_ROWS)])

    def number(group: Column | str, metric: Column | str) -> Column:
        return F.coalesce(F.try_element_at("counts", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in (group, "/", metric)])), zero)

    flat = one.select("counts", F.explode(rows).alias("x"))
    flat = flat.select(
        "x.*", number(F.col("x.group"), F.col("x.metric")).alias("count"), number("all", "total").alias("__all"), number(F.col("x.group"), "total").alias("__own")
    )

    def part_of(whole: str) -> Column:
        return safe_divide(F.col("count"), F.col(whole))

    return flat.select("row_no", "group", "metric", "count", part_of("__all").alias("overall_proportion"), part_of("__own").alias("group_proportion"))


def library_counts(classified: DataFrame, region_ids: list[str]) -> DataFrame:
    """Counts per group and library combination: regions reduced to what they match.

    A region that is absent, matches nothing or is in no library is blank, so a nonmatch and a
    mismatch can fall together; the status shown is then ``mismatch``.
    """
    keys = []
    for r in region_ids:
        m = F.col(f"match_{r}")
        keys.append(F.when(m["match"].isin(MATCH, MULTI), F.array_join(m["hits"], ",")).alias(r))
    # an overmatched region prints blank as well, but it is a key of its own
    over = F.array(*[F.coalesce(F.col(f"match_{r}.match") == OVER, F.lit(False)) for r in region_ids]) if region_ids else F.array().cast("array<boolean>")
    rows = classified.select(F.col("grp").alias("group"), *keys, over.alias("__over"), "status", "count", "id_sets", F.lit(0).cast("bigint").alias("total_distance"))
    order = {MISMATCH: 0, NONMATCH: 1}
    rank = F.when(F.col("status") == MISMATCH, order[MISMATCH]).otherwise(1)
    grouped = rows.groupBy("group", *region_ids, "__over").agg(
        F.sum("count").cast("bigint").alias("count"), F.min_by(F.struct("status", "id_sets", "total_distance"), rank).alias("x")
    )
    flat = grouped.select("group", *region_ids, "count", "x.*")
    status, _, n, ids = combination_columns()
    return flat.select("group", *region_ids, status, n, ids, "count")


@F.arrow_udf(T.StringType())
def _variants(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    cache: dict = {}
    for seqs, kinds, expected, distances in parts:
        out = []
        for row in zip(seqs.to_pylist(), kinds.to_pylist(), expected.to_pylist(), distances.to_pylist()):
            if row not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                seq, kind, hits, d = row[0], row[1], row[2], row[3]
                cache[row] = None if hits is None else ",".join(variants_text(seq, kind, h, d or 0) or "" for h in hits.split(","))
            out.append(cache[row])
        yield pa.array(out, pa.string())


def variants_column(region_id: str) -> Column:
    """Edits between a region and each sequence it matches, joined by commas; Catalyst drops it where it is unused."""
    reg, m = F.col(f"reg_{region_id}"), F.col(f"match_{region_id}")
    hits = F.when(m["match"].isin(MATCH, MULTI), F.array_join(m["hits"], ","))
    return F.nullif(_variants(reg["seq"], reg["kind"], hits, m["distance"]), F.lit(""))


__all__ = ["NO_LIBRARY", "SUMMARY_ROWS", "category", "classify", "combination_columns", "library_counts", "summary", "variants_column", "with_matches"]
