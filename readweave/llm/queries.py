"""Queries of the training-data problems over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.llm import bpe, cooccurrence, frequent, langid, neardup, packing, topn
from readweave.operators.records import clean_sequence, distinct_records
from readweave.session import table


def _region_pairs(spark: SparkSession, d: str, **options) -> DataFrame:
    records = distinct_records(table(spark, d, "expected"), "region1", "region2", "cnt")
    return cooccurrence.cooccurrence(records, "region1", "region2", "cnt", **options)


#: False-discovery rate at which the null must reject a pair.
LEVEL = 0.05


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Region pairs of at least 20 reads that the fitted null rejects and that occur at least five times as often as by chance.

    The null decides what is a discovery, the definition's ratio, in integers, which of them are
    cases. 20 reads where 4 are expected, the least surprising case there is, have a p-value of
    about 10^-8; at the rate used such a case is kept as long as at least one in five million of
    the pairs that occur is a discovery.
    """
    found = cooccurrence.discoveries(_region_pairs(spark, d, min_count=20), LEVEL)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cases = found.where(wide("n12") * wide("total") >= wide("n1") * wide("n2") * 5)
    return cases.select(F.least("left", "right").alias("item_a"), F.greatest("left", "right").alias("item_b"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Reads of every region pair beside those of its regions, and how many times as often as by chance it occurs."""
    pairs = _region_pairs(spark, d, null=False)
    return pairs.select("left", "right", "n12", "n1", "n2", F.round("lift", 6).alias("lift"))


def p2_surprise(spark: SparkSession, d: str) -> DataFrame:
    """Surprise of every region pair under the fitted null and its false-discovery bound."""
    return cooccurrence.with_false_discovery(_region_pairs(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Sequences that at least 0.5 % of the records have as forward or as reverse."""
    records = distinct_records(table(spark, d, "expected"), "forward", "reverse")
    found = frequent.frequent_from_share(records, ["forward", "reverse"], per_mille=5)
    return found.select(F.col("field").alias("field_name"), F.col("value").alias("seq"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records of every sequence that at least 0.1 % of the records have as forward or as reverse."""
    records = distinct_records(table(spark, d, "expected"), "forward", "reverse")
    found = frequent.frequent_from_share(records, ["forward", "reverse"], per_mille=1)
    return found.select(F.col("field").alias("field_name"), F.col("value").alias("seq"), F.col("n").alias("records"))


def _top(spark: SparkSession, d: str) -> DataFrame:
    records = distinct_records(table(spark, d, "expected"), "grp", "combination_id", "cnt")
    reads = (
        records.where(F.col("grp").isNotNull() & F.col("combination_id").isNotNull())
        .groupBy("grp", "combination_id")
        .agg(F.sum("cnt").alias("reads"))
    )
    return topn.top_n_per_group(reads, "grp", "combination_id", "reads", 5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The five combinations with the most reads of every group."""
    return _top(spark, d).select(F.col("group").alias("grp"), F.col("item").alias("combination_id"))


def p5_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The same with reads and rank."""
    return _top(spark, d).select(
        F.col("group").alias("grp"), F.col("item").alias("combination_id"), F.col("score").alias("reads"), F.col("rank").cast("bigint").alias("place")
    )


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Values to compare: forward and region1 of mismatched records, region1 of the library."""
    expected = table(spark, d, "expected")
    records = distinct_records(expected.where(F.col("combination_status") == "mismatch"), "forward", "region1")
    fields = F.explode(
        F.array(*[F.struct(F.lit(f"expected.{c}").alias("field"), F.col(c).alias("value")) for c in ("forward", "region1")])
    ).alias("x")
    long = records.select("rec_id", fields).select("x.field", F.col("rec_id").alias("key"), "x.value")
    members = table(spark, d, "library")
    return long.union(
        members.select(F.lit("library.region1"), members["member_no"], clean_sequence(members["region1"]))
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of unassigned records, and of library members, whose sequences differ by small edits."""
    pairs = neardup.near_duplicate_pairs(_compared(spark, d))
    return pairs.select(F.col("field").alias("field_name"), "key_a", "key_b")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per compared record: its class of exact copies and the class's links."""
    return neardup.near_duplicate_classes(_compared(spark, d)).withColumnRenamed("field", "field_name")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document's text."""
    documents = table(spark, d, "documents")
    return documents.select("doc_id", bpe.token_ids(spark, documents["text"]).alias("ids"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of at most 2,048 tokens."""
    documents = table(spark, d, "documents")
    sized = documents.select("doc_id", bpe.token_count(spark, documents["text"]).alias("n_tokens"))
    return packing.pack(sized, "doc_id", "n_tokens", 2048).select(
        F.col("item").alias("doc_id"), F.col("piece").alias("piece_no"), "start", F.col("size").alias("n_tokens"), "container_id"
    )


def _labels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = langid.train(table(spark, d, "lang_samples"))
    label = langid.language_labels(spark, documents["text"], model).alias("label")
    return documents.select("doc_id", langid.named_language(documents["lang"]).alias("named"), label)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of lines of at least 12 words that the document's label does not name."""
    # an inner explode would have the texts labelled twice, once for the filter Spark infers from it
    lines = _labels(spark, d).select("doc_id", "named", F.explode_outer("label.line_langs").alias("lang"))
    return lines.where(F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("named"))).select("doc_id", "lang").dropDuplicates()


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document's segments with language and confidence, beside the document's own."""
    labels = _labels(spark, d)
    return labels.select(
        "doc_id", "named", F.col("label.lang").alias("doc_lang"), F.col("label.confidence").alias("doc_confidence"), F.explode_outer("label.segments").alias("s")
    ).select("doc_id", "named", "doc_lang", "doc_confidence", "s.*")


QUERIES = {
    "p2_found": p2_found, "p2_pairs": p2_pairs, "p2_surprise": p2_surprise,
    "p3_found": p3_found, "p3_counts": p3_counts,
    "p5_found": p5_found, "p5_ranks": p5_ranks,
    "p6_found": p6_found, "p6_classes": p6_classes,
    "p7_ids": p7_ids, "p8_containers": p8_containers,
    "p9_found": p9_found, "p9_segments": p9_segments,
}

_CLEAN = """
r AS (SELECT DISTINCT rec_id, grp, combination_id, upper(trim(forward)) AS forward, upper(trim(reverse)) AS reverse,
             upper(trim(region1)) AS region1, upper(trim(region2)) AS region2, coalesce(cnt, 0) AS cnt
      FROM expected WHERE rec_id IS NOT NULL)
"""
_PAIRS = f"""
WITH {_CLEAN}, f AS (SELECT * FROM r WHERE region1 IS NOT NULL AND region2 IS NOT NULL),
t AS (SELECT sum(cnt) AS t FROM f), a AS (SELECT region1, sum(cnt) AS n1 FROM f GROUP BY 1),
b AS (SELECT region2, sum(cnt) AS n2 FROM f GROUP BY 1),
p AS (SELECT region1, region2, sum(cnt) AS n12 FROM f GROUP BY 1, 2)
"""
_SEQS = f"""
WITH {_CLEAN}, s AS (SELECT 'forward' AS field_name, forward AS seq FROM r WHERE forward IS NOT NULL
                     UNION ALL SELECT 'reverse', reverse FROM r WHERE reverse IS NOT NULL),
n AS (SELECT field_name, count(*) AS n FROM s GROUP BY 1)
"""
_RANKS = f"""
WITH {_CLEAN}, g AS (SELECT grp, combination_id, CAST(sum(cnt) AS BIGINT) AS reads FROM r
                     WHERE grp IS NOT NULL AND combination_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY reads DESC, combination_id) AS place FROM g)
"""

SQL = {
    "p2_found": _PAIRS + """
SELECT least(region1, region2) AS item_a, greatest(region1, region2) AS item_b
FROM p JOIN a USING (region1) JOIN b USING (region2), t WHERE n12 >= 20 AND n12 * t >= 5 * n1 * n2
""",
    "p2_pairs": _PAIRS + """
SELECT region1 AS "left", region2 AS "right", CAST(n12 AS BIGINT) AS n12, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       round(CASE WHEN n1 > 0 AND n2 > 0 THEN n12 / (CAST(n1 AS DOUBLE) * n2 / t) END, 6) AS lift
FROM p JOIN a USING (region1) JOIN b USING (region2), t
""",
    "p3_found": _SEQS + """
SELECT field_name, seq FROM s JOIN n USING (field_name) GROUP BY field_name, seq, n HAVING count(*) * 1000 >= 5 * n
""",
    "p3_counts": _SEQS + """
SELECT field_name, seq, CAST(count(*) AS BIGINT) AS records FROM s JOIN n USING (field_name)
GROUP BY field_name, seq, n HAVING count(*) * 1000 >= n
""",
    "p5_found": _RANKS + "SELECT grp, combination_id FROM k WHERE place <= 5",
    "p5_ranks": _RANKS + "SELECT grp, combination_id, reads, place FROM k WHERE place <= 5",
}
