"""Queries of the general problems (1 and 4) over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.operators.badrows import Field, read_delimited, split_by_errors
from readweave.operators.eager import eager_join_aggregate
from readweave.operators.records import distinct_records
from readweave.session import cut, table

#: The columns of library files and the pattern every value of a column must match in whole.
LIBRARY_FIELDS = (
    Field("_id", pattern=r"\A[A-Za-z][A-Za-z0-9_.\-]*+\z"),
    Field("region1", pattern=r"\A[ACGTacgt]{28}\z"),
    Field("region2", pattern=r"\A[ACGTacgt]{12}\z"),
    Field("spacer", pattern=r"\A[ACGTacgt]{20}\z"),
    Field("barcode", pattern=r"\A[ACGTacgt]{10}\z"),
    Field("note"),
)


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Reads and records of each (grp, combination_id), nulls included: compact, and written once for all that reads them."""
    records = distinct_records(table(spark, d, "expected"), "combination_id", "grp", "cnt")
    return cut(records.groupBy("grp", "combination_id").agg(F.sum("cnt").alias("reads"), F.count(F.lit(1)).alias("records")))


def _reads_per_combination(states: DataFrame) -> DataFrame:
    """Reads and records of each (combination_id, grp) beside the reads of the whole grp.

    What is asked is an aggregate over the records joined to all records of their grp, in which
    a grp holding a third of them would meet itself; its states are joined instead.
    """
    both = eager_join_aggregate(
        states, states, "grp", "grp", ["grp", "combination_id"], "reads", "reads", weight="records", right_weight="records"
    )
    return both.select(
        "combination_id", "grp", F.col("left_total").alias("reads"), F.col("left_rows").alias("records"), F.expr("cast(right_total div left_rows as bigint)").alias("grp_reads")
    ).where(F.col("combination_id").isNotNull() & F.col("grp").isNotNull())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Combinations and groups holding at least 1 % of all reads: only groups that hold as much themselves can have them."""
    states = _states(spark, d)
    every = states.agg(F.coalesce(F.sum("reads"), F.lit(0)).alias("t")).scalar()
    found = _reads_per_combination(states).where((F.col("grp_reads") * 100 >= every) & (F.col("reads") * 100 >= every))
    return found.select("combination_id", "grp")


def p1_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads and records of every combination within every group, beside the reads of the group."""
    return _reads_per_combination(_states(spark, d))


def _library_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return split_by_errors(read_delimited(table(spark, d, "library_lines"), LIBRARY_FIELDS), LIBRARY_FIELDS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Failing lines with the first reason."""
    return _library_lines(spark, d)[1].select("file_id", "line_no", "reason")


def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    """Valid records of the library files."""
    valid = _library_lines(spark, d)[0]
    return valid.select("file_id", "line_no", F.col("_id").alias("member_id"), "region1", "region2", "spacer", "barcode")


QUERIES = {"p1_found": p1_found, "p1_reads": p1_reads, "p4_found": p4_found, "p4_valid": p4_valid}

_RECORDS = """
SELECT DISTINCT rec_id, combination_id, grp, coalesce(cnt, 0) AS cnt FROM expected WHERE rec_id IS NOT NULL
"""

_FIELD = r"""("(?:[^"]|"")*"|[^"\t]*)"""
_LINES = rf"""
WITH l AS (
  SELECT file_id, line_no, regexp_replace(coalesce(line_text, ''), '\r$', '') AS line FROM library_lines
), body AS (
  SELECT * FROM l WHERE trim(line) <> '' AND line NOT LIKE '#%'
), h AS (
  SELECT file_id, arg_min(line, line_no) AS head, min(line_no) AS at FROM body GROUP BY file_id
), f AS (
  SELECT b.file_id, b.line_no, b.line, regexp_extract_all(h.head || chr(9), '{_FIELD}\t', 1) AS raw_names,
         regexp_full_match(b.line, '{_FIELD}(\t{_FIELD})*') AS ok,
         regexp_extract_all(b.line || chr(9), '{_FIELD}\t', 1) AS raw
  FROM body b JOIN h ON b.file_id = h.file_id WHERE b.line_no <> h.at
), v AS (
  SELECT file_id, line_no, ok, len(raw) AS n, len(raw_names) AS want,
    list_transform(raw_names, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE trim(x) END) AS names,
    list_transform(raw, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE trim(x) END) AS vals
  FROM f
), c AS (
  SELECT file_id, line_no, ok, n, want, {", ".join(
    f"CASE WHEN ok AND n = want THEN vals[list_position(names, '{c}')] END AS {c}, list_contains(names, '{c}') AS has_{c}"
    for c in ("_id", "region1", "region2", "spacer", "barcode"))}
  FROM v
), r AS (
  SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN n <> want THEN 'column_count' WHEN
    (has__id AND NOT regexp_full_match(_id, '[A-Za-z][A-Za-z0-9_.\-]*'))
    OR (has_region1 AND NOT regexp_full_match(region1, '[ACGTacgt]{{28}}'))
    OR (has_region2 AND NOT regexp_full_match(region2, '[ACGTacgt]{{12}}'))
    OR (has_spacer AND NOT regexp_full_match(spacer, '[ACGTacgt]{{20}}'))
    OR (has_barcode AND NOT regexp_full_match(barcode, '[ACGTacgt]{{10}}')) THEN 'invalid_value' END AS reason
  FROM c
)
"""

SQL = {
    "p1_found": f"""
WITH r AS ({_RECORDS}), t AS (SELECT sum(cnt) AS t FROM r)
SELECT combination_id, grp FROM r, t WHERE combination_id IS NOT NULL AND grp IS NOT NULL
GROUP BY combination_id, grp, t HAVING 100 * sum(cnt) >= t
""",
    "p1_reads": f"""
WITH r AS ({_RECORDS}), g AS (SELECT grp, CAST(sum(cnt) AS BIGINT) AS grp_reads FROM r GROUP BY grp)
SELECT combination_id, grp, CAST(sum(cnt) AS BIGINT) AS reads, CAST(count(*) AS BIGINT) AS records, max(grp_reads) AS grp_reads
FROM r JOIN g USING (grp) WHERE combination_id IS NOT NULL GROUP BY combination_id, grp
""",
    "p4_found": _LINES + "SELECT file_id, line_no, reason FROM r WHERE reason IS NOT NULL",
    "p4_valid": _LINES + "SELECT file_id, line_no, _id AS member_id, region1, region2, spacer, barcode FROM r WHERE reason IS NULL",
}
