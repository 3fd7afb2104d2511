import time

from pyspark.sql import functions as F

from readweave.operators.badrows import Field, read_delimited, split_by_errors
from readweave.operators.eager import eager_join_aggregate
from readweave.operators.records import distinct_records
from readweave.operators.skew import lookup_join
from readweave.plans import problems


def test_eager_join(spark):
    left = spark.createDataFrame([("a", "g", 2), ("a", "g", None), ("a", None, 5), (None, "g", 7), ("b", "g", 1)], "k string, grp string, v bigint")
    right = spark.createDataFrame([("a", 10), ("a", 20), (None, 1)], "id string, w bigint")
    got = {(r["k"], r["grp"]): (r["n_rows"], r["total"], r["right_total"]) for r in eager_join_aggregate(left, right, "k", "id", ["k", "grp"], "v", "w").collect()}
    assert got == {("a", "g"): (4, 4, 60), ("a", None): (2, 10, 30), (None, "g"): (1, 7, 0), ("b", "g"): (1, 1, 0)}
    inner = eager_join_aggregate(left, right, "k", "id", ["k"], "v", how="inner").collect()
    assert [(r["k"], r["left_rows"], r["left_total"], r["n_rows"], r["total"]) for r in inner] == [("a", 3, 7, 6, 14)]
    states = left.groupBy("k", "grp").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    again = eager_join_aggregate(states, right.withColumn("times", F.lit(3)), "k", "id", ["k", "grp"], "v", "w", weight="n", right_weight="times").collect()
    assert {(r["k"], r["grp"]): (r["n_rows"], r["total"], r["right_total"]) for r in again} == {
        ("a", "g"): (12, 12, 60), ("a", None): (6, 30, 30), (None, "g"): (1, 7, 0), ("b", "g"): (1, 1, 0),
    }
    assert eager_join_aggregate(left.limit(0), right, "k", "id", ["k"], "v").count() == 0


def test_eager_join_with_a_hot_key(spark):
    """One key of 60,000 rows on both sides would join to 3.6 billion rows; its states are spread and multiplied."""
    left = spark.range(60_000).select(F.lit("hot").alias("k"), (F.col("id") % 500).alias("g"), F.col("id").alias("v"))
    got = eager_join_aggregate(left, left, "k", "k", ["g"], "v", "v").agg(F.count("*"), F.sum("n_rows"), F.sum("total"), F.sum("right_total")).first()
    every = sum(range(60_000))
    assert tuple(got) == (500, 60_000**2, every * 60_000, 60_000 * every)


def test_lookup_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(2000)] + [(None, 1), ("none", 2)], "k string, v int")
    table = rows.where("k is not null and k <> 'none'").groupBy("k").agg(F.count("*").alias("n"))
    for how, missing in (("inner", 0), ("left", 2)):
        got = lookup_join(rows, table, ["k"], "n", how).collect()
        assert len(got) == 5000 + missing and sum(r["n"] == 3000 for r in got) == 3000 and sum(r["n"] == 1 for r in got) == 2000
    assert lookup_join(rows.limit(0), table.limit(0), ["k"], "n").count() == 0


def test_reads_of_combinations_come_through_the_join(spark, tmp_path):
    rows = [(i, f"c{i % 3}" if i % 5 else None, None if i % 7 == 0 else "hot" if i % 2 else f"g{i}", i % 11) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:50], "rec_id bigint, combination_id string, grp string, cnt bigint").withColumn("__k", F.lit(1))
    df.write.parquet(f"{tmp_path}/expected.parquet")
    got = {(r["combination_id"], r["grp"]): (r["reads"], r["records"], r["grp_reads"]) for r in problems.p1_reads(spark, str(tmp_path)).collect()}
    want, of_grp, every = {}, {}, sum(r[3] for r in rows)
    for _, c, g, n in rows:
        of_grp[g] = of_grp.get(g, 0) + n
        a, b = want.get((c, g), (0, 0))
        want[c, g] = (a + n, b + 1)
    want = {k: (*v, of_grp[k[1]]) for k, v in want.items() if None not in k}
    assert got == want
    assert {tuple(r) for r in problems.p1_found(spark, str(tmp_path)).collect()} == {k for k, v in want.items() if v[0] * 100 >= every}


def test_records(spark):
    rows = [(1, " acgt ", 1, "x"), (1, "ACGT", 1, "y"), (2, None, None, "x"), (None, "A", 1, "x")]
    got = distinct_records(spark.createDataFrame(rows, "rec_id bigint, forward string, cnt bigint, loaded string"), "forward", "cnt").collect()
    assert sorted(map(tuple, got)) == [(1, "ACGT", 1), (2, None, 0)]


def library_lines():
    r1, r2 = "A" * 28, "C" * 12
    return [
        "# note", "", '"_id"\tregion1\tregion2\tnote\r', f"kx1\t {r1} \t{r2}\tfine", f'"kx2"\t"{r1}"\t{r2.lower()}\t"a ""b""\tc\ue000"', f"kx3\t{r1}\t{r2}",
        f'kx4\t{r1}"\t{r2}\t', f'"kx5" \t{r1}\t{r2}\t', f"5kx\t{r1}\t{r2}\t", f"kx6\t{r1[1:]}\t{r2}\t", f'"kx7\t{r1}\t{r2}\t', f'" kx8"\t{r1}\t{r2}\t', None,
        f"kx9\t{r1}\t{r2}\t" + '"' + '""' * 20000 + '"', f'kx10\t{r1}\t{r2}\t"a"""', f'kx11\t{r1}\t{r2}\t"a""', "   ",
    ]


def test_library_lines(spark):
    schema = "file_id bigint, file_name string, line_no bigint, line_text string, errors int, __line string"
    df = spark.createDataFrame([(7, "library_7.tsv", i, t, 1, "x") for i, t in enumerate(library_lines())], schema)
    fields = problems.LIBRARY_FIELDS
    for limit in (1 << 20, 0):  # headers broadcast, and joined to spread lines
        valid, failed = split_by_errors(read_delimited(df, fields, keep=["file_name"], broadcast=limit), fields)
        start = time.time()
        assert {r["line_no"]: r["reason"] for r in failed.collect()} == {
            5: "column_count", 6: "quoting", 7: "quoting", 8: "invalid_value", 9: "invalid_value", 10: "quoting", 11: "invalid_value", 15: "quoting",
        }
        good = {r["_id"]: r for r in valid.collect()}
        assert time.time() - start < 30
        assert sorted(good) == ["kx1", "kx10", "kx2", "kx9"] and good["kx1"]["region1"] == "A" * 28 and good["kx1"]["file_name"] == "library_7.tsv"
        assert good["kx2"]["note"] == 'a "b"\tc\ue000' and good["kx9"]["note"] == '"' * 20000 and good["kx10"]["note"] == 'a"'
    assert read_delimited(df.limit(0), fields).count() == 0


def test_quotes_take_linear_time(spark):
    """A line of 400,000 doubled quotes takes no more than a few times what one of a tenth takes."""
    field = [Field("a"), Field("b")]

    def seconds(n):
        df = spark.createDataFrame([(1, 0, "a\tb"), (1, 1, 'x\t"' + '""' * n + '"')], "file_id int, line_no int, line_text string")
        start = time.time()
        assert len(read_delimited(df, field).first()["b"]) == n
        return time.time() - start

    seconds(10)
    assert seconds(400_000) < 10


def test_typed_columns_and_rules(spark):
    fields = [Field("n", "int", rule=lambda v: v > 0), Field("day", "date"), Field("name", pattern=r"\A\w+\z"), Field("absent", "int")]
    lines = ["name\tn\tday\textra", "a\t1\t2024-02-29\t", "b\t0\t2024-01-01\t", "c\tx\t2024-02-30\t", "d\t\t\tz", "e e\t3000000000\t2024-01-01\t"]
    df = spark.createDataFrame([(None, i, t) for i, t in enumerate(lines)], "file_id int, line_no int, line_text string")
    valid, failed = split_by_errors(read_delimited(df, fields), fields)
    assert [(r["name"], r["n"], r["day"] and r["day"].isoformat(), r["absent"]) for r in valid.orderBy("line_no").collect()] == [("a", 1, "2024-02-29", None), ("d", None, None, None)]
    assert {r["line_no"]: [e["column"] for e in r["errors"]] for r in failed.collect()} == {2: ["n"], 3: ["n", "day"], 5: ["n", "name"]}
