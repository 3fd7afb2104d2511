"""Delimited lines of text files: valid records beside failing lines and their reasons."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readweave.session import cut, once

QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"

#: A field with the quotes around it, in possessive groups: every letter of a line is looked at once.
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^"\t]*+)'
_WELL_QUOTED = rf"\A{_FIELD}(?:\t{_FIELD})*+\z"
#: Headers are broadcast up to this many bytes.
BROADCAST = 32 << 20
#: Parts over which the lines of one file are spread where headers are not broadcast.
SALTS = 64


@dataclass(frozen=True)
class Field:
    """A column lines may have: its type, a pattern the whole text of a value must match, and a
    rule over the value once it is cast. A value that is empty is null unless the column is text."""

    name: str
    type: str = "string"
    pattern: str | None = None
    rule: Callable[[Column], Column] | None = None

    def value(self, text: Column) -> Column:
        return text if self.type == "string" else F.nullif(text, F.lit("")).try_cast(self.type)

    def broken(self, text: Column) -> Column:
        """Whether a text breaks the column's cast or constraint rules; never null."""
        out = F.lit(False)
        if self.type != "string":
            out = out | ((text != "") & self.value(text).isNull())
        if self.pattern is not None:
            out = out | ~text.rlike(self.pattern)
        if self.rule is not None:
            out = out | ~self.rule(self.value(text))
        return F.coalesce(out, F.lit(False))


def _raw_fields(line: Column) -> Column:
    """The fields of a well-quoted line as they stand, cut at tabs outside quotes."""
    return F.when(F.contains(line, F.lit('"')), F.regexp_extract_all(F.concat(line, F.lit("\t")), F.lit(rf"({_FIELD})\t"), F.lit(1))).otherwise(
        F.split(line, "\t", -1)
    )


def _text(field: Column) -> Column:
    """A field's text: quotes taken off, or blanks around an unquoted one."""
    inner = F.substr(field, F.lit(2), F.length(field) - 2)
    return F.when(F.startswith(field, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.trim(field))


def _headers(rows: DataFrame, source: str, order: str) -> DataFrame:
    """Number of the header line and column names of every file."""
    firsts = rows.groupBy(F.col(source).alias("__f")).agg(F.min_by("__line", order).alias("__h"), F.min(order).alias("__at"))
    return firsts.select("__f", "__at", F.transform(_raw_fields(F.col("__h")), _text).alias("__names"), F.length("__h").alias("__size"))


def read_delimited(
    lines: DataFrame, fields: Sequence[Field], *, text: str = "line_text", source: str = "file_id", order: str = "line_no",
    keep: Sequence[str] = (), comment: str = "#", broadcast: int = BROADCAST,
) -> DataFrame:
    """Read raw tab-separated lines into nullable text columns with an array of errors each.

    Every line that is neither blank, comment nor header comes out once (repeated rows as
    often as they come) with ``source``, ``order``, the columns ``keep``, one text column per field
    (null where the file has no such column or the line could not be split) and ``errors``, an
    array of (reason, column) structs in the order quoting, column_count, invalid_value; an
    empty array marks a valid record. Fields are separated by tabs. One that starts with a
    double quote ends with one and may hold tabs, line ends and doubled quotes; no other may
    hold a quote, and blanks around it do not count. A carriage return at the line's end is not
    part of it. Quoting is judged by one possessive pattern, so the time is linear in the line.

    Headers are one row per file. They are made first and broadcast if they measure at most
    ``broadcast`` bytes; beyond that every file's lines are spread over SALTS parts, to each of which
    its header is sent, so a file of a third of all lines is no task of its own.

    A null text counts as blank. The header of a file is its first line by ``order`` that is
    neither blank nor a comment; a header that repeats a column counts at its first place. Rows
    with a null source form a file of their own. Further columns are ignored. An empty table
    gives an empty result.
    """
    raw = F.coalesce(lines[text], F.lit(""))
    line = F.when(F.endswith(raw, F.lit("\r")), F.substr(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    wanted = list(dict.fromkeys([source, *keep, order]))
    rows = lines.select(*[lines[c] for c in wanted], line.alias("__line")).where((F.trim("__line") != "") & ~F.startswith(F.col("__line"), F.lit(comment)))
    heads = cut(_headers(rows, source, order))
    size = heads.agg(F.coalesce(F.sum(F.col("__size") * 2 + 64), F.lit(0))).first()[0]
    heads = heads.drop("__size")
    same = F.col(source).eqNullSafe(F.col("__f"))
    if size <= broadcast:
        body = rows.join(F.broadcast(heads), same, "left")
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(SALTS)))
        heads = heads.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        body = rows.join(heads.hint("merge"), same & (F.col("__salt") == F.col("__part")), "left")
    body = body.where(F.col(order).isNull() | (F.col(order) != F.col("__at"))).select(*wanted, "__line", "__names")
    quotes = F.contains(F.col("__line"), F.lit('"'))
    body = once(body, __ok=~quotes | F.col("__line").rlike(_WELL_QUOTED))
    body = once(body, __fields=F.when(F.col("__ok"), _raw_fields(F.col("__line"))))
    fits = F.size("__fields") == F.size("__names")

    def value(name: str) -> Column:
        place = F.array_position("__names", F.lit(name)).cast("int")
        return F.when(F.col("__fits") & (place > 0), _text(F.get("__fields", place - 1)))

    body = once(body, __fits=F.col("__ok") & fits).drop("__line")
    body = once(body, **{f"__v{i}": value(f.name) for i, f in enumerate(fields)})
    texts = [F.col(f"__v{i}") for i in range(len(fields))]

    def error(when: Column, reason: str, column: str | None) -> Column:
        return F.when(when, F.struct(F.lit(reason).alias("reason"), F.lit(column).cast("string").alias("column")))

    checks = [
        error(~F.col("__ok"), QUOTING, None),
        error(F.col("__ok") & ~F.col("__fits"), COLUMN_COUNT, None),
        *[error(t.isNotNull() & f.broken(t), INVALID_VALUE, f.name) for f, t in zip(fields, texts)],
    ]
    return body.select(*wanted, *[t.alias(f.name) for f, t in zip(fields, texts)], F.array_compact(F.array(*checks)).alias("errors"))


def split_by_errors(read: DataFrame, fields: Sequence[Field]) -> tuple[DataFrame, DataFrame]:
    """The valid records with their values cast, and the failing lines with the first reason and all errors."""
    names = [f.name for f in fields]
    rest = [c for c in read.columns if c not in names and c != "errors"]
    valid = read.where(F.size("errors") == 0).select(*rest, *[f.value(F.col(f"`{f.name}`")).alias(f.name) for f in fields])
    failed = read.where(F.size("errors") > 0).select(*rest, F.get("errors", F.lit(0))["reason"].alias("reason"), "errors")
    return valid, failed
