"""Data-quality gate: exact copies, repeated keys, broken types, in that order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.columns import file_name
from tallyhouse.functions.rules import has_rule, violates
from tallyhouse.operators.keys import first_rows, mark, with_digest
from tallyhouse.specs import FILE, LINEAGE, ROW, SHEET

DUPLICATE_ROW, PK_DUPLICATE, DATATYPE = "DUPLICATE_ROW", "PK_DUPLICATE", "DATATYPE_VIOLATION"
COPY_TEXT = "exact copy of an earlier row in this batch"
REMOVED = "REMOVED"
SCOPE = [FILE, SHEET]
DQ = ["_dq_issue", "_dq_detail", "_dq_action", "_dq_source_file", "_dq_sheet"]


def _business(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in LINEAGE and c not in DQ]


def _first_contents(df: DataFrame, cols: Sequence[str], row: str, key: Sequence[str] = ()) -> DataFrame:
    """The number of the first row of each content inside its sheet, beside its key. The rows
    themselves stay where they are: what is sent is the key and a digest of the other cells."""
    narrow, content = with_digest(df, [c for c in cols if c not in key], "_content")
    return first_rows(narrow, SCOPE, [*key, *content], row)


def dq_duplicate_rows(df: DataFrame, cols=None, row: str = ROW, key: Sequence[str] = ()) -> DataFrame:
    """Rows that repeat an earlier row of the same sheet. With ``key``, columns among those
    compared, they are grouped beside it, as the key check and the gate do, and may share an exchange."""
    first = _first_contents(df, cols or _business(df), row, key)
    copies = mark(df, first, [row, *SCOPE], "_first").filter("not _first").drop("_first")
    return _reject(copies, DUPLICATE_ROW, F.lit(COPY_TEXT))


def dq_pk_duplicates(df: DataFrame, key: Sequence[str], row: str = ROW) -> DataFrame:
    """Among rows that are not copies, those whose key an earlier row has."""
    if any(k not in df.columns for k in key):
        return _reject(df.limit(0), PK_DUPLICATE, F.lit(""))
    on = [row, *SCOPE]
    # one row per distinct content, with the number of its first row
    rows = _first_contents(df, _business(df), row, key)
    first = first_rows(rows, SCOPE, list(key), row)
    marked = mark(mark(df, rows, on, "_unique"), first, on, "_first")
    again = marked.filter("_unique and not _first").drop("_unique", "_first")
    return _reject(again, PK_DUPLICATE, _key_text(key))


def rule_failures(df: DataFrame, rules: Mapping[str, str]) -> Column:
    """`col(rule)` for every broken rule, in rule order, joined by a space."""
    hits = [
        F.when(violates(rule, F.col(c)), F.lit(f"{c}({rule})"))
        for c, rule in rules.items()
        if c in df.columns and has_rule(rule)
    ]
    return F.concat_ws(" ", *hits) if hits else F.lit("")


def dq_datatype_gate(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    failed = df.withColumn("_f", rule_failures(df, rules)).filter("_f <> ''")
    return _reject(failed, DATATYPE, F.col("_f")).drop("_f")


def dq_gate(
    df: DataFrame, key: Sequence[str], rules: Mapping[str, str], row: str = ROW
) -> DataFrame:
    """Every row with its verdict; ``_dq_issue`` is NULL on clean rows.

    Both keep-first checks are aggregates that combine on the map side, and the
    verdict returns to the rows by row number. No task ever holds a key group. The
    rows cross the network once, for the join; the checks send keys and digests.
    """
    on = [row, *SCOPE]  # the number first: it sorts by prefix
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in SCOPE})
    keyed = bool(key) and all(k in df.columns for k in key)
    copies = _first_contents(df, _business(df), row, key if keyed else ())
    # the first row of a key is also the first of its copies, so the key check
    # refines the aggregate above instead of reading the rows again
    heads = first_rows(copies, SCOPE, list(key), row) if keyed else None
    judged = df.withColumn("_failed", rule_failures(df, rules))
    marked = mark(judged, copies, on, "_unique")
    marked = mark(marked, heads, on, "_head") if keyed else marked.withColumn("_head", F.lit(True))
    issue = (
        F.when(~F.col("_unique"), DUPLICATE_ROW)
        .when(~F.col("_head"), PK_DUPLICATE)
        .when(F.col("_failed") != "", DATATYPE)
    )
    detail = (
        F.when(~F.col("_unique"), COPY_TEXT)
        .when(~F.col("_head"), _key_text(key) if keyed else F.lit(None))
        .when(F.col("_failed") != "", F.col("_failed"))
    )
    return (
        marked.withColumns({"_dq_issue": issue, "_dq_detail": detail})
        .drop("_unique", "_head", "_failed")
        .withColumns(
            {
                "_dq_action": F.when(F.col("_dq_issue").isNotNull(), REMOVED),
                "_dq_source_file": file_name(F.col(FILE)),
                "_dq_sheet": F.col(SHEET),
            }
        )
    )


def clean_rows(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("_dq_issue").isNull()).drop(*DQ)


def rejected_rows(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("_dq_issue").isNotNull())


def issue_filter(rejected: DataFrame, issues: Sequence[str]) -> DataFrame:
    return rejected.filter(F.col("_dq_issue").isin(list(issues)))


def union_rejected(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dq_counts(tagged: DataFrame) -> DataFrame:
    return rejected_rows(tagged).groupBy("_dq_issue").agg(F.count("*").alias("n"))


def dq_report_name(stamp: Column) -> Column:
    stem = F.regexp_replace(F.col("_dq_source_file"), r"\.[^.]*$", "")
    return F.concat_ws(
        "_",
        stamp,
        F.translate(stem, " ", "_"),
        F.translate(F.col("_dq_sheet"), " ", "_"),
        F.lit("dq_report.csv"),
    )


def dq_report_index(rejected: DataFrame, issues=(DUPLICATE_ROW, PK_DUPLICATE, DATATYPE)) -> DataFrame:
    """One line per report, newest name first; the stamp is read from the name."""
    stamp = F.regexp_extract("report", r"^(\d{8}_\d{6})_", 1)
    counts = [F.count_if(F.col("_dq_issue") == i).alias(i.lower()) for i in issues]
    index = rejected.groupBy("report").agg(
        F.count("*").alias("total_rejected"),
        *counts,
        F.min("_dq_source_file").alias("source_file"),
        F.min("_dq_sheet").alias("sheet"),
    )
    ts = F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")
    return index.withColumn("report_ts", ts).orderBy(F.desc("report"))


def dq_report_detail(rejected: DataFrame, report: str) -> DataFrame:
    return rejected.filter(F.col("report") == report)


def dq_issue_rollup(rejected: DataFrame) -> DataFrame:
    """Issue totals over all reports, the grand total and the dominant issue."""
    by_issue = rejected.groupBy("_dq_issue").agg(F.count("*").alias("n"))
    return by_issue.groupingSets([["_dq_issue"], []], "_dq_issue").agg(
        F.sum("n").alias("n"),
        F.max_by("_dq_issue", F.struct("n", "_dq_issue")).alias("dominant"),
        F.grouping_id().alias("level"),
    ).select(
        F.when(F.col("level") == 1, "ALL").otherwise(F.col("_dq_issue")).alias("issue"),
        "n",
        F.when(F.col("level") == 1, F.col("dominant")).alias("dominant"),
    )


def _key_text(key: Sequence[str]) -> Column:
    value = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("<NA>")) for k in key])
    return F.concat(F.lit(f"duplicate value in '{', '.join(key)}': "), value)


def _reject(df: DataFrame, issue: str, detail: Column) -> DataFrame:
    return df.withColumns(
        {
            "_dq_issue": F.lit(issue),
            "_dq_detail": detail,
            "_dq_action": F.lit(REMOVED),
            "_dq_source_file": file_name(F.col(FILE)),
            "_dq_sheet": F.col(SHEET),
        }
    )
