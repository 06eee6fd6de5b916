"""Projections that turn landed text into typed columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from tallyhouse.functions.columns import (
    file_name,
    number_text,
    strip,
    strip_currency,
    to_number,
    to_timestamp,
    to_timestamp_any,
)
from tallyhouse.operators.keys import first_per_key
from tallyhouse.specs import (
    DATE_PATTERNS,
    DATE_WORDS,
    FILE,
    ID_WORDS,
    LINEAGE,
    NULL_MARKERS,
    ROW,
    TIMESTAMP_PATTERNS,
    VOTE_THRESHOLD,
)


def business_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in LINEAGE]


def string_columns(df: DataFrame) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema}
    return [c for c in business_columns(df) if isinstance(kinds[c], T.StringType)]


def date_columns(names: Iterable[str]) -> list[str]:
    return [n for n in names if any(w in n for w in DATE_WORDS)]


def measure_columns(names: Iterable[str]) -> list[str]:
    """Columns that may turn numeric: everything that is not an identifier."""
    return [n for n in names if not any(w in n for w in ID_WORDS)]


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def null_markers(df: DataFrame, cols=None, markers=NULL_MARKERS) -> DataFrame:
    """Exact cell match; runs before trimming, so a padded marker survives."""
    cols = cols or string_columns(df)
    # one constant array keeps the generated code of wide feeds small enough to compile
    known = F.array(*[F.lit(m) for m in markers])
    return df.withColumns({c: F.when(~F.array_contains(known, F.col(c)), F.col(c)) for c in cols})


def drop_all_null_rows(df: DataFrame, cols=None) -> DataFrame:
    return df.na.drop(how="all", subset=cols or business_columns(df))


def trim_strings(df: DataFrame, cols=None) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in cols or string_columns(df)})


def _present(c: str):
    return F.count(F.col(c)).alias(f"n:{c}")


def date_votes(df: DataFrame, cols, patterns=DATE_PATTERNS, threshold=VOTE_THRESHOLD) -> dict:
    """Per column the first pattern that parses enough of its values, or None.

    One job with one row of counters, whatever the number of columns.
    """
    hits = [
        F.count(to_timestamp(F.col(c), p)).alias(f"{i}:{c}")
        for c in cols
        for i, p in enumerate(patterns)
    ]
    votes = df.agg(*[_present(c) for c in cols], *hits).first()
    return {
        c: next(
            (p for i, p in enumerate(patterns) if votes[f"{i}:{c}"] >= threshold * votes[f"n:{c}"]),
            None,
        )
        for c in cols
    }


def parse_dates_vote(
    df: DataFrame, cols=None, patterns=DATE_PATTERNS, threshold=VOTE_THRESHOLD
) -> DataFrame:
    """One format for a whole column; values in other formats become NULL."""
    cols = date_columns(string_columns(df)) if cols is None else cols
    if not cols:
        return df
    winner = date_votes(df, cols, patterns, threshold)
    return df.withColumns(
        {
            c: to_timestamp(F.col(c), winner[c]) if winner[c] else to_timestamp_any(F.col(c))
            for c in cols
        }
    )


def parse_dates_coalesce(df: DataFrame, cols=None, patterns=TIMESTAMP_PATTERNS) -> DataFrame:
    """Each value by the first format that fits it."""
    cols = date_columns(string_columns(df)) if cols is None else cols
    return df.withColumns({c: to_timestamp_any(F.col(c), patterns) for c in cols})


def tidy_numbers(df: DataFrame, cols) -> DataFrame:
    """Drop currency marks, separators and spaces where a number remains; other
    text stays as it is for the gate to report."""
    return df.withColumns(
        {c: F.coalesce(number_text(strip_currency(F.col(c))), F.col(c)) for c in cols}
    )


def numeric_votes(df: DataFrame, cols, threshold=VOTE_THRESHOLD) -> list[str]:
    hits = [F.count(to_number(strip_currency(F.col(c)))).alias(f"hit:{c}") for c in cols]
    votes = df.agg(*[_present(c) for c in cols], *hits).first()
    return [c for c in cols if votes[f"hit:{c}"] >= threshold * votes[f"n:{c}"]]


def coerce_numeric_vote(df: DataFrame, cols=None, threshold=VOTE_THRESHOLD) -> DataFrame:
    """Text columns turn DOUBLE when enough of their values are numbers."""
    cols = measure_columns(string_columns(df)) if cols is None else cols
    if not cols:
        return df
    chosen = numeric_votes(df, cols, threshold)
    return df.withColumns({c: to_number(strip_currency(F.col(c))) for c in chosen})


def map_columns(df: DataFrame, mapping: Mapping[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """Select and rename; source names are case-insensitive, unmapped ones go."""
    have = {c.lower(): c for c in df.columns}
    picked = [F.col(have[s.lower()]).alias(t) for s, t in mapping.items() if s.lower() in have]
    return df.select(*picked, *[k for k in keep if k in df.columns])


def inject_columns(df: DataFrame, literals: Mapping[str, str | None], file_col=FILE) -> DataFrame:
    """Constant columns; None stands for the name of the source file."""
    return df.withColumns(
        {c: file_name(F.col(file_col)) if v is None else F.lit(v) for c, v in literals.items()}
    )


def dedup_on_column(df: DataFrame, col: str, order: str = ROW) -> DataFrame:
    return first_per_key(df, [col], order)


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Known columns in target order and type; missing ones are NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
            .alias(f.name)
            for f in schema
        ]
    )


def clean_text(df: DataFrame, markers=NULL_MARKERS) -> DataFrame:
    """Headers, markers, empty rows and white space: everything before typing."""
    tidy = drop_all_null_rows(null_markers(normalize_headers(df), markers=markers))
    return trim_strings(tidy)
