"""Keep-first by key without sending a whole key group to one task.

Both forms combine on the map side, so a key that holds a third of all rows
costs one partial result per map task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key; NULL keys form one group."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(df.columns)


def first_rows(df: DataFrame, scope: list[str], keys: list[str], order: str) -> DataFrame:
    """Scope, key and number of the first row of each key inside each scope."""
    first = df.groupBy(*scope, *[k for k in keys if k not in scope])
    return first.agg(F.min(order).alias(order))


def _own_text(name: str, kind: T.DataType) -> Column | None:
    """A text that two values of a column share where they group together and only there; none
    for types that have no such text."""
    value = F.col(f"`{name}`")
    if kind == T.StringType():
        return value
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0).cast(kind)).cast("string")  # -0.0 groups with 0.0
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    exact = (T.IntegralType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampNTZType)
    return value.cast("string") if isinstance(kind, exact) else None


def with_digest(df: DataFrame, cols: list[str], name: str) -> tuple[DataFrame, list[str]]:
    """``df`` with 128 bits of the SHA-256 of ``cols`` in a column, and the columns that stand
    for ``cols`` as a grouping key: the digest, and those whose type has no text of its own.
    A long row then crosses the network as 16 bytes. Every value goes in with its length, so
    that neither a NULL nor a move of text between columns makes two rows alike."""
    kinds = {f.name: f.dataType for f in df.schema}
    texts = {c: _own_text(c, kinds[c]) for c in cols}
    parts = [
        F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
        for x in texts.values()
        if x is not None
    ]
    rest = [c for c, x in texts.items() if x is None]
    if not parts:
        return df, rest
    digest = F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))
    return df.withColumn(name, digest), [name, *rest]


def mark(df: DataFrame, rows: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Flag the rows of ``df`` that are in ``rows``. ``on`` names a row, so the
    join keys are unique on both sides and spread evenly; a NULL meets a NULL. ``rows``
    may be as long as ``df``, so it is merged and never broadcast."""
    there = [f"_at{i}" for i in range(len(on))]
    hit = rows.select(*on, F.lit(True).alias("_hit")).toDF(*there, "_hit").hint("merge")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(on, there)]
    joined = df.join(hit, same, "left")
    return joined.withColumn(flag, F.col("_hit").isNotNull()).drop("_hit", *there)


#: Key buckets of a new table. A table keeps the number it was laid out with, which the name
#: of its bucket column carries.
BUCKETS = 64
_BUCKET = re.compile(r"_key_of_(\d+)")


def bucket_column(table: DataFrame | None = None) -> str:
    """The bucket column that ``table`` is laid out by, else that of a new table."""
    found = [c for c in table.columns if _BUCKET.fullmatch(c)] if table is not None else []
    return found[0] if found else f"_key_of_{BUCKETS}"


def bucket(keys: list[str], name: str) -> Column:
    """The number of a row's key bucket, of as many as ``name`` says."""
    n = int(_BUCKET.fullmatch(name).group(1))
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def with_bucket(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The number of each row's key bucket in a column that names how many there are."""
    return df.withColumn(name, bucket(keys, name))


def touched(batch: DataFrame, name: str) -> list[int]:
    """The buckets that a stored batch has rows in: no more than there are buckets."""
    return sorted(r[0] for r in batch.select(name).distinct().collect())


def antijoin(new: DataFrame, target: DataFrame, keys: list[str], buckets: list[int] | None = None) -> DataFrame:
    """Rows of ``new``, one per key, whose key ``target`` does not hold.

    ``new`` is a stored table: it is read for its buckets, if none are given, for its keys and for its rows. A
    target laid out by key buckets is read in those of ``new`` alone, its key columns only,
    and cut down to the batch's keys before anything is shuffled while those are few. A NULL
    key is a key like any other.
    """
    name = bucket_column(target)
    if name in target.columns:
        mine = touched(with_bucket(new, keys, name), name) if buckets is None else buckets
        target = target.where(F.col(name).isin(mine))
    there = [f"_at{i}" for i in range(len(keys))]
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, there)]
    known = target.select(*keys).toDF(*there).join(new.select(*keys), same, "left_semi")
    return new.join(known, same, "left_anti")


def rows_per_bucket(batch: DataFrame, keys: list[str], name: str) -> dict[int, int]:
    """Rows of each bucket that a batch has: no more than there are buckets."""
    return dict(with_bucket(batch.select(*keys), keys, name).groupBy(name).agg(F.count("*")).collect())


def unknown_firsts(new: DataFrame, target: DataFrame, keys: list[str], order: str, buckets: list[int]) -> DataFrame:
    """Key and smallest ``order`` of each key of ``new`` that ``target`` does not hold. Both
    go through one aggregate that combines on the map side: what is sent is keys and numbers,
    once. A target laid out by key buckets is read in ``buckets`` alone. A NULL key is a key
    like any other."""
    name = bucket_column(target)
    if name in target.columns:
        target = target.where(F.col(name).isin(buckets))
    kind = new.schema[order].dataType
    mine = new.select(*keys, order, F.lit(0).alias("_known"))
    theirs = target.select(*keys, F.lit(None).cast(kind).alias(order), F.lit(1).alias("_known"))
    both = mine.union(theirs).groupBy(*keys).agg(F.min(order).alias(order), F.max("_known").alias("_known"))
    return both.where("_known = 0").drop("_known")


def rows_at(df: DataFrame, at: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``on`` is in ``at``, stored or made of ``df``; one of those that share it.
    ``on`` is a key with a number, so a hot key spreads by its numbers. It joins and groups as one
    struct: a NULL in it meets a NULL, and the grouping needs no exchange but the join's."""
    there = at.select(F.struct(*on).alias("_at"))
    # of the type in ``at``, whose fields may be NULL: a cast inside the join would part it from the grouping
    here = F.struct(*on).cast(there.schema["_at"].dataType).alias("_at")
    rest = [c for c in df.columns if c not in on]
    found = df.select(here, *rest).join(there, "_at", "left_semi")
    one = found.groupBy("_at").agg(F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_r"))
    return one.select(*[F.col(f"_at.`{c}`" if c in on else f"_r.`{c}`").alias(c) for c in df.columns])


def rows_at_in_parts(df: DataFrame, at: DataFrame, on: list[str], part: Column) -> DataFrame:
    """As ``rows_at`` for many rows: they cross the network once, to the place that ``part``, made
    of ``on``, gives them, so that a table may be written as they lie. Nothing but
    one aggregate follows: the marks of ``at`` travel among the rows."""
    rest = [c for c in df.columns if c not in on]
    marks = at.select(*on, F.lit(True).alias("_hit"))
    both = df.withColumn("_hit", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    near = both.withColumn("_part", part).repartition("_part")
    row = F.first(F.when(~F.col("_hit"), F.struct(F.lit(0).alias("_"), *rest)), ignorenulls=True)
    one = near.groupBy("_part", *on).agg(row.alias("_r"), F.max("_hit").alias("_hit")).where("_hit")
    return one.select(*[F.col(c if c in on else f"_r.`{c}`").alias(c) for c in df.columns])


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
