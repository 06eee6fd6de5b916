"""Mixing of sources to target weights by balanced sampling with the cube method.

A source's target over its size says how often each of its documents is taken: the
whole part always, the fraction as an inclusion probability. The flight phase moves
these probabilities inside the null space of two constraints, documents and words,
until every one but two is 0 or 1, so that both sums stay what they were. It runs in
blocks of about ``BLOCK`` documents of a source; what is undecided meets in the next
level's blocks, and so on until one block is left per source. The landing drops the
constraint on documents, then draws the last one; the words of that draw are made good by
documents that change sides, so the sum comes within the smallest of them.

Sources are ordered by code point, null last; weights repeat along that order. All
targets together are ``share`` of all sizes; a target stops at ``most`` times its
source's size, and the excess goes to the others by weight.

A null or empty text has size 0; its inclusion is balanced on the count of documents
alone and it takes 0 words. A null id is an id like any other. Repeated rows are
drawn each for itself. Draws depend on source, block and the order of (doc_id, text
hash), so reruns agree. An empty table gives an empty mix. The number of sources is
that of the mixture's parts and is held on the driver; documents are not.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import materialize

BLOCK = 4096
WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """The target of every source. sizes: (source, size) in any order."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(ordered)}
    size, total = dict(ordered), share * sum(n for _, n in ordered)
    out, free = {}, {s for s, n in ordered if n}
    out = {s: 0.0 for s, n in ordered if not n}
    while free:
        left, sum_of = total - math.fsum(out.values()), math.fsum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / sum_of > most * size[s]}
        if not over:
            out |= {s: left * weight[s] / sum_of for s in free}
            break
        out |= {s: most * size[s] for s in over}
        free -= over
    return out


def _move(p: list[float], u: list[float], draw: Callable[[], float]) -> list[float]:
    """One step along ``u`` or against it, as far as probabilities allow, fair on average."""
    up = down = math.inf
    for x, d in zip(p, u, strict=True):
        if d:
            a, b = ((1 - x) / d, x / d) if d > 0 else (-x / d, (x - 1) / d)
            up, down = min(up, a), min(down, b)
    step = up if draw() * (up + down) < down else -down
    return [min(1.0, max(0.0, x + step * d)) for x, d in zip(p, u, strict=True)]


def _settled(x: float) -> bool:
    return x < 1e-9 or x > 1 - 1e-9


def flight(probability: np.ndarray, size: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """Probabilities after the flight phase: 0 or 1 but for two at most, or for none if it is to land."""
    p, s = probability.astype(float).tolist(), size.astype(float).tolist()
    rng = np.random.Generator(np.random.PCG64(seed))
    # large documents first, so that those still open at the end are small
    draw = rng.random(len(p)).tolist()
    order = sorted((i for i in range(len(p)) if not _settled(p[i])), key=lambda i: (s[i], draw[i]))
    active: list[int] = []
    while True:
        while len(active) < 3 and order:
            active.append(order.pop())
        if len(active) < 3:
            break
        a, b, c = (s[i] for i in active)
        u = [c - b, a - c, b - a]  # across (1, 1, 1) and the sizes
        if not any(u):
            u = [1.0, -1.0, 0.0]
        scale = max(map(abs, u))
        for i, x in zip(active, _move([p[i] for i in active], [x / scale for x in u], rng.random), strict=True):
            p[i] = x
        active = [i for i in active if not _settled(p[i])]
    if len(active) == 2 and s[active[0]] == s[active[1]]:
        for i, x in zip(active, _move([p[i] for i in active], [1.0, -1.0], rng.random), strict=True):
            p[i] = x
        active = [i for i in active if not _settled(p[i])]
    if land and len(active) == 2:  # words alone
        a, b = (s[i] for i in active)
        scale = max(a, b)
        for i, x in zip(active, _move([p[i] for i in active], [b / scale, -a / scale], rng.random), strict=True):
            p[i] = x
        active = [i for i in active if not _settled(p[i])]
    if land:
        for i in active:
            p[i] = float(rng.random() < p[i])
    out = np.array([round(x) if _settled(x) else x for x in p], dtype=float)
    return _made_good(probability, size, out) if land else out


def _made_good(probability: np.ndarray, size: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The outcome with the words of the last draw made good: documents that could have
    gone either way change sides, the one nearest to what is missing first."""
    open_ = (probability > 1e-9) & (probability < 1 - 1e-9)
    over = float(((taken - probability) * size).sum())
    for _ in range(32):
        side = np.flatnonzero(open_ & (size > 0) & (taken == (over > 0)))
        if not len(side):
            break
        i = side[np.argmin(np.abs(size[side] - abs(over)))]
        if abs(abs(over) - size[i]) >= abs(over):
            break
        taken[i] = 1 - taken[i]
        over += size[i] * (1 if over < 0 else -1)
    return taken


def mix(
    spark: SparkSession, docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK,
) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, source, size, source_size, target, copies, taken."""
    text = F.col(text_col).cast("string")
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).cast("string").alias("source"), words(text).alias("size")
    )
    sized = materialize(spark, sized, "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row per source
    sizes, counts = {r.source: int(r.size) for r in found}, {r.source: int(r.n) for r in found}
    goal = targets(list(sizes.items()), weights, share, most)
    plan = [(s, sizes[s], goal[s], goal[s] / sizes[s] if sizes[s] else 0.0, max(1, -(-counts[s] // block))) for s in sizes]
    table = spark.createDataFrame(plan, "source string, source_size long, target double, rate double, blocks long").withColumnRenamed("source", "plan_source")
    todo = sized.join(table, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    todo = todo.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")).drop("rate")
    most_blocks, level, done = max((x[4] for x in plan), default=1), 0, []
    while True:
        last = most_blocks == 1
        spread = todo.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(level)), F.col("blocks")))
        flown = spread.groupBy("source", "block").applyInPandas(_flight_of(level, last), spread.schema)
        flown = materialize(spark, flown.drop("block"), "flight")
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(flown.where(settled))
        if last:
            break
        # two at most are left of every block
        todo = flown.where(~settled).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("blocks") * 2 / F.lit(block))).cast("long"))
        most_blocks, level = max(1, -(-most_blocks * 2 // block)), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def _flight_of(level: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text_hash", "size"], kind="stable", ignore_index=True)
        source, block = frame["source"].iloc[0], frame["block"].iloc[0]
        seed = zlib.crc32(f"{level}:{block}:{source}".encode())
        frame["p"] = flight(frame["p"].to_numpy(), frame["size"].to_numpy(), seed, last)
        return frame

    return run


def _flight_of(level: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text_hash", "size"], kind="stable", ignore_index=True)
        source, block = frame["source"].iloc[0], frame["block"].iloc[0]
        seed = zlib.crc32(f"{level}:{block}:{source}".encode())
        frame["p"] = flight(frame["p"].to_numpy(), frame["size"].to_numpy(), seed, last)
        return frame

    return run


def mixed_rows(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken.

    Rows that agree in id, text and source are one row here, repeated as often as all
    of them are taken.
    """
    key = ["doc_id", "text_hash", "source"]
    taken = mix(spark, docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = taken.where("copies > 0").groupBy(*key).agg(F.sum("copies").cast("int").alias("copies"))
    taken = taken.toDF("mix_id", "mix_hash", "mix_source", "copies")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, text, source = (F.col(f"c{names.index(c)}") for c in (id_col, text_col, source_col))
    plain = plain.withColumn("mix_h", F.xxhash64(text.cast("string")))
    same = own.eqNullSafe(F.col("mix_id")) & (F.col("mix_h") == F.col("mix_hash")) & source.cast("string").eqNullSafe(F.col("mix_source"))
    once = plain.join(taken, same).dropDuplicates(["mix_id", "mix_hash", "mix_source"])
    repeated = once.withColumn("one", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
