"""Approximate nearest neighbours by cosine: a navigable small-world graph per shard.

Equal vectors are one node, which keeps the ids that can be asked for. Nodes are dealt
to shards of about ``SHARD`` by a hash of the vector. A shard's graph is hierarchical:
a node is on as many levels as a draw says; nodes are inserted in a fixed order, each
linked on every level to diverse ones among its ``CANDIDATES`` nearest before it, and
lists that grow too long are thinned in the same way. The nearest are found exactly,
block by block, as a shard is small. Links are stored as flat arrays of neighbours with
offsets, one row per shard.

A search descends greedily from the top level and keeps the ``EF`` best on the lowest;
all queries of a block move in step. Every block of queries visits every shard; the
answers of a shard are scored anew on the original vectors in double precision and
merged.

Vectors that are null, zero or hold null or non-finite components take no part, nor do
null ids. A shorter vector counts as filled up with zeros. Ties go to the smaller
vec_id; a query leaves out the rows of its own id; a query id that is repeated is asked
once, with its smallest vector. Without queries or rows the answer is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.vectors import best, block_of, matrix, usable, widened
from tallyhouse.session import materialize

SHARD = 4096
LINKS = 16
CANDIDATES = 100
EF = 128
QUERIES = 512
_FLUSH = 20_000


def _diverse(near: np.ndarray, among: np.ndarray, most: int) -> list[int]:
    """Places of those candidates, nearest first, that are nearer to the node than to one
    already chosen; the nearest others fill up. near: similarity to the node, descending."""
    chosen, closest = [], np.full(len(near), -np.inf)
    free = np.ones(len(near), dtype=bool)
    while len(chosen) < most:
        fit = np.flatnonzero(free & (closest < near))
        if not len(fit):
            break
        i = int(fit[0])
        chosen.append(i)
        free[: i + 1] = False
        np.maximum(closest, among[i], out=closest)
    if len(chosen) < most:
        taken = set(chosen)
        chosen += [i for i in range(len(near)) if i not in taken][: most - len(chosen)]
    return chosen


def _links(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat neighbours and offsets of one level; rows are in the order of insertion."""
    n, lists = len(x), [[] for _ in range(len(x))]

    def thin(j: int) -> None:
        own = np.array(lists[j])
        near = x[own] @ x[j]
        order = np.lexsort((own, -near))
        own, near = own[order], near[order]
        lists[j] = own[_diverse(near, x[own] @ x[own].T, most)].tolist()

    for at in range(0, n, 256):
        sims = x[at : at + 256] @ x[: at + 256].T
        for i in range(max(at, 1), min(at + 256, n)):
            row = sims[i - at, :i]
            own = np.argpartition(-row, CANDIDATES)[:CANDIDATES] if i > CANDIDATES else np.arange(i)
            own = own[np.lexsort((own, -row[own]))]
            for j in own[_diverse(row[own], x[own] @ x[own].T, min(LINKS, most))].tolist():
                lists[i].append(j)
                lists[j].append(i)
                if len(lists[j]) > 2 * most:
                    thin(j)
    for j in range(n):
        if len(lists[j]) > most:
            thin(j)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in lists]))).astype(np.int32)
    return np.fromiter((j for s in lists for j in s), np.int32, int(offsets[-1])), offsets


class Graph:
    """levels: (members, neighbours, offsets), neighbours being places among the members,
    which are rows of the vectors in ascending order."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None):
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.unit = (x / np.where(norms > 0, norms, 1)).astype(np.float32)
        if levels is None:
            draw = np.random.Generator(np.random.PCG64(len(x))).random(len(x))
            height = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int)
            levels = []
            for level in range(int(height.max(initial=0)) + 1):
                members = np.flatnonzero(height >= level).astype(np.int32)
                levels.append((members, *_links(self.unit[members], 2 * LINKS if level == 0 else LINKS)))
        self.levels = levels

    @staticmethod
    def _padded(neighbours: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = np.diff(offsets)
        out = np.full((len(size), max(1, int(size.max(initial=0)))), -1, dtype=np.int32)
        out[np.arange(out.shape[1]) < size[:, None]] = neighbours
        return out

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """Rows of the ``ef`` best found for every query, -1 where there are fewer."""
        norms = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        q = (queries / np.where(norms > 0, norms, 1)).astype(np.float32)
        every = np.arange(len(q))
        current = np.full(len(q), self.levels[-1][0][0], dtype=np.int64)
        near = (self.unit[current] * q).sum(axis=1)
        for members, neighbours, offsets in self.levels[:0:-1]:
            table, place = self._padded(neighbours, offsets), np.searchsorted(members, current)
            moving = every
            while len(moving):
                options = table[place[moving]]
                rows = members[np.maximum(options, 0)]
                sims = np.where(options >= 0, np.einsum("ijk,ik->ij", self.unit[rows], q[moving]), -np.inf)
                pick = sims.argmax(axis=1)
                value = sims[np.arange(len(moving)), pick]
                better = value > near[moving]
                moving, pick, options = moving[better], pick[better], options[better]
                near[moving] = value[better]
                place[moving] = options[np.arange(len(moving)), pick]
            current = members[place].astype(np.int64)
        return self._beam(q, current, near, ef)

    def _beam(self, q: np.ndarray, start: np.ndarray, near: np.ndarray, ef: int) -> np.ndarray:
        table = self._padded(*self.levels[0][1:])
        n, m = len(q), len(self.unit)
        seen = np.zeros((n, m + 1), dtype=bool)
        seen[:, m] = True
        seen[np.arange(n), start] = True
        rows = np.full((n, ef), m, dtype=np.int64)
        sims = np.full((n, ef), -np.inf, dtype=np.float32)
        done = np.ones((n, ef), dtype=bool)
        rows[:, 0], sims[:, 0], done[:, 0] = start, near, False
        active = np.arange(n)
        while len(active):
            open_ = np.where(done[active], -np.inf, sims[active])
            pick = open_.argmax(axis=1)
            alive = open_[np.arange(len(active)), pick] > -np.inf
            active, pick = active[alive], pick[alive]
            if not len(active):
                break
            done[active, pick] = True
            options = table[rows[active, pick]].astype(np.int64)
            options[options < 0] = m
            new = ~seen[active[:, None], options]
            options[~new] = m
            seen[active[:, None], options] = True
            found = np.where(new, np.einsum("ijk,ik->ij", self.unit[np.minimum(options, m - 1)], q[active]), -np.inf)
            all_sims = np.concatenate([sims[active], found], axis=1)
            all_rows = np.concatenate([rows[active], options], axis=1)
            all_done = np.concatenate([done[active], ~new], axis=1)
            keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            sims[active] = np.take_along_axis(all_sims, keep, axis=1)
            rows[active] = np.take_along_axis(all_rows, keep, axis=1)
            done[active] = np.take_along_axis(all_done, keep, axis=1)
        return np.where(np.isfinite(sims), rows, -1)


def _distinct(k: int, width: int):
    """Equal vectors of a task with the k + 1 smallest ids of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["v", "ids"])

        for batch in batches:
            x = widened(matrix(batch.column(1)), width) + 0.0
            for key, row, use in zip(batch.column(0).to_pylist(), x, x.any(axis=1).tolist(), strict=True):
                if use:
                    ids = held.setdefault(row.tobytes(), [])
                    if len(ids) <= k or key < ids[-1]:
                        ids[:] = sorted({*ids, key})[: k + 1]
            if len(held) > _FLUSH:
                yield out()
                held.clear()
        yield out()

    return run


def _build(table: pa.Table) -> pa.Table:
    order = np.argsort(np.array([r.as_py() for r in table["v"]], dtype=object), kind="stable")
    # a fixed order of insertion that does not follow the data
    order = order[np.random.Generator(np.random.PCG64(len(order))).permutation(len(order))]
    table = table.take(pa.array(order))
    x = np.frombuffer(b"".join(table["v"].to_pylist()), dtype=np.float64).reshape(table.num_rows, -1)
    levels = Graph(x).levels
    ids = table["ids"].to_pylist()
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
        "vectors": pa.array([x.tobytes()], pa.binary()),
        "ids": pa.array([[i for own in ids for i in own]], pa.list_(pa.int64())),
        "id_offsets": pa.array([np.concatenate(([0], np.cumsum([len(own) for own in ids])))], pa.list_(pa.int32())),
        "members": pa.array([np.concatenate([m for m, _, _ in levels])], pa.list_(pa.int32())),
        "neighbours": pa.array([np.concatenate([m for _, m, _ in levels])], pa.list_(pa.int32())),
        "offsets": pa.array([np.concatenate([m for _, _, m in levels])], pa.list_(pa.int32())),
        "level_sizes": pa.array([[v for m, nb, _ in levels for v in (len(m), len(nb))]], pa.list_(pa.int32())),
    })


_INDEX = (
    "shard int, vectors binary, ids array<long>, id_offsets array<int>, members array<int>, neighbours array<int>, "
    "offsets array<int>, level_sizes array<int>"
)


def build_index(spark: SparkSession, table: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> tuple[DataFrame, DataFrame, int]:
    """The stored index, a row per shard; the usable rows; the width of vectors. The
    index answers up to ``k`` neighbours beside the query itself."""
    rows = materialize(spark, usable(table, id_col, vector_col), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    nodes = rows.mapInArrow(_distinct(k, width), "v binary, ids array<long>").groupBy("v")
    nodes = nodes.agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    nodes = materialize(spark, nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard))
    index = nodes.withColumn("shard", block_of(shards, "v")).groupBy("shard").applyInArrow(_build, _INDEX)
    return materialize(spark, index, "graphs"), rows, width


def nearest(
    spark: SparkSession, table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD,
    ef: int = EF, queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose id is divisible by ``every``."""
    index, rows, width = build_index(spark, table, k, id_col, vector_col, shard)
    asked = rows.where((F.col("vec_id") % every == 0) & F.exists("v", lambda x: x != 0))
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    blocks = max(1, -(-asked.count() // queries))
    shards = index.select("shard")
    spread = asked.withColumn("block", block_of(blocks, "query_id"))
    spread = spread.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, (shards.agg(F.max("shard")).first()[0] or 0))))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(own: pa.Table, others: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if own.num_rows and others.num_rows:
            r = {c: own[c][0] for c in own.column_names}
            x = np.frombuffer(r["vectors"].as_buffer(), dtype=np.float64).reshape(-1, width)
            flat = {c: r[c].values.to_numpy() for c in ("ids", "id_offsets", "members", "neighbours", "offsets", "level_sizes")}
            levels, a, b, c = [], 0, 0, 0
            for m, nb in flat["level_sizes"].reshape(-1, 2).tolist():
                levels.append((flat["members"][a : a + m], flat["neighbours"][b : b + nb], flat["offsets"][c : c + m + 1]))
                a, b, c = a + m, b + nb, c + m + 1
            q = widened(matrix(others["q"]), width)
            found = Graph(x, levels).search(q, max(ef, 2 * k + 2))
            ids, ends = flat["ids"], flat["id_offsets"]
            for query_id, vector, places in zip(others["query_id"].to_pylist(), q, found, strict=True):
                places = places[places >= 0]
                near = x[places]
                score = (near * vector).sum(axis=1) / (np.sqrt((near * near).sum(axis=1)) * np.sqrt((vector * vector).sum()))
                answers = sorted((-s, i) for s, p in zip(score.tolist(), places.tolist(), strict=True) for i in ids[ends[p] : ends[p + 1]].tolist() if i != query_id)
                for s, i in answers[:k]:
                    for column, v in zip(out, (query_id, i, -s), strict=True):
                        column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({name: pa.array(v, t) for name, v, t in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})

    pairs = held.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block"))
    return best(pairs.applyInArrow(meet, "query_id long, vec_id long, score double"), k, "double")
