"""Nearest neighbours by an adaptive dimension scan of probed lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.stored import free, stored

FIT_ROWS = 20_000  # vectors on which lists are fitted at most, drawn by a hash of the id
LIST_ROWS = 1000  # rows of a list aimed at
MOST_LISTS = 4096
PROBES = 0.7  # part of the lists that a query visits, more until they hold LEAST_ROWS rows
LEAST_ROWS = 4000
WITHIN = 3  # a query's bound, taken from the fitted vectors, is to leave about WITHIN * k rows
LEAST_SEEDS = 8  # fitted vectors within the bound at least
ROW_BYTES, QUERY_BYTES = 32 << 20, 16 << 20  # of the vectors of the rows and the queries that meet in a task, as doubles
LEAST_PARTS = 24  # parts of the rows, unless they are few
SLICE = 256  # queries whose visits are found at once
KEPT = 1 << 20  # answers of a task held before all but the best are dropped
BLOCK = 33  # dimensions of a column block
SURENESS = 1.6  # how sure a test must be before it abandons a candidate
CHUNK = 1 << 18  # pairs held at once


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Ids and vectors that take part, once per id; vectors of another size than most take none."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    size = rows.groupBy(F.size("vector").alias("n")).count().agg(F.max_by("n", F.struct("count", "n"))).scalar()
    return rows.filter(F.size("vector") == size)


def _rotation(size: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more dimension, so that all vectors are as long as the longest: distance orders as product."""
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))[:, None]], 1)


def centres(sample: np.ndarray, lists: int, seed: int = 9, rounds: int = 8) -> np.ndarray:
    """Means of `lists` clusters of the sample."""
    rng = np.random.default_rng(seed)
    means = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, means, 1)[:, 0]
        counts = np.bincount(near, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, near, sample)
        means[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return means


def nearest(x: np.ndarray, means: np.ndarray, n: int) -> np.ndarray:
    """The n nearest means of each row, nearest first."""
    n, out = min(n, len(means)), []
    for part in np.array_split(x, max(1, len(x) * len(means) // (1 << 21))):
        far = (means**2).sum(1) - 2 * part @ means.T
        few = np.argpartition(far, n - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(few, np.argsort(np.take_along_axis(far, few, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def first_bounds(q_ids: np.ndarray, flat: np.ndarray, ids: np.ndarray, seeds: np.ndarray, within: int) -> np.ndarray:
    """Squared distance of each query to its `within`-th best of the seeds, not counting itself."""
    out = np.full(len(flat), np.inf)
    step = max(1, CHUNK * 4 // max(1, len(seeds)))
    for begin in range(0, len(flat) if len(seeds) > within else 0, step):
        q = flat[begin : begin + step]
        far = (q**2).sum(1)[:, None] + (seeds**2).sum(1) - 2 * q @ seeds.T
        far[q_ids[begin : begin + step, None] == ids] = np.inf
        out[begin : begin + step] = np.partition(far, within - 1, axis=1)[:, within - 1]
    return out


def scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, longest: float, rotation: np.ndarray, bound: np.ndarray):
    """The best k rows of one list part for each query: places of queries and rows, and inner products.

    Rows are rotated and cut into blocks of columns. After each block a pair whose partial distance,
    scaled up, lies surely beyond the query's bound is abandoned; no list can do better than to hold k rows
    within it. Scores come from the vectors as they are.
    """
    size = q.shape[1] + 1
    blocks = -(-size // BLOCK)
    turned_x = np.zeros((len(x), blocks * BLOCK))
    turned_q = np.zeros((len(q), blocks * BLOCK))
    turned_x[:, :size] = lifted(x, longest) @ rotation
    turned_q[:, :size] = np.concatenate([q, np.zeros((len(q), 1))], 1) @ rotation
    columns = np.ascontiguousarray(turned_x.reshape(len(x), blocks, BLOCK).transpose(1, 0, 2))
    found = []
    step = max(1, CHUNK // max(1, len(x)))
    for begin in range(0, len(q), step):
        rows_q = np.repeat(np.arange(begin, min(begin + step, len(q))), len(x))
        rows_x = np.tile(np.arange(len(x)), len(rows_q) // len(x))
        partial = np.zeros(len(rows_q))
        for b in range(blocks):
            mine = turned_q[:, b * BLOCK : (b + 1) * BLOCK]
            if b == 0:  # all pairs are alive: one matrix product
                m = mine[begin : begin + step]
                partial += ((m**2).sum(1)[:, None] + (columns[0] ** 2).sum(1) - 2 * m @ columns[0].T).ravel()
            else:
                partial += ((columns[b][rows_x] - mine[rows_q]) ** 2).sum(1)
            seen = min((b + 1) * BLOCK, size)
            if seen < size:
                alive = partial * (size / seen) <= bound[rows_q] * (1 + SURENESS / math.sqrt(seen)) ** 2
            else:
                alive = partial <= bound[rows_q] * (1 + 1e-9) + 1e-9
            rows_q, rows_x, partial = rows_q[alive], rows_x[alive], partial[alive]
        other = q_ids[rows_q] != ids[rows_x]
        rows_q, rows_x = rows_q[other], rows_x[other]
        score = (q[rows_q] * x[rows_x]).sum(1)
        order = np.lexsort((ids[rows_x], -score, rows_q))
        rows_q, rows_x, score = rows_q[order], rows_x[order], score[order]
        place = np.arange(len(rows_q)) - np.searchsorted(rows_q, rows_q)
        found.append((rows_q[place < k], rows_x[place < k], score[place < k]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one size, a row each."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(flat), -1)


def _vectors(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if x.ndim > 1 else 0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()).cast(kind))


class Parts:
    """The lists one after another, cut into parts of equally many rows. A list may be in several parts, its rows dealt by a hash."""

    def __init__(self, sizes: np.ndarray, rows: int):
        self.sizes, self.rows = sizes, rows
        self.begins = np.cumsum(sizes) - sizes
        self.first = self.begins // rows
        self.last = np.maximum(self.begins + sizes - 1, self.begins) // rows
        self.number = int(-(-sizes.sum() // rows))

    def of(self, lists: np.ndarray, deal: np.ndarray) -> np.ndarray:
        """The part of each row from its list and a hash below 2^20."""
        return (self.begins[lists] + (deal * self.sizes[lists] >> 20)) // self.rows

    def lists(self, part: int) -> slice:
        """The lists that have rows in a part."""
        return slice(int(np.searchsorted(self.last, part)), int(np.searchsorted(self.first, part, side="right")))


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, probes: float = PROBES, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """The k rows with the largest inner product for each query: the rows whose id `every` divides.

    Lists are clusters fitted on at most FIT_ROWS vectors; every row is put into its nearest list and
    every query visits its nearest lists. The lists are cut into parts of many rows, and the queries are dealt by a hash; a
    task scans the lists of one part for one deal of queries, each in the lists it visits. So a query is moved once per part
    with a list of it, not once per list, and a task holds parts of bounded size however large the table or a list is. It gives
    at most k rows for a query, which a ranking with a limit merges.

    Vectors that are null, zero, hold null or non-finite components, or have another size than most take no
    part, nor do null ids; an id that comes twice counts once, with its smaller vector. Equal scores go to
    the smaller id. Fewer than k candidates: all of them. Other columns are ignored, whatever their names.
    Empty table: empty result.
    """
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_column, vector_column), "neighbours-rows")
    count, longest = rows.agg(F.count(F.lit(1)), F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not count:
        return spark.createDataFrame([], schema)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    sample = np.array(drawn.column("vector").to_pylist(), np.float64)
    sample = lifted(sample, longest)
    means = centres(sample, max(1, min(MOST_LISTS, count // LIST_ROWS)))
    rotation = _rotation(sample.shape[1])
    seeds, seed_ids = sample, drawn.column("id").to_numpy()

    def put(batches):
        for batch in batches:
            x = _matrix(batch.column("vector"))
            lists = nearest(lifted(x, longest), means, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int64))], names=["list"])

    sizes = np.zeros(len(means), np.int64)
    for r in rows.select("vector").mapInArrow(put, "list long").groupBy("list").count().collect():  # a row per list, at most MOST_LISTS
        sizes[r["list"]] = r["count"]
    least = max(LIST_ROWS, -(-count // LEAST_PARTS))
    parts = Parts(sizes, int(min(max(1, ROW_BYTES // (8 * sample.shape[1])), least)))
    narrow = vectors.schema[vector_column].dataType.elementType == T.FloatType()  # floats are moved as they are
    kind = pa.float32() if narrow else pa.float64()

    def deal(batches):
        for batch in batches:
            x = _matrix(batch.column("vector"))
            lists = nearest(lifted(x, longest), means, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            mine = parts.of(lists, batch.column("deal").to_numpy())
            columns = [batch.column("id"), _vectors(x, kind), pa.array(lists.astype(np.int32)), pa.array(mine.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "list", "part"])

    vector = f"vector array<{'float' if narrow else 'double'}>"
    placed = rows.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(1 << 20))).mapInArrow(deal, f"id long, {vector}, list int, part int")

    ranked = stored(_answers(rows, placed, parts, vector, means, longest, rotation, (seed_ids, seeds), k, every, probes), "neighbours")
    # a query whose tests left fewer than it can have is answered again without tests, from all lists
    full = ranked.filter(F.col("rank") == min(k, count - 1)).select(F.col("query_id").alias("id"))
    short = rows.join(full, "id", "left_anti").filter(F.pmod("id", F.lit(every)) == 0)
    if count < 2 or not short.limit(1).count():
        free(rows)
        return ranked
    none = (seed_ids[:0], seeds[:0])
    again = stored(_answers(short, placed, parts, vector, means, longest, rotation, none, k, every, 1.0), "neighbours-again")
    free(rows)
    return ranked.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(again)


def _answers(
    rows: DataFrame, placed: DataFrame, parts: Parts, vector: str, means: np.ndarray, longest: float, rotation: np.ndarray,
    seeded: tuple[np.ndarray, np.ndarray], k: int, every: int, probes: float,
) -> DataFrame:
    """Ranked answers to the queries among `rows`."""
    seed_ids, seeds = seeded
    sizes = parts.sizes
    kind = pa.float32() if "float" in vector else pa.float64()
    # of the rows within the bound, the seeds are the same part as of all rows
    within = max(LEAST_SEEDS, math.ceil(WITHIN * k * len(seeds) / sizes.sum()))

    def probe(batches):
        for whole in batches:
            for begin in range(0, len(whole), SLICE):
                batch = whole.slice(begin, SLICE)
                ids, x = batch.column("id").to_numpy(), _matrix(batch.column("vector"))
                flat = np.concatenate([x, np.zeros((len(x), 1))], 1)
                near = nearest(flat, means, len(means))
                # the nearest lists, so many that they are `probes` and hold LEAST_ROWS rows
                before = np.cumsum(sizes[near], axis=1) - sizes[near]
                chosen = ((np.arange(near.shape[1]) < probes * len(means)) | (before < LEAST_ROWS)) & (sizes[near] > 0)
                visits = np.zeros(chosen.shape, bool)
                np.put_along_axis(visits, near, chosen, axis=1)
                bound = first_bounds(ids, flat, seed_ids, seeds, within)
                for part in range(parts.number):
                    mine = parts.lists(part)
                    row, at = np.nonzero(visits[:, mine])
                    asks = np.unique(row)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.append(np.searchsorted(row, asks), len(row)).astype(np.int32)), pa.array((at + mine.start).astype(np.int32))
                    )
                    columns = [pa.array(ids[asks]), _vectors(x[asks], kind), lists, pa.array(bound[asks]), pa.array(np.full(len(asks), part, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "lists", "bound", "part"])

    asking = rows.filter(F.pmod("id", F.lit(every)) == 0)
    turns = max(1, -(-asking.count() * 8 * means.shape[1] // QUERY_BYTES))
    asked = asking.mapInArrow(probe, f"id long, {vector}, lists array<int>, bound double, part int")
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int"))
    placed = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def meet(queries: pa.Table, mine: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(queries) and len(mine):
            q, x = _matrix(queries.column("vector")), _matrix(mine.column("vector"))
            q_ids, ids, bound = queries.column("id").to_numpy(), mine.column("id").to_numpy(), queries.column("bound").to_numpy()
            lists = queries.column("lists").combine_chunks()
            asks = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            visited = lists.flatten().to_numpy()
            by_list = np.argsort(visited, kind="stable")
            at = mine.column("list").to_numpy()
            order = np.argsort(at, kind="stable")
            held = 0
            for one in np.unique(at):
                these = order[np.searchsorted(at, one, sorter=order) : np.searchsorted(at, one, side="right", sorter=order)]
                who = asks[by_list[np.searchsorted(visited, one, sorter=by_list) : np.searchsorted(visited, one, side="right", sorter=by_list)]]
                if len(who):
                    a, b, score = scan(q_ids[who], q[who], ids[these], x[these], k, longest, rotation, bound[who])
                    out.append((q_ids[who[a]], ids[these[b]], score))
                    held += len(score)
                if held > KEPT:
                    out = [_best(out, k)]
                    held = 0
        return pa.Table.from_arrays([pa.array(c) for c in _best(out, k)], names=["query_id", "vec_id", "score"])

    keys = ["part", "turn"]
    found = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best answers to each query."""
    queries, rows, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((rows, -score, queries))
    queries, rows, score = queries[order], rows[order], score[order]
    kept = np.arange(len(queries)) - np.searchsorted(queries, queries) < k
    return queries[kept], rows[kept], score[kept]
