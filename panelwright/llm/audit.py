"""Audit of how filters interact: forward-backward path counts on the lattice of filter subsets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import buffers
from panelwright.llm.stored import stored

FILTERS = "ABCDE"
REPEATS = 16  # bit of filter E; those of A to D are 1, 2, 4 and 8
MIN_WORDS = 200
MARKS = b"#$%&*|"


def _held(bytes_of: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the chosen bytes each text holds."""
    sums = np.concatenate([[0], np.cumsum(bytes_of)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the filters A to D each whole text fails, and a digest of it."""
    marks = np.zeros(256, bool)
    marks[list(MARKS)] = True
    for batch in buffers.slices(batches, "text"):
        data, offsets = buffers.texts_of(batch.column("text"))
        starts, ends, rows = buffers.words_of(data, offsets)
        words = np.bincount(rows, minlength=len(batch))
        kinds = np.zeros(len(batch), np.int64)
        if len(starts):
            hashes = buffers.span_hashes(data, starts, ends)
            order = np.lexsort((hashes, rows))
            hashes, row = hashes[order], rows[order]
            new = np.ones(len(order), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            kinds = np.bincount(row[new], minlength=len(batch))
        points = _held((data & 0xC0) != 0x80, offsets)
        capitals = _held((data >= 0x41) & (data <= 0x5A), offsets)
        fails = [words < MIN_WORDS, 100 * kinds < 50 * words, 100 * capitals > 3 * points, _held(marks[data], offsets) > 0]
        mask = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
        view = memoryview(data)
        digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(digests, pa.binary())],
            names=["id", "part", "mask", "same"],
        )


def failures(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """Rows id, part, mask, n: n rows of `docs` with that id and part fail the filters of the bits of mask.

    A (1): fewer than 200 words; B (2): fewer than half of the words are distinct; C (4): more than 3 of 100
    code points are A-Z; D (8): holds one of #$%&*|; E (16): the text of a smaller id is the same.
    The smallest id of each text comes from map-side minima, and meets the rows by text and id, so copies
    of one text are never gathered. Digests of 128 bits stand for texts.
    """
    part = F.coalesce(F.col(part_column).cast("string"), F.lit(""))
    read = docs.select(F.col(id_column).alias("id"), part.alias("part"), F.col(text_column).alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    measured = read.mapInArrow(_measured, f"id {kind}, part string, mask int, same binary")
    measured = measured.groupBy("id", "part", "mask", "same").agg(F.count(F.lit(1)).alias("n"))
    measured = stored(measured, "audit-failures")
    first = measured.filter("id IS NOT NULL").groupBy("same").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    again = F.col("id").isNotNull() & F.col("first").isNull()
    found = measured.join(first, ["same", "id"], "left")
    return found.select("id", "part", (F.col("mask") + F.when(again, REPEATS).otherwise(0)).alias("mask"), "n")


def lattice(size: int) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int]]]:
    """Edges (state, bit, orders through it) of the subsets of `size` filters, and steps (order, step, edge).

    A state is the set of filters already applied. Forward counts say how many ways lead from the empty set
    to a state, backward counts how many lead on from it to the full set; their product over an edge is the
    number of orders that take it.
    """
    full = (1 << size) - 1
    bits = [1 << k for k in range(size)]
    forward, backward = {0: 1}, {full: 1}
    for state in range(1, full + 1):
        forward[state] = sum(forward[state ^ b] for b in bits if state & b)
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | b] for b in bits if not state & b)
    edges = [(s, b, forward[s] * backward[s | b]) for s in range(full + 1) for b in bits if not s & b]
    number = {(s, b): k for k, (s, b, _) in enumerate(edges)}
    steps = []
    for order in permutations(range(size)):
        state = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[x] for x in order), k + 1, number[state, bits[f]]))
            state |= bits[f]
    return edges, steps


def _sum(cells: str | Column, chosen, field: str) -> Column:
    return F.aggregate(F.filter(cells, chosen), F.lit(0).cast("bigint"), lambda total, c: total + c[field])


def _constants(rows: list[tuple], fields: str) -> Column:
    """A constant array of structs."""
    names = [f.split()[0] for f in fields.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return F.from_json(F.lit(text), f"array<struct<{', '.join(f.replace(' ', ': ') for f in fields.split(', '))}>>")


def audit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """What each step of each order of the five filters does, in each part of the documents.

    Rows (part, filter_order, step), all 120 orders of five steps, zeros included; long counts of the part's
    documents: kept after the step, removed by it, redundant (fail its filter, removed earlier), unique_fails
    (fail its filter only), good_lost and toxic_lost (removed, labels say so), and shapley: the removals of
    its filter summed over all orders, from its lattice edges weighted by the orders that take them.

    One pass over the texts; each part then is one row of at most 32 cells, so the lattice work is the same
    for any number of documents. Null text: empty. Null part: the empty string, as an empty one. A row with
    a null id never fails E and makes no other fail it, and has no labels. Repeated rows are documents each;
    rows of one id don't repeat each other. Labels that repeat an id count as soon as one of them says 1;
    null labels say nothing. Other columns are ignored, whatever their names. No documents: no rows.
    """
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    found = failures(docs, id_column, text_column, part_column).join(marks, "id", "left")

    def counted(chosen: Column) -> Column:
        return F.sum(F.when(chosen, F.col("n")).otherwise(0))

    cells = found.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), counted(F.col("good")).alias("good"), counted(F.col("toxic")).alias("toxic")
    )
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    parts = stored(parts, "audit-cells")

    edges, steps = lattice(len(FILTERS))

    def through(e: Column) -> Column:
        state, bit = e["state"], e["bit"]

        def arrives(c: Column) -> Column:
            return c["mask"].bitwiseAND(state) == 0

        def fails(c: Column) -> Column:
            return c["mask"].bitwiseAND(bit) != 0

        return F.struct(
            bit.alias("bit"),
            e["orders"].alias("orders"),
            _sum("cells", lambda c: arrives(c) & ~fails(c), "n").alias("kept"),
            _sum("cells", lambda c: arrives(c) & fails(c), "n").alias("removed"),
            _sum("cells", lambda c: ~arrives(c) & fails(c), "n").alias("redundant"),
            _sum("cells", lambda c: c["mask"] == bit, "n").alias("unique_fails"),
            _sum("cells", lambda c: arrives(c) & fails(c), "good").alias("good_lost"),
            _sum("cells", lambda c: arrives(c) & fails(c), "toxic").alias("toxic_lost"),
        )

    walked = parts.select("part", F.transform(_constants(edges, "state int, bit int, orders bigint"), through).alias("edges"))
    step = F.explode(_constants(steps, "filter_order string, step int, edge int"))
    rows = walked.select("part", "edges", step.alias("s")).withColumn("e", F.get("edges", F.col("s.edge")))
    shapley = F.aggregate(
        F.filter("edges", lambda x: x["bit"] == F.col("e.bit")), F.lit(0).cast("bigint"), lambda a, x: a + x["orders"] * x["removed"]
    )
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return rows.select("part", "s.filter_order", "s.step", *[f"e.{x}" for x in names], shapley.alias("shapley"))


# The rows of the query op11 in DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t
), f AS (
  SELECT part, doc_id, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, doc_id > first_id AS e
  FROM d JOIN firsts USING (t)
), m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS bad
  FROM f LEFT JOIN labels USING (doc_id) GROUP BY 1, 2
), b(k) AS (VALUES (0), (1), (2), (3), (4)
), o AS (
  SELECT [p.k, q.k, r.k, s.k, u.k] AS ks, chr(65 + p.k) || chr(65 + q.k) || chr(65 + r.k) || chr(65 + s.k) || chr(65 + u.k) AS filter_order
  FROM b p, b q, b r, b s, b u WHERE len(list_distinct([p.k, q.k, r.k, s.k, u.k])) = 5
), st AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, CAST(1 << ks[i] AS INTEGER) AS f,
    CAST(coalesce(list_sum(list_transform(ks[1:i - 1], lambda x: 1 << x)), 0) AS INTEGER) AS before
  FROM o, range(1, 6) t(i)
), x AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE mask & (before | f) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & f <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & f <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & f <> 0), 0) AS good_lost,
    coalesce(sum(bad) FILTER (WHERE mask & before = 0 AND mask & f <> 0), 0) AS toxic_lost
  FROM m, st GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM x
"""
