"""Exact dedup of lines: hashes sorted by range, first occurrences streamed, keep bitmaps out."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import buffers
from panelwright.llm.stored import stored

MIN_CHARS = 40  # code points of a key that counts
MIN_DOCS = 5  # documents that hold a repeated key

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SECOND = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)  # values of bytes for another hash


def text_key(text: Column) -> Column:
    """With the id, what tells texts apart; a null text is as an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keys(min_chars: int):
    """Hashes and places of each line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in buffers.slices(batches, "text"):
            if len(batch) > 1:  # rows that repeat as a whole say nothing new
                order = pa.table([batch.column("doc"), batch.column("tk"), pa.array(np.arange(len(batch)))], ["doc", "tk", "i"])
                first = order.group_by(["doc", "tk"]).aggregate([("i", "min")]).column("i_min").combine_chunks()
                batch = batch.take(first.sort()) if len(first) < len(batch) else batch
            data, offsets = buffers.texts_of(batch.column("text"))
            data = _LOWER[data]
            breaks = np.flatnonzero(data == 0x0A)
            starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
            row = np.concatenate([np.arange(len(batch)), buffers.rows_of(breaks, offsets)])
            row = np.sort(row, kind="stable")
            number = np.arange(len(starts)) - np.searchsorted(row, row)
            ends = np.append(starts[1:] - 1, len(data))
            last = np.append(row[1:] != row[:-1], True)
            ends[last] = offsets[1:][row[last]]
            filled = np.flatnonzero(~buffers._WORD_BREAK[data])
            if len(filled):
                head = np.searchsorted(filled, starts)
                tail = np.searchsorted(filled, ends) - 1
                some = head <= tail
                begin = np.where(some, filled[np.minimum(head, len(filled) - 1)], starts)
                stop = np.where(some, filled[tail] + 1, starts)
            else:
                begin = stop = starts
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            long = np.flatnonzero(points[stop] - points[begin] >= min_chars)
            begin, stop, row, number = begin[long], stop[long], row[long], number[long]
            one = two = np.zeros(0, np.uint64)
            if len(long):
                one = buffers.span_hashes(data, begin, stop)
                two = buffers.span_hashes(_SECOND[data], begin, stop)
            place = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column("doc").take(place),
                 batch.column("tk").take(place), pa.array(number.astype(np.int32))],
                names=["h", "g", "doc", "tk", "line"],
            )

    return run


def _changes(*columns: pa.Array) -> np.ndarray:
    """Which rows differ from the one before; nulls are equal, the first row differs."""
    out = np.ones(len(columns[0]), bool)
    for k, x in enumerate(columns):
        differs = pc.fill_null(pc.not_equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False)
        empty = x.is_null().to_numpy(zero_copy_only=False)
        differs = differs | (empty[1:] != empty[:-1])
        out[1:] = out[1:] | differs if k else differs
    return out


def _told(part: pa.RecordBatch, open_: bool, docs: int | None = None, leader=None) -> pa.RecordBatch:
    """Lines that go, or lines and sums of an open run."""
    id_type = part.column("doc").type
    more = [pa.array([docs] * len(part), pa.int64()), pa.array([leader] * len(part), id_type), pa.array([open_] * len(part))]
    line = part.column("line") if docs is None else pa.array([-1] * len(part), pa.int32())
    kept = [part.column(x) for x in ("h", "g", "doc", "tk")]
    return pa.RecordBatch.from_arrays([*kept, line, *more], names=["h", "g", "doc", "tk", "line", "docs", "leader", "open"])


def _streamed(min_docs: int):
    """Lines that go, of the sorted lines of one range, in one pass.

    A run of equal hashes lists its documents from the largest id on: the first holds the occurrence that
    stays, and from the `min_docs`-th on all others go. Until then at most `min_docs` - 1 documents' lines
    wait. The first run of a range may have begun before it and the last one may go on after it: what they
    can't decide is passed on as open, with one row more, line -1, that tells how many documents the run
    has here, which is the first (leader) and which the last (doc).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, leader, waiting, head, last = 0, None, [], True, None  # of the run that goes on
        for batch in batches:
            if not len(batch):
                continue
            joined = batch if last is None else pa.concat_batches([last, batch])
            skip = len(joined) - len(batch)
            new_run = _changes(joined.column("h"), joined.column("g"))[skip:]
            new_doc = _changes(*(joined.column(x) for x in ("h", "g", "doc")))[skip:]
            edges = np.unique(np.concatenate([[0], np.flatnonzero(new_run), [len(batch)]]))
            # runs between the first and the last one of the batch begin and end in it: all at once
            a, b = edges[1:-2], edges[2:-1]
            number = np.cumsum(new_doc)
            many = number[b - 1] - number[a] + 1 >= min_docs
            rows = buffers.ranges(a[many], (b - a)[many])
            rows = rows[number[rows] != np.repeat(number[a[many]], (b - a)[many])]
            if len(rows):
                yield _told(batch.take(pa.array(rows)), False)
            for k in sorted({0, len(edges) - 2}):
                a, b = int(edges[k]), int(edges[k + 1])
                if new_run[a]:
                    if last is not None and head:
                        yield _told(last, True, docs, leader)
                    head = last is None
                    docs, leader, waiting = 0, batch.column("doc")[a].as_py(), []
                part = batch.slice(a, b - a)
                at = docs + np.cumsum(new_doc[a:b])  # of the run's documents, the how-manieth
                docs, last = int(at[-1]), batch.slice(b - 1, 1)
                if head:
                    yield _told(part, True)
                    continue
                waiting.append(part.filter(pa.array(at > 1)))
                if docs >= min_docs:  # the run began here, so its first document is the largest of all
                    yield from (_told(x, False) for x in waiting if len(x))
                    waiting = []
        if last is not None:
            yield from (_told(x, True) for x in waiting if len(x))
            yield _told(last, True, docs, leader)

    return run


def dropped(docs: DataFrame, min_chars: int, min_docs: int, id_column: str, text_column: str) -> DataFrame:
    """Lines that go: doc, tk and line (from 0)."""
    kind = docs.schema[id_column].dataType.simpleString()
    read = docs.select(F.col(id_column).alias("doc"), text_key(F.col(text_column)).alias("tk"), F.col(text_column).alias("text"))
    schema = f"h bigint, g bigint, doc {kind}, tk bigint, line int"
    lines = stored(read.mapInArrow(_keys(min_chars), schema), "line-hashes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h", "g", F.col("doc").desc_nulls_last(), "tk", "line"]
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema += f", docs bigint, leader {kind}, open boolean"
    found = ranged.mapInArrow(_streamed(min_docs), schema)
    found = stored(found.withColumn("part", F.spark_partition_id()), "line-runs")
    # the sums of runs at the edges, two rows a range at most, so they may be broadcast: put together what belongs together
    along = Window.partitionBy("h", "g").orderBy("part")
    again = F.lag("part").over(along).isNotNull() & F.lag("doc").over(along).eqNullSafe(F.col("leader"))
    sums = found.filter("open AND line = -1").withColumn("docs", F.col("docs") - again.cast("int"))
    whole = sums.groupBy("h", "g").agg(F.sum("docs").alias("all"), F.max("leader").alias("keeper"))
    whole = whole.filter(F.col("all") >= min_docs).select("h", "g", "keeper")
    rest = found.filter("open AND line >= 0").join(F.broadcast(whole), ["h", "g"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    return found.filter("NOT open").select("doc", "tk", "line").unionByName(rest.select("doc", "tk", "line"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the lines that stay, compressed."""
    for batch in batches:
        maps, gone = [], batch.column("gone")
        for count, lines in zip(batch.column("n_lines").to_pylist(), gone, strict=True):
            kept = np.ones(count, np.uint8)
            if lines.is_valid:
                kept[lines.values.to_numpy()] = 0
            maps.append(zlib.compress(np.packbits(kept).tobytes(), 1))
        n_dropped = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("tk"), batch.column("n_lines"), n_dropped, pa.array(maps, pa.binary())],
            names=["doc", "tk", "n_lines", "n_dropped", "keep"],
        )


def kept_lines(keep: bytes, n_lines: int) -> np.ndarray:
    """Which lines of a text stay, from its bitmap."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """For each document a compressed bitmap of the lines that stay, instead of its text.

    A line's key is the line without ASCII blanks at both ends, A-Z lower-cased. Keys of `min_chars` code
    points or more that `min_docs` documents or more hold lose all their lines but those of the largest id.
    Columns: doc (the id), tk (text_key of the text), n_lines, n_dropped, keep (see kept_lines).

    Hashes of 128 bits stand for keys. They are dealt by ranges of (hash, id from the largest, place) and
    sorted, so a line that very many documents hold lies in many ranges and each is streamed once; the sums
    of runs that cross the edges of ranges meet in a table of two rows a range.

    Null or empty text: one empty line. Rows are told apart by id and text: rows that repeat both are one
    document and have one row here; rows of one id with different texts are one document to the count, and
    where its id is the largest the lines stay in all its rows. A null id is one document below all others.
    Other columns are ignored, whatever their names. Empty table: empty result.
    """
    gone = dropped(docs, min_chars, min_docs, id_column, text_column)
    gone = gone.groupBy("doc", "tk").agg(F.collect_set("line").alias("gone"))  # as many as the text has lines
    text = F.coalesce(F.col(text_column), F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    every = docs.select(F.col(id_column).alias("doc"), text_key(F.col(text_column)).alias("tk"), (breaks + 1).cast("bigint").alias("n_lines"))
    every = every.groupBy("doc", "tk").agg(F.max("n_lines").alias("n_lines"))
    found = _same(every, gone, "left")
    schema = f"doc {docs.schema[id_column].dataType.simpleString()}, tk bigint, n_lines bigint, n_dropped bigint, keep binary"
    return found.select("doc", "tk", "n_lines", "gone").mapInArrow(_packed, schema)


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Rows of the same id and text; ids may be null."""
    other = right.withColumnsRenamed({"doc": "__doc", "tk": "__tk"})
    return left.join(other, (F.col("tk") == F.col("__tk")) & F.col("doc").eqNullSafe(F.col("__doc")), how).drop("__doc", "__tk")


def _applied(digest: bool):
    """Texts without the lines that go, or their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in buffers.slices(batches, "__text"):
            out = []
            columns = (batch.column(x) for x in ("__text", "n_lines", "n_dropped", "keep"))
            for text, n_lines, n_dropped, keep in zip(*columns, strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if n_dropped.as_py():
                    stays = kept_lines(keep.as_py(), n_lines.as_py())
                    raw = b"\n".join(x for x, stay in zip(raw.split(b"\n"), stays, strict=True) if stay)
                out.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode() if text.is_valid else None)
            if digest:
                kept = [batch.column(x) for x in ("doc", "n_lines", "n_dropped")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.string())], names=["doc", "n_lines", "n_dropped", "kept_sha256"])
            else:
                names = [x for x in batch.schema.names if x not in ("doc", "tk", "n_lines", "n_dropped", "keep")]
                new = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([new if x == "__text" else batch.column(x) for x in names], names=names)

    return run


def removed(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Figures of each document without its repeated lines: id, n_lines, n_dropped, kept_sha256.

    One row per row of `docs`; everything else as bitmaps() says. Where all lines go the empty text stays.
    """
    maps = bitmaps(docs, min_chars, min_docs, id_column, text_column)
    read = docs.select(F.col(id_column).alias("doc"), text_key(F.col(text_column)).alias("tk"), F.col(text_column).alias("__text"))
    kind = docs.schema[id_column].dataType.simpleString()
    figures = _same(read, maps, "inner").mapInArrow(_applied(True), f"doc {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")
    return figures.withColumnRenamed("doc", id_column)


def clean(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """All rows and columns of `docs`, the texts without the lines that bitmaps() drops; null texts stay null."""
    maps = bitmaps(docs, min_chars, min_docs, id_column, text_column)
    held = {x: f"__own{k}" for k, x in enumerate(docs.columns) if x != text_column}
    read = docs.withColumnsRenamed({**held, text_column: "__text"})
    read = read.withColumns({"doc": F.col("__text" if id_column == text_column else held[id_column]), "tk": text_key(F.col("__text"))})
    kept = [held.get(x, "__text") for x in docs.columns]
    schema = ", ".join(f"`{k}` {docs.schema[x].dataType.simpleString()}" for k, x in zip(kept, docs.columns, strict=True))
    out = _same(read, maps, "inner").select(*kept, "doc", "tk", "n_lines", "n_dropped", "keep").mapInArrow(_applied(False), schema)
    return out.toDF(*docs.columns)


# The rows of the query op13 in DuckDB.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, x, translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), often AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN often USING (k) GROUP BY doc_id
"""
