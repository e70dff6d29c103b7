"""Exact removal of repeated byte strings: the surroundings of shared anchors, merged by refining interleaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import buffers
from panelwright.llm.stored import free, stored

FIGURES = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
ROUNDS = 5  # symbols of a repeated string
SHARD_BYTES = 80_000  # bytes of contexts that form a shard
MERGE_BYTES = 400_000  # bytes merged at once; the working arrays are about 100 times as large
SPLIT_CONTEXTS = 256  # an anchor with more contexts is split by ranges of strings, so that none weighs on a task
HALVED_ROWS = 1000  # contexts halved at once
NODE = ["weight", "tk", "size", "at", "low", "high", "first", "around"]
ROWS = "core bigint, whole bigint, weight int, tk bigint, size bigint, at bigint, low int, high int, first bigint, around binary"


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i + width] for each i, in about log2(width) passes."""
    size, done = len(x) - width + 1, 1
    while 2 * done <= width:
        x = op(x[: len(x) - done], x[done:])
        done *= 2
    return op(x[:size], x[width - done : width - done + size])


def _covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which places lie within one of the ranges start..end-1."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of anchors: each string of `length` bytes has its least-hashed half as one.

    Equal strings have equal anchors at equal distances, so a string that repeats shows as an anchor
    that repeats.
    """
    gram = length // 2
    width = length - gram + 1
    sizes, ends = np.diff(offsets), offsets[1:]
    long = sizes >= length
    if not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(data)
    up, down = buffers.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.uint64(buffers._MULTIPLIER) * up[:-1], out=sums[1:])
    hashes = buffers.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least = _sliding(hashes, width, np.minimum)
    inside = _covered(offsets[:-1][long], ends[long] - length + 1, len(least))  # strings within one text
    least[~inside] = 0
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    best = _sliding(around, width, np.maximum)[: len(hashes)]
    places = np.flatnonzero((best == hashes) & (hashes > 0))
    # a hash may equal a minimum of the text before without lying in the text's own strings
    row = buffers.rows_of(places, offsets)
    whole = long[row] & (places + gram <= ends[row])
    return places[whole], hashes[places[whole]]


@dataclass
class Contexts:
    """Bytes of contexts, one after another; the text and first place of each; whether it has copies."""

    data: np.ndarray
    offsets: np.ndarray
    text: np.ndarray
    first: np.ndarray
    copied: np.ndarray


def merge(c: Contexts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and place within it of each string of `length` bytes that starts at two places or more.

    A symbol is a fifth of `length` in bytes, named by its fingerprint. Each shard's suffixes are sorted by one
    symbol on their own; the sorted columns are interleaved. In every round a suffix's predecessor by one
    symbol takes its place by that symbol, and within it by the interleave of the round before, so no suffix
    is compared beyond one symbol. This is the refinement of interleaves of Burrows-Wheeler transforms, but no
    transform is stored: the symbol before a suffix is looked up by its place. Neighbours that differ are
    parted; the round tells their common prefix. What stands alone can't repeat, nor can its predecessors,
    and is left out.
    The intervals that last until `length` bytes are the repeated strings.
    """
    step = length // ROUNDS
    sizes = np.diff(c.offsets)
    local = buffers.ranges(np.zeros(len(sizes), np.int64), sizes)
    left = np.repeat(sizes, sizes) - local
    names = np.zeros(len(c.data), np.uint64)
    starts = np.flatnonzero(left >= step)
    names[starts] = buffers.span_hashes(c.data, starts, starts + step)
    edges = np.unique(np.searchsorted(c.offsets, np.arange(0, c.offsets[-1] + SHARD_BYTES, SHARD_BYTES)))
    columns = []
    for a, b in zip(c.offsets[edges[:-1]], c.offsets[np.minimum(edges[1:], len(sizes))], strict=True):
        mine = a + np.flatnonzero(left[a:b] >= step)
        columns.append(mine[np.argsort(names[mine], kind="stable")])
    order = np.concatenate(columns) if columns else np.zeros(0, np.int64)
    order = order[np.argsort(names[order], kind="stable")]  # runs that are sorted already are merged
    split = np.ones(len(order), bool)
    split[1:] = names[order[1:]] != names[order[:-1]]
    symbol = np.zeros(len(c.data), np.int32)
    symbol[order] = np.cumsum(split)
    order, block = _together(order, split)
    for _ in range(ROUNDS - 1):
        inner = local[order] >= step
        before, block = order[inner] - step, block[inner]
        turn = np.argsort(symbol[before], kind="stable")
        order, block = before[turn], block[turn]
        split = np.ones(len(order), bool)
        split[1:] = (symbol[order[1:]] != symbol[order[:-1]]) | (block[1:] != block[:-1])
        order, block = _together(order, split)
    context = np.searchsorted(c.offsets, order, side="right") - 1
    at = order - c.offsets[context]
    if not len(order):
        return context, at
    # two contexts may show the same place of a text; that is no repeat
    begins = np.flatnonzero(np.diff(block, prepend=-1))
    place = c.first[context] + at
    other = np.zeros(len(order), bool)
    for value in (c.text[context], place):
        other |= value != np.repeat(value[begins], np.diff(np.append(begins, len(order))))
    repeats = np.logical_or.reduceat(other | c.copied[context], begins)
    chosen = np.repeat(repeats, np.diff(np.append(begins, len(order))))
    return context[chosen], at[chosen]


def _together(order: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the suffixes that stand alone; and the interval each of the others is in."""
    ends = np.append(split[1:], True)
    kept = ~(split & ends)
    return order[kept], np.cumsum(split)[kept]


def _found(length: int):
    """All anchors of the texts, with a hash of what is around each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in buffers.slices(batches, "text"):
            data, offsets = buffers.texts_of(batch.column("text"))
            places, hashes = anchors(data, offsets, length)
            row = buffers.rows_of(places, offsets)
            first, last = np.maximum(places - length // 2, offsets[row]), np.minimum(places + length, offsets[row + 1])
            around = np.zeros(0, np.uint64)
            if len(places):
                around = buffers.mix(buffers.span_hashes(data, first, last) + (places - first).astype(np.uint64))
            kept = [batch.column(x).take(pa.array(row)) for x in ("tk", "size")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(hashes.view(np.int64)), pa.array(around.view(np.int64)), pa.array(places - offsets[row])],
                names=["tk", "size", "h", "c", "at"],
            )

    return run


def _shipped(length: int):
    """The bytes around each anchor asked for; copies of a text follow each other and ship once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in buffers.slices(batches, "text"):
            out: list[tuple] = []
            for text, tk, size, asked in zip(*(batch.column(x) for x in ("text", "tk", "size", "asked")), strict=True):
                key = tk.as_py(), size.as_py()
                if key == before:
                    continue
                before, raw = key, text.as_buffer()
                for a in asked.as_py():
                    first = max(0, a["at"] - length // 2)
                    out.append((a["h"], *key, a["at"], first, a["n"] > 1, raw[first : a["at"] + length].to_pybytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["h", "tk", "size", "at", "first", "copied", "around"]
            )

    return run


def _halved(length: int):
    """Both halves of each row's range of distances, where a string of them lies within the text.

    A row stands for the strings of `length` bytes that begin low to high bytes before the anchor. All of
    them hold the core, from low bytes before the anchor on; whole is everything they cover together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at, low, high, first = (batch.column(x).to_numpy().astype(np.int64) for x in ("size", "at", "low", "high", "first"))
            around = batch.column("around").cast(pa.large_binary())
            data, offsets = buffers.bytes_of(around)
            middle = (low + high) // 2
            row = np.tile(np.arange(len(batch)), 2)
            low, high = np.concatenate([low, middle + 1]), np.concatenate([middle, high])
            size, at, first = size[row], at[row], first[row]
            some = (low <= high) & (np.maximum(low, at + length - size) <= np.minimum(high, at))
            row, low, high, size, at, first = (x[some] for x in (row, low, high, size, at, first))
            begin, stop = np.maximum(at - high, 0), np.minimum(at - low + length, size)
            base = offsets[:-1][row] - first
            core = whole = np.zeros(0, np.uint64)
            if len(row):
                node = buffers.mix((low << 32 | high).astype(np.uint64))
                core = buffers.mix(buffers.span_hashes(data, base + at - low, base + at - high + length) ^ node)
                whole = buffers.mix(buffers.span_hashes(data, base + begin, base + stop) ^ buffers.mix(node + (at - begin).astype(np.uint64)))
            lengths = stop - begin
            flat = data[buffers.ranges(base + begin, lengths)]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            taken = [batch.column(x).take(pa.array(row)) for x in ("weight", "tk", "size", "at")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), *taken, pa.array(low.astype(np.int32)),
                 pa.array(high.astype(np.int32)), pa.array(begin), kept.cast(pa.binary())],
                names=["core", "whole", *NODE],
            )

    return run


def _shipped_halved(length: int):
    """Both halves of all strings around each anchor asked for: _shipped and _halved in one Python process, not two."""

    def whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shipped(length)(batches):
            for begin in range(0, len(batch), HALVED_ROWS):
                part = batch.slice(begin, HALVED_ROWS)
                weight = np.where(part.column("copied").to_numpy(zero_copy_only=False), 2, 1).astype(np.int32)
                low, high = np.zeros(len(part), np.int32), np.full(len(part), length // 2, np.int32)
                columns = {x: part.column(x) for x in ("tk", "size", "at", "first", "around")}
                columns |= {"weight": pa.array(weight), "low": pa.array(low), "high": pa.array(high)}
                yield pa.RecordBatch.from_arrays([columns[x] for x in NODE], names=NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _halved(length)(whole_ranges(batches))

    return run


def _merged(length: int):
    """Runs of repeated strings of contexts without copies; the contexts of an anchor follow each other."""

    def decide(table: pa.Table) -> pa.RecordBatch:
        around = table.column("around").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(around.buffers()[1], np.int64)[around.offset : around.offset + len(around) + 1]
        data = np.frombuffer(around.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        tk, size, first, copied = (table.column(x).to_numpy() for x in ("tk", "size", "first", "copied"))
        _, text = np.unique(tk ^ buffers.mix(size.astype(np.uint64)).view(np.int64), return_inverse=True)
        context, at = merge(Contexts(data, offsets - offsets[0], text, first, copied), length)
        mine = ~copied[context]
        place = np.unique(context[mine] << 32 | first[context[mine]] + at[mine])
        begin = np.ones(len(place), bool)
        begin[1:] = place[1:] != place[:-1] + 1
        begins = np.flatnonzero(begin)
        ends = np.append(begins[1:], len(place)) - 1 if len(place) else begins
        of, low, high = place[begins] >> 32, place[begins] & 0xFFFFFFFF, place[ends] & 0xFFFFFFFF
        return pa.RecordBatch.from_arrays(
            [pa.array(tk[of]), pa.array(size[of]), pa.array(low), pa.array(high + length)], names=["tk", "size", "begin", "stop"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            if not len(batch):
                continue
            # cut after the last whole anchor once there is enough
            if weight >= MERGE_BYTES:
                keys = batch.column("h").to_numpy()
                last = held[-1].column("h")[-1].as_py()
                same = int(np.searchsorted(keys != last, True))
                if same < len(batch):
                    held.append(batch.slice(0, same))
                    yield decide(pa.Table.from_batches(held))
                    held, weight, batch = [], 0, batch.slice(same)
            held.append(batch)
            weight += batch.column("around").nbytes
        if held:
            yield decide(pa.Table.from_batches(held))
        held = []
        buffers.hand_back()

    return run


def _cleaned(text_column: str, runs_column: str, digest: bool):
    """Texts without the runs, and their figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in buffers.slices(batches, text_column):
            texts, out = batch.column(text_column), []
            for text, runs in zip(texts, batch.column(runs_column), strict=True):
                raw = (text.as_py() or "").encode()
                kept, end, removed, spans, start = [], 0, 0, 0, 0
                for r in sorted(runs.as_py() or (), key=lambda r: r["begin"]):
                    if r["begin"] > end or not spans:
                        kept.append(raw[end : r["begin"]])
                        removed += end - start
                        start, end, spans = r["begin"], r["stop"], spans + 1
                    else:
                        end = max(end, r["stop"])
                removed += end - start
                kept.append(raw[end:])
                left = b"".join(kept)
                out.append((len(raw), removed, spans, hashlib.sha256(left).hexdigest()) if digest else left.decode("utf-8", "ignore"))
            if digest:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                columns = [batch.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=["__id", *FIGURES])
                continue
            whole = pc.is_null(batch.column(runs_column)).to_pylist()
            new = pa.array([t.as_py() if w else n for t, w, n in zip(texts, whole, out, strict=True)], pa.string())
            names = [x for x in batch.schema.names if x != runs_column]
            yield pa.RecordBatch.from_arrays([new if x == text_column else batch.column(x) for x in names], names=names)

    return run


def _keyed(docs: DataFrame, text_column: str) -> DataFrame:
    """Rows with a key of their text: its hash and size. Equal texts have equal runs."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.withColumns({"tk": F.xxhash64(text), "size": F.octet_length(text).cast("bigint")})


def _refined(asked: DataFrame, length: int) -> list[DataFrame]:
    """Runs of repeated strings around anchors with very many contexts, by halving ranges of strings.

    A context stands for the strings around its anchor, a range of distances from it. Round by round ranges
    are halved: one whose bytes as a whole occur twice is settled, all its strings repeat; one whose core, the
    bytes that all its strings share, occurs once is dropped, none does; what is left is halved again, until a
    range is one string. A round only counts hashes, with map-side combination, and semi-joins the counts, so
    the contexts of an anchor never meet in a task, however many they are.
    """
    nodes, halve = asked, _shipped_halved(length)
    high, found, before = length // 2, [], []
    while high:
        high //= 2
        rows = stored(nodes.mapInArrow(halve, ROWS), "suffix-ranges")
        free(*before)
        kinds = rows.groupBy("core", "whole").agg(F.sum("weight").alias("n"), F.min(F.struct(*NODE[1:])).alias("one"))
        kinds = stored(kinds, "suffix-kinds")
        again = rows.filter("weight = 1").join(kinds.filter("n > 1").select("core", "whole"), ["core", "whole"], "left_semi")
        begin, stop = F.greatest(F.col("at") - F.col("high"), F.lit(0)), F.least(F.col("at") - F.col("low") + length, F.col("size"))
        found.append(stored(again.select("tk", "size", begin.alias("begin"), stop.alias("stop")), "suffix-runs"))
        open_ = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 AND least = 1")
        going = kinds.join(open_.select("core"), "core", "left_semi")
        nodes, halve = going.select(F.least(F.col("n"), F.lit(2)).cast("int").alias("weight"), "one.*"), _halved(length)
        before = [rows, kinds]
    free(*before)
    return found


def repeated_runs(docs: DataFrame, length: int, text_column: str) -> DataFrame:
    """Repeated byte ranges of each text: tk, size and runs, an array of (begin, stop).

    1. Anchors of all texts, with a hash of the bytes around each. Anchors that occur once are dropped.
    2. A context that occurs twice repeats whole: counted with map-side combination, so copies and
       passages that many documents share never meet in a task.
    3. The other contexts of an anchor that has several are shipped once and merged, if they are few.
    4. An anchor with more of them, at the edge of what very many documents share, is split: ranges of its
       strings are told apart by counts, halved round by round (see _refined).
    """
    keyed = _keyed(docs, text_column).select("tk", "size", F.col(text_column).alias("text"))
    read = keyed.filter(F.col("size") >= length)
    schema = "tk bigint, size bigint, h bigint, c bigint, at bigint"
    every = stored(read.mapInArrow(_found(length), schema), "suffix-anchors")
    twice = every.groupBy("h").count().filter("count > 1").select("h")
    some = stored(every.join(twice, "h", "left_semi"), "suffix-repeated")
    free(every)
    kinds = some.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tk", "size", "at")).alias("one"))
    kinds = stored(kinds, "suffix-contexts")
    open_ = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 AND least = 1")
    open_ = stored(open_, "suffix-open")

    def asking(anchors_: DataFrame, of: DataFrame) -> DataFrame:
        ask = of.join(anchors_.select("h"), "h", "left_semi").select("one.tk", "one.size", F.struct("one.at", "h", "n").alias("a"))
        ask = ask.groupBy("tk", "size").agg(F.collect_list("a").alias("asked"))  # as many as fit the text
        return read.join(ask, ["tk", "size"]).select("text", "tk", "size", "asked")

    ships = "h bigint, tk bigint, size bigint, at bigint, first bigint, copied boolean, around binary"
    shipped = asking(open_.filter(F.col("k") <= SPLIT_CONTEXTS), kinds).mapInArrow(_shipped(length), ships)
    dealt = shipped.repartition("h").sortWithinPartitions("h")
    open_runs = dealt.mapInArrow(_merged(length), "tk bigint, size bigint, begin bigint, stop bigint")
    whole = some.join(kinds.filter("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("tk", "size", "at").distinct()
    # the strings around an anchor begin half a length before it at most, and end a length after it
    begin, stop = F.greatest(F.col("at") - length // 2, F.lit(0)), F.least(F.col("at") + length, F.col("size"))
    whole = whole.select("tk", "size", begin.alias("begin"), stop.alias("stop"))
    found = open_runs.unionByName(whole)
    parts: list[DataFrame] = []
    many = open_.filter(F.col("k") > SPLIT_CONTEXTS)
    if not many.isEmpty():
        parts = _refined(asking(many, kinds), length)
        for part in parts:
            found = found.unionByName(part)
    runs = stored(found, "suffix-runs")
    free(some, kinds, open_, *parts)
    return runs.groupBy("tk", "size").agg(F.collect_set(F.struct("begin", "stop")).alias("runs"))


def _joined(docs: DataFrame, length: int, text_column: str) -> DataFrame:
    runs = repeated_runs(docs, length, text_column).select(
        F.col("tk").alias("__tk"), F.col("size").alias("__size"), F.col("runs").alias("__runs")
    )
    text = F.coalesce(F.col(text_column), F.lit(""))
    same = (F.xxhash64(text) == F.col("__tk")) & (F.octet_length(text).cast("bigint") == F.col("__size"))
    return docs.join(runs, same, "left").drop("__tk", "__size")


def removed(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Figures of each document without every byte covered by a string of `length` bytes that starts twice.

    `length` is a multiple of 10. Matches stay within a document; strings are judged on the input and
    overlaps count. Null text: empty; texts shorter than `length` stay whole. Null or repeated ids and
    repeated rows: each row is a document, so the long texts of repeated rows go. Other columns are ignored,
    whatever their names. Empty table: empty result. What remains of a text may not be UTF-8; the digest
    is of its bytes.
    """
    kind = docs.schema[id_column].dataType
    read = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    schema = f"__id {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    found = _joined(read, length, "__text").mapInArrow(_cleaned("__text", "__runs", True), schema)
    return found.withColumnRenamed("__id", id_column)


def clean(docs: DataFrame, length: int = 200, text_column: str = "text") -> DataFrame:
    """All rows and columns of `docs`, texts without repeated strings; parts of a cut character go too."""
    return _joined(docs, length, text_column).mapInArrow(_cleaned(text_column, "__runs", False), docs.schema)
