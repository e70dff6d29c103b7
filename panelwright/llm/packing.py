"""Best-fit packing by bin completion over the counts of equal lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import buffers, pretokens, ranks
from panelwright.llm.token_counts import Merger, _special_edges, _whole_specials
from panelwright.llm.stored import stored

END_ID = 2
NUMBERS = ["piece", "start", "length", "ids_crc32"]
STORE = 4_000_000  # ids kept of pre-tokens seen by a task before its memory starts anew
NODES = 2_000  # search steps of bin completion after which the best packing found stands


@dataclass(frozen=True)
class Run:
    """So many bins that all hold the same lengths."""

    bins: int
    lengths: tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing on counts of lengths: each bin takes the longest that still fits."""
    left = dict(sorted(counts.items(), reverse=True))
    runs: list[Run] = []
    while left:
        filling, room = [], capacity
        for length, n in left.items():
            take = min(n, room // length)
            filling += [length] * take
            room -= take * length
            if not room:
                break
        runs.append(_apply(left, tuple(filling)))
    return runs


def _apply(left: dict[int, int], filling: tuple[int, ...], most: int | None = None) -> Run:
    """Fill as many bins as the counts allow, `most` at most, and take their pieces away."""
    need = {x: filling.count(x) for x in set(filling)}
    bins = min(left[x] // n for x, n in need.items())
    bins = bins if most is None else min(bins, most)
    for x, n in need.items():
        left[x] -= bins * n
        if not left[x]:
            del left[x]
    return Run(bins, filling)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A bound below: by the total, and by pieces over half with what can't stand beside them."""
    total = sum(x * n for x, n in counts.items())
    best = -(-total // capacity)
    for edge in [x for x in counts if 2 * x <= capacity] + [0]:
        large = sum(n for x, n in counts.items() if x > capacity - edge)
        middle = [(x, n) for x, n in counts.items() if 2 * x > capacity and x <= capacity - edge]
        small = sum(x * n for x, n in counts.items() if edge <= x and 2 * x <= capacity)
        beside = sum((capacity - x) * n for x, n in middle)
        best = max(best, large + sum(n for _, n in middle) + max(0, -(-(small - beside) // capacity)))
    return best


def _reachable(lengths: list[int], left: dict[int, int], capacity: int) -> list[int]:
    """For each place in `lengths` (descending) the sums that pieces from there on can make, as bits of a number."""
    mask = (1 << (capacity + 1)) - 1
    out = [1] * (len(lengths) + 1)
    for k in range(len(lengths) - 1, -1, -1):
        x, sums = lengths[k], out[k + 1]
        n = min(left[x], capacity // x)
        step = 1
        while n:  # so many copies, by powers of two
            step = min(step, n)
            sums |= (sums << (x * step)) & mask
            n -= step
            step *= 2
        out[k] = sums
    return out


def fillings(left: dict[int, int], capacity: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings around the largest length, least waste first, longer pieces first.

    A filling is dominated if another one that fits is at least as long piece for piece: so none
    leaves room for a piece that is left, and none can swap a piece for the next longer one. What sums the
    pieces can make is worked out once, so the walk for a given waste never runs into a dead end.
    """
    lengths = sorted(left, reverse=True)
    largest = lengths[0]
    rest = {**left, largest: left[largest] - 1}
    reach = _reachable(lengths, rest, capacity - largest)

    def exact(at: int, room: int) -> Iterator[tuple[int, ...]]:
        """Fillings of exactly `room` with pieces from place `at` on."""
        if not room:
            yield ()
            return
        for k in range(at, len(lengths)):
            x = lengths[k]
            for n in range(min(rest[x], room // x), 0, -1):
                if reach[k + 1] >> (room - n * x) & 1:
                    for more in exact(k + 1, room - n * x):
                        yield (x,) * n + more

    room = capacity - largest
    for waste in range(room + 1):
        if reach[0] >> (room - waste) & 1:
            for filling in exact(0, room - waste):
                used = {x: filling.count(x) for x in set(filling)}
                used[largest] = used.get(largest, 0) + 1
                if _undominated([largest, *filling], waste, lengths, left, used):
                    yield (largest, *filling)


def _undominated(chosen: list[int], room: int, lengths: list[int], left: dict[int, int], used: dict[int, int]) -> bool:
    if not room:
        return True
    if any(x <= room and used.get(x, 0) < left[x] for x in lengths):
        return False
    for x in set(chosen[1:]):
        if any(x < y <= x + room and used.get(y, 0) < left[y] for y in lengths):
            return False
    return True


def least_waste(counts: dict[int, int], capacity: int) -> list[Run]:
    """Each bin, around the longest piece left, gets the first of its least wasteful fillings."""
    left = dict(counts)
    runs: list[Run] = []
    while left:
        runs.append(_apply(left, next(fillings(left, capacity))))
    return runs


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Run]:
    """Bin completion: depth-first over fillings around the largest length left, least waste first.

    The best-fit packing and the one of least waste per bin are the first incumbents. A branch ends when its
    waste so far means that it can't use fewer bins than the incumbent; a filling is tried for as many bins as
    the counts allow and for one. The search ends at the lower bound or after `nodes` steps, and the incumbent,
    always a whole packing, stands. Its work depends on the number of different lengths, not on the number of
    pieces.
    """
    least, total = least_bins(counts, capacity), sum(x * n for x, n in counts.items())
    best = best_fit(counts, capacity)
    best_bins = sum(r.bins for r in best)
    if best_bins > least:
        tried = least_waste(counts, capacity)
        if (bins := sum(r.bins for r in tried)) < best_bins:
            best, best_bins = tried, bins
    stack = [iter([([], 0, dict(counts))])] if best_bins > least else []
    steps = 0
    while stack and best_bins > least and steps < nodes:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        steps += 1
        runs, waste, left = node
        if not left:
            if (bins := sum(r.bins for r in runs)) < best_bins:
                best, best_bins = runs, bins
            continue
        if waste > (best_bins - 1) * capacity - total:
            continue

        def children(runs=runs, waste=waste, left=left):
            for filling in fillings(left, capacity):
                for most in (None, 1):
                    rest = dict(left)
                    run = _apply(rest, filling, most)
                    if most is None or run.bins < again:
                        yield [*runs, run], waste + run.bins * (capacity - sum(filling)), rest
                    again = run.bins

        stack.append(children())
    return best


def slots(runs: list[Run]) -> dict[str, np.ndarray]:
    """For each length and run: the first of its ranks, how many a bin holds, the first bin, the offset."""
    rows, taken, first = [], {}, 0
    for run in runs:
        at = 0
        for length in sorted(set(run.lengths), reverse=True):
            each = run.lengths.count(length)
            begin = taken.get(length, 0)
            rows.append((length, begin, each, first, at))
            taken[length] = begin + each * run.bins
            at += each * length
        first += run.bins
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "begin", "each", "bin", "offset"), table.T, strict=True))


class _Ids:
    """Ids of pre-tokens by rank-synchronous merging, each worked out once while it is remembered."""

    def __init__(self, path: str) -> None:
        self.merger = Merger(path)
        self.clear()

    def clear(self) -> None:
        self.memo, self.ids, self.used, self.known = pretokens.Memo(), np.zeros(1 << 16, np.uint32), 0, 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(sizes) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        new = np.arange(self.known, self.known + len(sizes))
        self.at[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.known = self.used + len(flat), self.known + len(sizes)
        return new

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin."""
        if self.used > STORE:
            self.clear()
        specials = self.merger.specials
        places = {x: pretokens.specials_of(data, offsets, x) for x in specials}
        points, at = pretokens.points_of(data, offsets)
        parts, special = at[:-1][at[:-1] < at[1:]], np.zeros(0, np.int64)
        if any(map(len, places.values())):
            edges, special = _special_edges(data, places)
            parts = np.unique(np.concatenate([parts, edges[edges < len(points)]]))
        starts = pretokens.token_starts(points, parts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        inside = np.zeros(len(starts), bool)
        if len(special):
            starts, inside = _whole_specials(starts, special, places)
        ends = np.append(starts[1:], len(points))
        to_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))

        def fresh(new: np.ndarray) -> np.ndarray:
            first, last = to_byte[starts[new]], to_byte[ends[new]]
            whole = inside[new]  # special strings aren't merged, they have an id
            flat, sizes = self.merger.ids(data, first, np.where(whole, 0, last - first))
            if whole.any():
                one = [specials[data[a:b].tobytes()] for a, b in zip(first[whole], last[whole], strict=True)]
                before = (np.cumsum(sizes) - sizes)[whole]
                flat, sizes = np.insert(flat, before, one).astype(np.uint32), np.where(whole, 1, sizes)
            return self.add(flat, sizes)

        which = self.memo.get(buffers.span_hashes(points, starts, ends), fresh)
        sizes = self.size[which]
        ids = self.ids[buffers.ranges(self.at[which], sizes)]
        counts = np.bincount(buffers.rows_of(starts, at), sizes, len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])


_READ: dict[str, _Ids] = {}


def _ids_of(path: str) -> _Ids:
    """One reader of ids for all tasks of a worker: the file is parsed once, and what is known stays known."""
    if path not in _READ:
        _READ[path] = _Ids(path)
    return _READ[path]


def _pieces(path: str, id_column: str, text_column: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids_of(path)
        for batch in buffers.slices(batches, text_column):
            ids, at = ids_of.encode(*buffers.texts_of(batch.column(text_column)))
            total = np.diff(at) + 1  # with the end id
            number = -(-total // capacity)
            row = np.repeat(np.arange(len(batch)), number)
            piece = buffers.ranges(np.zeros(len(batch), np.int64), number)
            head = total - (number - 1) * capacity  # the first piece may be shorter
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            crcs = np.empty(len(row), np.int64)
            last = np.uint32(END_ID).tobytes()
            for k, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                end = s + n == total[r]
                crc = zlib.crc32(ids[at[r] + s : at[r] + s + n - end].tobytes())
                crcs[k] = zlib.crc32(last, crc) if end else crc
            columns = [batch.column(id_column).take(pa.array(row)), piece, start, length, crcs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=[id_column, *NUMBERS]
            )

    return run


def _placed(table: dict[str, np.ndarray], capacity: int):
    """Sequence and offset of the rank-th piece of a length. table: at most a row per length and run."""
    key = table["length"] << 44 | table["begin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "__rank"))
            row = np.searchsorted(key, length.astype(np.int64) << 44 | rank - 1, side="right") - 1
            nth = rank - 1 - table["begin"][row]
            sequence = table["bin"][row] + nth // table["each"][row]
            offset = table["offset"][row] + nth % table["each"][row] * length
            kept = [batch.column(x) for x in batch.schema.names if not x.startswith("__")]
            names = [x for x in batch.schema.names if not x.startswith("__")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, path: str, capacity: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Pack all texts, as ids with an end id, into as few sequences of `capacity` ids as found.

    Only texts longer than a sequence are cut, into full pieces; the first may be shorter. Pieces of one
    length are alike, so the search works on the counts of lengths, at most `capacity` rows whatever
    the input's size; each run of equal bins uses up one length, so the plan is as small. Pieces
    then find their place by their rank within their length, which is counted in parts (see ranks).
    Null text: empty, a piece with only the end id. Null or repeated ids and repeated rows: each row is
    packed by itself. Other columns are ignored, whatever their names. Empty table: empty result.
    """
    kind = docs.schema[id_column].dataType
    schema = f"`{id_column}` {kind.simpleString()}, " + ", ".join(f"{x} bigint" for x in NUMBERS)
    pieces = docs.select(id_column, text_column).mapInArrow(_pieces(path, id_column, text_column, capacity), schema)
    pieces = stored(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = slots(complete_bins(counts, capacity))
    parts = max(1, sum(counts.values()) // 20_000)
    dealt = pieces.withColumn("__key", F.xxhash64(id_column, "piece", "ids_crc32"))
    dealt = dealt.withColumn("__bucket", F.pmod("__key", F.lit(parts))).withColumn("__one", F.lit(1).cast("bigint"))
    ranked = ranks.running_sum(dealt, ["length"], ["__key", id_column, "piece", "ids_crc32"], "__bucket", "__one", "__rank")
    return ranked.select(id_column, *NUMBERS, "__rank").mapInArrow(
        _placed(table, capacity), f"{schema}, sequence_id bigint, offset bigint"
    )
