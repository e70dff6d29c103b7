"""Token counts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelwright.llm import buffers, pretokens

NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Merger:
    """The merges of a byte-level BPE file: byte symbols, and pair -> (rank, merged symbol)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        vocabulary = model["vocab"]
        self.specials = {x["content"].encode(): x["id"] for x in content["added_tokens"]}
        self.bytes = np.array([vocabulary[x] for x in byte_letters()], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive in each sequence data[start:start + length]."""
        return self.merge(data, starts, lengths)[0]

    def ids(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols of all sequences, one after another, and how many each has."""
        counts, parts = self.merge(data, starts, lengths, True)
        begins = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        for sequences, symbols in parts:
            flat[buffers.ranges(begins[sequences], counts[sequences])] = symbols
        return flat, counts

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kept: bool = False) -> tuple[np.ndarray, list]:
        """How many symbols survive in each sequence; if asked for, also (sequences, their symbols) as they end."""
        counts = lengths.astype(np.int64).copy()
        parts = []
        if kept:
            single = np.flatnonzero(lengths == 1)
            parts.append((single, self.bytes[data[starts[single]]]))
        live = np.flatnonzero(lengths > 1)
        symbols = self.bytes[data[buffers.ranges(starts[live], lengths[live])]]
        sizes = counts[live]
        while len(live):
            ends = np.cumsum(sizes)
            begins = ends - sizes
            pair = np.full(len(symbols), -1, np.int64)
            pair[:-1] = symbols[:-1] << 20 | symbols[1:]
            pair[ends - 1] = -1  # the last symbol of a sequence has no partner
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = self.keys[at] == pair
            rank = np.where(known, self.ranks[at], NONE)
            lowest = np.minimum.reduceat(rank, begins)
            chosen = known & (rank == np.repeat(lowest, sizes))
            # of overlapping places of one pair, every second one merges, from the left
            place = np.flatnonzero(chosen)
            fresh = np.ones(len(place), bool)
            fresh[1:] = place[1:] != place[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            symbols[place] = self.merged[at[place]]
            stay = np.ones(len(symbols), bool)
            stay[place + 1] = False
            sizes = np.add.reduceat(stay, begins, dtype=np.int64)
            counts[live] = sizes
            going = (lowest != NONE) & (sizes > 1)
            if kept and not going.all():
                parts.append((live[~going], symbols[stay & np.repeat(~going, ends - begins)]))
            stay &= np.repeat(going, ends - begins)
            symbols, live, sizes = symbols[stay], live[going], sizes[going]
        return counts, parts


def _counter(path: str, id_column: str, text_column: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, memo = Merger(path), pretokens.Memo()
        for batch in buffers.slices(batches, text_column):
            data, offsets = buffers.texts_of(batch.column(text_column))
            tokens = np.zeros(len(batch), np.int64)
            places = {x: pretokens.specials_of(data, offsets, x) for x in merger.specials}
            points, at = pretokens.points_of(data, offsets)
            parts, special = at[:-1][at[:-1] < at[1:]], np.zeros(0, np.int64)
            if any(map(len, places.values())):
                edges, special = _special_edges(data, places)
                parts = np.unique(np.concatenate([parts, edges[edges < len(points)]]))
            starts = pretokens.token_starts(points, parts)
            if len(starts):
                inside = np.isin(starts, special) if len(special) else np.zeros(len(starts), bool)
                if len(special):
                    starts, inside = _whole_specials(starts, special, places)
                ends = np.append(starts[1:], len(points))
                hashes = buffers.span_hashes(points, starts, ends)
                to_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))

                def fresh(new: np.ndarray, starts=starts, ends=ends, data=data, to_byte=to_byte) -> np.ndarray:
                    return merger.count(data, to_byte[starts[new]], to_byte[ends[new]] - to_byte[starts[new]])

                values = memo.get(hashes, fresh)
                values = np.where(inside, 1, values)
                tokens = np.bincount(buffers.rows_of(starts, at), values, len(batch)).astype(np.int64)
            lengths = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), pa.array(lengths), pa.array(tokens), pa.array(tokens > limit)],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def _special_edges(data: np.ndarray, places: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where special strings begin and end, counted in code points, and where they begin."""
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    begins = np.concatenate([leads[x] for x in places.values()])
    ends = np.concatenate([leads[x + len(k)] for k, x in places.items()])
    return np.unique(np.concatenate([begins, ends])), np.sort(begins)


def _whole_specials(starts: np.ndarray, special: np.ndarray, places: dict[bytes, np.ndarray]):
    """Drop the starts inside special strings; which of the rest is one."""
    length = max(len(x.decode()) for x in places)
    near = np.searchsorted(special, starts, side="right") - 1
    within = (near >= 0) & (starts > special[np.maximum(near, 0)]) & (starts < special[np.maximum(near, 0)] + length)
    starts = starts[~within]
    return starts, np.isin(starts, special)


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Bytes and tokens of each whole text, and whether it has more than `limit` tokens.

    path: a byte-level BPE file that every executor can read. Texts are cut into pre-tokens as arrays;
    each new pre-token's bytes become a row of a ragged array, and in every round each row applies its
    lowest-ranked pair at all its places at once, until none is left. A null or empty text has no
    tokens; the strings of special tokens count as one token each; null and repeated ids and repeated
    rows are kept as they are; all other columns are ignored, whatever their names. Empty table: empty.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select(id_column, text_column).mapInArrow(_counter(path, id_column, text_column, limit), schema)
