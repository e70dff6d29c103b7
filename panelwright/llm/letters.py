"""Runs of letters in flat text arrays, lower-cased."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelwright.llm import buffers, pretokens


@dataclass
class Words:
    """Runs of letters: their places in `points`, the row each belongs to and a hash of each."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray


def words_of(column: pa.Array) -> Words:
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    points, at = pretokens.points_of(*buffers.texts_of(lower))
    letter = np.zeros(len(points) + 2, bool)
    letter[1:-1] = pretokens.classes()[points] == pretokens.LETTER
    begins = letter[1:-1] & ~letter[:-2]
    ends = letter[1:-1] & ~letter[2:]
    filled = at[:-1] < at[1:]
    firsts, lasts = at[:-1][filled], at[1:][filled] - 1
    begins[firsts], ends[lasts] = letter[1:-1][firsts], letter[1:-1][lasts]  # words never cross texts
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = buffers.span_hashes(points, starts, stops) if len(starts) else np.zeros(0, np.uint64)
    return Words(points, starts, stops, buffers.rows_of(starts, at), hashes)
