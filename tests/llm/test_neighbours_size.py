"""How much of a search meets in one place."""

import numpy as np
import pytest

from panelwright.llm import neighbours


def exact(x, k, every):
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    return {q: np.lexsort((np.arange(len(x)), -score[q]))[:k].tolist() for q in range(0, len(x), every)}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_small_parts_give_the_same_neighbours(spark, monkeypatch, kind):
    x = np.random.default_rng(5).normal(size=(600, 8)).round(3).astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    for name, value in {"LIST_ROWS": 40, "LEAST_ROWS": 600, "ROW_BYTES": 9 * 8 * 100, "QUERY_BYTES": 9 * 8 * 20, "SLICE": 7, "KEPT": 50}.items():
        monkeypatch.setattr(neighbours, name, value)
    got = {}
    for r in neighbours.search(frame, k=5, every=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(x, 5, 10)


def test_parts_hold_equally_many_rows_of_known_lists():
    parts = neighbours.Parts(np.array([10, 0, 55, 5, 0, 30]), 20)
    assert parts.number == 5
    rows = np.zeros(5, int)
    for one, size in enumerate(parts.sizes.tolist()):
        for p in parts.of(np.full(size, one), np.arange(size) * (1 << 20) // max(size, 1)):
            rows[p] += 1
            mine = parts.lists(int(p))
            assert mine.start <= one < mine.stop
    assert abs(rows - 20).max() <= 1
