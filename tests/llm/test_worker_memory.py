"""Python processes of the suffix stage hold little at once, give it back, and aren't chained in a task."""

import subprocess
import sys
from pathlib import Path

import pytest

from panelwright.llm import suffixes

FIGURE = """
import re, sys
sys.path.insert(0, {repo!r})
import numpy as np, pyarrow as pa
from panelwright.llm import buffers, suffixes

def mb(field):
    return int(re.search(field + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

pa.array([b""])  # imports pandas
rng = np.random.default_rng(0)
{work}
"""

MERGED = """
def contexts():
    for k in range(30):  # 300 rows a batch, ten contexts an anchor
        h = k * 30 + np.arange(300) // 10
        around = [bytes(x) for x in rng.integers(97, 123, (300, 300), np.uint8)]
        columns = [h, k * 300 + np.arange(300), np.full(300, 300), np.full(300, 100), np.zeros(300, np.int64), np.zeros(300, bool)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(around)], names=["h", "tk", "size", "at", "first", "copied", "around"])

before, anon = mb("VmRSS"), mb("RssAnon")
for batch in suffixes._merged(200)(contexts()):
    pass
print(mb("VmHWM") - before, mb("RssAnon") - anon)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_memory_of_a_worker():
    code = FIGURE.format(repo=str(Path(__file__).parents[2]), work=MERGED)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120)
    peak, after = map(float, done.stdout.split())
    assert peak < 100 and after < 40, (peak, after)


def test_a_task_of_the_suffix_stage_has_one_python_process(spark, monkeypatch):
    """Anchors with many contexts: they were shipped and halved by two processes of a task."""
    plans, store = [], suffixes.stored

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(suffixes, "stored", seen)
    monkeypatch.setattr(suffixes, "SPLIT_CONTEXTS", 1)
    shared = "".join(f"{i * 7919 % 1009:04d}" for i in range(60))  # 240 bytes
    texts = [f"{chr(97 + i) * (40 + i)}{shared}{chr(110 + i) * (50 + i)}" for i in range(6)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in suffixes.removed(docs).collect()}
    assert [(r.n_removed, r.n_spans) for _, r in sorted(rows.items())] == [(240, 1)] * 6
    ranges = [p for p in plans if "MapInArrow" in p and "core" in p]
    assert ranges and all(p.count("MapInArrow") == 1 for p in ranges)
