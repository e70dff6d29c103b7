"""Every stage of the pipeline, and the whole of it, on null, empty, long and repeated rows, against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from panelwright.llm import mixing, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n string, core string, __own string, piece string"
LABELS = "doc_id long, quality int, toxic int, size int"


def corpus(seed=0):
    """Clean and toxic texts, near and exact copies, shared passages, hard rows."""
    rng = random.Random(seed)
    clean = [f"word{k}" for k in range(300)]
    bad = ["vilestuff", "nastything", "rotten"]
    passage = " ".join(rng.choice(clean) for _ in range(60))
    rows, labels = [], []

    def add(i, text, source="a", label=None):
        rows.append((i, text, "en", source, None if text is None else len(text), 1, "n", "c", "o", "p"))
        if label is not None:
            labels.append((i, 1, label, 0))

    for i in range(140):
        words = [rng.choice(clean) for _ in range(rng.randint(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(12):
                words[rng.randrange(len(words))] = rng.choice(bad)
        add(i, " ".join(words), rng.choice(["a", "b", None]), int(toxic))
    for k in range(12):
        add(200 + k, " ".join(rng.choice(clean) for _ in range(40)) + " " + passage + f" end{k}", "b", 0)
    near = rows[1][1].split()
    near[3] = "changed"
    add(300, " ".join(near), "b")
    add(301, rows[1][1], "a")
    for i, text in ((400, None), (401, ""), (402, " \n\t"), (403, "x" * 150_000), (404, "short"), (None, "null id text here"), (404, "same id again")):
        add(i, text, None)
    rows += [rows[5], rows[5], rows[152]]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipe")
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{base}/labels.parquet")
    return str(base)


def read(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(len(words) - size + 1, 1)))


def test_toxicity_stage(spark, tables):
    docs = read(spark, tables)
    kept = counted(queries.drop_toxic(spark, docs, tables))
    scores = toxicity.with_score(docs, toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet")))
    want = Counter(tuple(r)[:-1] for r in scores.collect() if r[-1] < 0.5)
    assert kept == want
    texts = [r[1] or "" for r in kept.elements()]
    assert not any("vilestuff" in t for t in texts) and sum("nastything" in t or "rotten" in t for t in texts) <= 1
    assert len(texts) > 110 and sum(kept[r] for r in kept if r[0] in (400, 401, 402, 404)) == 5


def test_near_copies_stage(spark, tables):
    docs = read(spark, tables)
    rows = list(dict.fromkeys(tuple(r) for r in docs.collect()))  # of repeated rows one may stay
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0, str(r[1]))) for g in groups.values())
    got = counted(queries.drop_near_copies(spark, docs, tables))
    assert got == want


def test_repeated_strings_stage(spark, tables):
    docs = read(spark, tables)
    rows = [tuple(r) for r in docs.collect()]
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + 200] for b in raws for i in range(len(b) - 199))
    want = Counter()
    for r, b in zip(rows, raws, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        text = None if r[1] is None else bytes(c for c, g in zip(b, gone, strict=True) if not g).decode()
        want[(r[0], text, *r[2:4], None if text is None else len(text), *r[5:])] += 1
    assert counted(queries.drop_repeated_strings(spark, docs, tables)) == want


def test_mixing_stage(spark, tables):
    docs = read(spark, tables)
    taken = counted(queries.mix_sources(spark, docs, tables))
    every = counted(docs)
    assert set(taken) <= set(every) and all(n <= 3 * every[r] for r, n in taken.items())
    words = defaultdict(int)
    for r, n in taken.items():
        words[r[0]] += n * len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in want.items() if v}


def test_packing_stage(spark, tables):
    docs = read(spark, tables)
    rows = queries.pack_sequences(spark, docs, tables).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(filled) >= -(-total // 1024)


def test_whole_pipeline(spark, tables):
    """The stages one by one give what run() gives."""
    docs = read(spark, tables)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, tables)
        assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    want = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect())
    got = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, tables).collect())
    assert got == want and sum(got.values()) > 100


def test_empty_tables_through_the_pipeline(spark, tables, tmp_path):
    read(spark, tables).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
