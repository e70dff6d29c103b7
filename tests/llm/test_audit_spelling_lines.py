"""Filter audit, spelling variants and line dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from panelwright.llm import audit, lines, spelling

DOCS = "doc_id long, text string, lang string, doc string, tk string, word string, n string, part string, keep string, h string, same string, mask string"


def docs_of(spark, rows):
    """(id, text, lang) with more columns whose names clash with inner and result names."""
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], DOCS)


# --- line dedup --------------------------------------------------------------


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def lines_by_hand(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(i)
    out = Counter()
    for i, text, *_ in rows:
        every = (text or "").split("\n")
        kept = []
        for line in every:
            who = holders.get(key_of(line), set())
            largest = max((x for x in who if x is not None), default=None)
            if len(who) < min_docs or i == largest:
                kept.append(line)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[(i, len(every), len(every) - len(kept), digest)] += 1
    return out


def lines_found(spark, rows, **kw):
    return Counter(tuple(r) for r in lines.removed(docs_of(spark, rows), **kw).collect())


def test_lines_edges(spark):
    a, b = "A common line of forty code points, or more of them", "zweite Zeile mit Umläuten äöüß und noch mehr Zeichen"
    rows = [(k, f"{a}\n only {k}\n  {a.upper() if k % 3 else a}\t\r\n{b if k > 4 else ''}", "en") for k in range(9)]
    rows += [(8, f"{a}\nanother text of the largest id", "en"), (None, a, None), (None, f"x\n{a}", None), (3, None, "en"), (4, "", "en")]
    rows += [(5, rows[5][1], "en")] * 3  # repeated rows
    rows += [(20, "\n\n", "en"), (21, "y" * 300_000 + "\n" + a, "en"), (22, "ä" * 39, "en")] + [(30 + k, "ä" * 40, "en") for k in range(5)]
    assert lines_found(spark, rows) == lines_by_hand(rows)


def test_a_line_in_all_documents_crosses_many_ranges(spark):
    hot, rare = "hot " * 12, "found in four documents only, so it stays everywhere"
    rows = [(k, "\n".join([hot, f"own line of document number {k} is long enough to count", hot] + [rare] * (k < 4)), "en") for k in range(3000)]
    found = lines_found(spark, rows)
    assert found == lines_by_hand(rows)
    assert sum(r[2] for r in found) == 2 * 2999


@pytest.mark.parametrize("seed", range(3))
def test_lines_random(spark, seed):
    rng = random.Random(seed)
    some = ["".join(rng.choice("ab Ä\t") for _ in range(rng.randint(1, 9))) for _ in range(12)]
    rows = [(rng.choice([None, *range(25)]), "\n".join(rng.choice(some) for _ in range(rng.randint(0, 8))) if rng.random() < 0.9 else None, "en")
            for _ in range(60)]
    assert lines_found(spark, rows, min_chars=3, min_docs=rng.randint(2, 6)) is not None
    for min_docs in (1, 2, 5):
        assert lines_found(spark, rows, min_chars=3, min_docs=min_docs) == lines_by_hand(rows, 3, min_docs)


def test_runs_are_streamed_alike_however_batches_are_cut():
    pa = pytest.importorskip("pyarrow")
    rng = random.Random(5)
    rows = sorted((rng.randint(0, 6), 0, -rng.randint(0, 30), 1, k) for k in range(300))
    columns = [pa.array([s * r[k] for r in rows], t) for k, (s, t) in enumerate([(1, pa.int64()), (1, pa.int64()), (-1, pa.int64()), (1, pa.int64()), (1, pa.int32())])]
    whole = pa.RecordBatch.from_arrays(columns, names=["h", "g", "doc", "tk", "line"])
    results = set()
    for step in (1, 2, 7, 50, 300):
        out = list(lines._streamed(5)(whole.slice(a, step) for a in range(0, 300, step)))
        results.add(tuple(sorted((tuple(r.values()) for b in out for r in b.to_pylist()), key=str)))
    assert len(results) == 1


def test_bitmaps_and_clean(spark):
    rows = [(k, f"{'shared line ' * 5}\nown {k}", "en") for k in range(6)] + [(9, None, "en"), (10, "one", None)]
    maps = {r.doc: lines.kept_lines(r.keep, r.n_lines).tolist() for r in lines.bitmaps(docs_of(spark, rows)).collect()}
    assert maps == {**{k: [k == 5, True] for k in range(6)}, 9: [True], 10: [True]}
    docs = docs_of(spark, rows)
    kept = lines.clean(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id: r.text for r in kept.collect()} == {**{k: f"own {k}" for k in range(5)}, 5: rows[5][1], 9: None, 10: "one"}


def test_no_lines(spark):
    assert lines.removed(docs_of(spark, [])).count() == 0


# --- filter audit ------------------------------------------------------------


def audit_by_hand(rows, marks):
    masks = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)}
        fails["D"] = bool(re.search("[#$%&*|]", t))
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        good = any(j == i and q == 1 for j, q, _ in marks if i is not None)
        bad = any(j == i and x == 1 for j, _, x in marks if i is not None)
        masks.append((lang or "", {f for f, v in fails.items() if v}, good, bad))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [m for m in mine if f in m[1] and not m[1] & set(order[:k])]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not m[1] & set(order[: k + 1]) for m in mine), len(gone),
                    sum(f in m[1] for m in mine) - len(gone), sum(m[1] == {f} for m in mine),
                    sum(m[2] for m in gone), sum(m[3] for m in gone),
                ]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return out


def audit_found(spark, rows, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, part int, n int") if marks else spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return {(r[0], r[1], r[2]): list(r[3:]) for r in audit.audit(docs_of(spark, rows), labels).collect()}


def test_audit(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "#", "ABC", "Ä" * 10, "word " * 300, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(200)),
             " ".join(f"W{k} X" for k in range(120)), "a|b " * 250, "x" * 200_000, " ".join(f"w{k % 100}" for k in range(200))]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(120)]
    rows += rows[:5]
    marks = [(rng.choice([None, *range(45)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), 1, 1) for _ in range(50)]
    assert audit_found(spark, rows, marks) == audit_by_hand(rows, [m[:3] for m in marks])
    assert audit_found(spark, rows, []) == audit_by_hand(rows, [])


def test_audit_of_nothing(spark):
    assert audit_found(spark, [], []) == {}


def test_lattice_counts_orders():
    edges, steps = audit.lattice(5)
    assert len(edges) == 80 and len(steps) == 600
    taken = Counter(e for _, _, e in steps)
    assert [taken[k] for k in range(80)] == [orders for _, _, orders in edges]


# --- spelling variants -------------------------------------------------------


def counted_by_hand(rows, min_points=6, thinned=199):
    out = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % thinned == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_points:
                out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants_by_hand(counts, min_points, min_count, ratio):
    words = {w: n for w, n in counts.items() if len(w) >= min_points and n >= min_count}
    around = {w: [x for x in words if x != w and near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), words.get(form[w])))
    return out


def test_counted_words(spark):
    rng = random.Random(2)
    pieces = ["Straße", "ÀÖÜ×÷ÿ", "plainword", "MixedCase", "short", "aé" * 20, "x" * 64, "y" * 65, "z" * 5000, "日本", "don't", "1234", "ñandúes"]
    rows = [(rng.choice([None, *range(10_000)]), " ".join(rng.choice(pieces) + rng.choice("abc") * rng.randint(0, 3) for _ in range(60)), "en") for _ in range(300)]
    rows += [(1, None, None), (2, "", None), (3, "!!", None)] + rows[:3]
    for thinned in (199, 7):
        got = {r.word: r.n for r in spelling.counted(docs_of(spark, rows), thinned=thinned).collect()}
        assert got == counted_by_hand(rows, 6, thinned)


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefg"])
def test_variants_random(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(250)}
    counts = {w: rng.choice([1, 2, 3, 5, 10, 30, 30, 200, 2000]) for w in words}
    given = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, root int")
    got = spelling.variants(given, min_points=2, min_count=2, ratio=5)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == variants_by_hand(counts, 2, 2, 5)
    pairs = spelling.near_words(given).collect()
    assert len(pairs) == len({(r.word, r.near) for r in pairs})


def test_long_chain_of_forms(spark):
    counts = {"aaaaaa" + "b" * k: 5 * 5**k for k in range(12)}
    given = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.variants(given)
    assert {r.root for r in got.collect()} == {"aaaaaa" + "b" * 11}


def test_no_words(spark):
    assert spelling.variants(spelling.counted(docs_of(spark, []))).count() == 0
    assert spelling.variants(spark.createDataFrame([(None, 9), ("abcdefg", None)], "word string, n long")).count() == 0


def test_checksums_of_long_and_short_words():
    words = [b"a", b"abcdef", b"x" * 64, b"y" * 65, b"z" * 900]
    prefixes = np.array([zlib.crc32(p) for p in (b":", b"123:", b"99999999:")], np.uint32)
    rows, number = np.repeat(np.arange(3), 5), np.tile(np.arange(5), 3)
    sizes = np.array([len(words[k]) for k in number])
    want = [zlib.crc32(words[k], int(prefixes[r])) for r, k in zip(rows, number, strict=True)]
    assert spelling._checksums(prefixes, rows, sizes, number, words).tolist() == want
