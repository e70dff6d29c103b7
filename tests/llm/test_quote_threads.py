"""Reply order of conversations against a plain thread builder."""

import random

import pytest

from panelwright.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, position int, branch int, conv int, rows int"


def threads_of(spark, rows):
    frame = spark.createDataFrame([(*r, 5, 6, 7, 8) for r in rows], SCHEMA)
    return quotes.thread(frame).collect()


def by_hand(parents):
    """Parents by turn (None for the first) to {turn: (branch, position)}."""
    children, branch = {}, {}
    turns = sorted(parents)
    for before, turn in zip([None, *turns], turns, strict=False):
        children.setdefault(parents[turn], []).append(turn)
        branch[turn] = branch[before] if before is not None and parents[turn] == before else turn
    order, stack = [], [min(turns)]
    while stack:
        turn = stack.pop()
        order.append(turn)
        stack += reversed(children.get(turn, []))
    return {t: (branch[t], k) for k, t in enumerate(order)}


def test_answers_come_before_the_next_topic(spark):
    rows = [(1, t, "r", f"{q}own line {t}") for t, q in enumerate(["", "> own line 0\n", "> own line 0\n", "> own line 1\n", "> own line 2\n"])]
    got = sorted((r.position, r.turn) for r in threads_of(spark, rows))
    assert [t for _, t in got] == [0, 1, 3, 2, 4]


@pytest.mark.parametrize("seed", range(4))
def test_random_quote_trees(spark, seed, monkeypatch):
    monkeypatch.setattr(quotes, "SPAN", [1024, 3, 5, 2][seed])
    rng = random.Random(seed)
    rows, want = [], {}
    for conv in [None, *range(1, 9)]:
        parents, turn, known = {}, rng.randint(0, 3), []
        for _ in range(rng.choice([1, 2, 5, 12, 40])):
            quoted = rng.choice(known) if known and rng.random() < 0.5 else None
            depth = rng.randint(1, 3)
            text = f"{'> ' * depth}Talk {conv}, of {quoted}!\nown" if quoted is not None else "own"
            rows.append((conv, turn, "r", f"{text} \ntalk {conv} of {turn}\n"))
            parents[turn] = quoted if quoted is not None else (known[-1] if known else None)
            known.append(turn)
            turn += rng.randint(1, 4)
        for t, (branch, place) in by_hand(parents).items():
            want[conv, t] = (parents[t], branch, place)
    rng.shuffle(rows)
    got = {(r.conv_id, r.turn): (r.reply_to, r.branch, r.position) for r in threads_of(spark, rows)}
    assert got == want


def test_long_chains_and_stars(spark):
    star = [(1, t, "r", f"> root line\nanswer {t}" if t else "root line") for t in range(200)]
    chain = [(2, t, "r", f"> link {t - 2}\nlink {t}" if t > 1 else f"link {t}") for t in range(120)]
    got = threads_of(spark, star + chain)
    assert [r.turn for r in sorted(got, key=lambda r: (r.conv_id, r.position)) if r.conv_id == 1] == list(range(200))
    parents = {t: t - 2 if t > 1 else (0 if t else None) for t in range(120)}
    want = by_hand(parents)
    assert {r.turn: (r.branch, r.position) for r in got if r.conv_id == 2} == want


def test_edges(spark):
    rows = [(1, None, "a", "no turn"), (1, None, None, None), (1, 0, "a", "one"), (1, 0, "b", "two"), (1, 1, "a", "x" * 300_000 + "\nhere"),
            (1, 2, "b", "> one\nyes"), (1, 3, "b", ">> here\n> never said\nno"), (1, 3, "b", ">> here\n> never said\nno"), (None, None, None, "")]
    got = threads_of(spark, rows)
    one = sorted((r.position, r.turn, r.role, r.reply_to) for r in got if r.conv_id == 1)[2:]
    # turn 1 answers turn 0 and turn 3 answers turn 1; turn 2 answers turn 0
    assert one == [(2, 0, "a", None), (3, 0, "b", None), (4, 1, "a", 0), (5, 3, "b", 1), (6, 3, "b", 1), (7, 2, "b", 0)]
    assert sorted(r.position for r in got if r.conv_id == 1)[:2] == [0, 1]
    assert [(r.position, r.text) for r in got if r.conv_id is None] == [(0, "")]
