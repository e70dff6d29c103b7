"""Routing, history, report text and prompts; the stream gives the same history as the batch."""

import json

import pytest
from pyspark.sql import functions as F

import pandas as pd
from panelwright.streaming import chat_state
from panelwright import fixed_values as fixed
from panelwright.operators import messages
from panelwright.plans import reports
from panelwright.streaming.chat_state import stateful_history


def _update(chat, text):
    message = {}
    if chat is not None:
        message["chat"] = {"id": chat}
    if text is not None:
        message["text"] = text
    return json.dumps({"message": message})


@pytest.mark.parametrize(
    "body,want",
    [
        (_update(5, "Who is best?"), "answer"),
        (_update(5, "/start"), "reset"),
        (_update(5, "/start now"), "off_topic"),
        (_update(5, "rain today"), "off_topic"),
        (_update(5, "the whole day"), "answer"),
        (_update(5, ""), "ignore"),
        (_update(5, None), "ignore"),
        (_update(None, "who"), "ignore"),
        (_update(0, "who"), "ignore"),
        ("{}", "ignore"),
        ("not json", "ignore"),
    ],
)
def test_route(spark, body, want):
    df = spark.createDataFrame([(1, body)], "update_id int, body string")
    assert messages.route_messages(df).first().route == want


def _turns(spark):
    """Chat 1: reset in mid-thread; chat 2: 8 exchanges, some off topic; chat 3: only off topic."""
    rows = [(1, 0, "user", "who first"), (1, 1, "assistant", "a0"), (1, 2, "system", "/start"),
            (1, 3, "user", "who second"), (1, 4, "assistant", "a1"), (1, 5, "user", "rain"),
            (1, 6, "assistant", "off"), (1, 7, "user", "who waits")]
    for i in range(8):
        rows += [(2, 2 * i, "user", "sunny" if i == 5 else f"team {i}"), (2, 2 * i + 1, "assistant", f"b{i}")]
    rows += [(3, 0, "user", "rain"), (3, 1, "assistant", "off")]
    return spark.createDataFrame(rows, "chat_id long, seq long, role string, text string")


def _expected(n):
    chat2 = [m for i in (0, 1, 2, 3, 4, 6, 7) for m in (("user", f"team {i}"), ("assistant", f"b{i}"))]
    return {1: [("user", "who second"), ("assistant", "a1")], 2: chat2[-n:]}


def _collected(df):
    return {int(r.chat_id): [(m.role, m.content) for m in r.messages] for r in df.collect() if r.messages}


@pytest.mark.parametrize("n", [10, 4, 3, 1])
def test_history(spark, n):
    turns = _turns(spark)
    pairs = messages.exchanges(turns, "chat_id", "seq")
    resets = turns.filter("role = 'system'").select("chat_id", "seq")
    got = _collected(messages.chat_history(pairs, resets, "chat_id", "seq", n))
    want = {k: v[-n:] for k, v in _expected(n).items()}
    assert got == want


@pytest.mark.parametrize("n,order", [(10, 1), (4, 1), (4, -1), (3, -1)])
def test_stream_equals_batch(spark, tmp_path, n, order):
    """One file per micro-batch, in order and in reverse order of arrival."""
    turns = _turns(spark)
    pairs = messages.exchanges(turns, "chat_id", "seq").withColumn("is_reset", F.lit(False))
    resets = turns.filter("role = 'system'").select("chat_id", "seq", F.lit(True).alias("is_reset"))
    rows = pairs.unionByName(resets, allowMissingColumns=True).withColumnRenamed("seq", "position")
    landing = str(tmp_path / "in")
    parts = sorted(rows.collect(), key=lambda r: r.position * order)
    for i in range(0, len(parts), 5):
        spark.createDataFrame(parts[i : i + 5], rows.schema).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    name = f"hist_{n}_{'up' if order > 0 else 'down'}"
    run = (
        stateful_history(stream, n).writeStream.outputMode("update").format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    seen = {}
    for r in spark.table(name).collect():  # rows of one chat arrive in batch order
        seen[int(r.chat_id)] = [(m.role, m.content) for m in r.messages]
    assert {k: v for k, v in seen.items() if v} == {k: v[-n:] for k, v in _expected(n).items()}


def _best(spark):
    rows = [(gw, i % 4, i, fixed.POSITIONS[i % 4 + 1]) for gw in (9, 10) for i in range(60)]
    df = spark.createDataFrame(rows, "gw int, p int, i int, Pos string")
    return df.select(
        "gw", "Pos", (F.floor(F.col("i") / 4) + 1).cast("int").alias("Rank"), F.format_string("P%d", "i").alias("Player"),
        *[F.col("i").cast("double").alias(c) for c in ("Price(£m)", "PredPts", "FDR", "Home", "Value")],
    )


def test_context_text(spark):
    got = messages.context_text(_best(spark)).first()
    lines = got.text.split("\n")
    assert got.gw == 10 and lines[0] == "GW10 Predictions:" and lines[1] == "" and lines[2] == "GK:"
    assert lines[3] == "  P0                   Price: £0.0  PredPts: 0.0  FDR: 0.0  Home: 0.0  Value: 0.0"
    assert [x for x in lines if x.endswith(":") and not x.startswith("GW")] == ["GK:", "DEF:", "MID:", "FWD:"]
    assert sum(x.startswith("  P") for x in lines) == 40
    assert messages.context_text(_best(spark), value=9).first().gw == 9


def test_prompts(spark):
    turns = _turns(spark)
    pairs = messages.exchanges(turns, "chat_id", "seq")
    resets = turns.filter("role = 'system'").select("chat_id", "seq")
    updates = spark.createDataFrame(
        [(1, _update(2, "who then")), (2, _update(9, "best buy?")), (3, _update(2, "rain")), (4, _update(2, "/start"))],
        "update_id int, body string",
    )
    out = reports.prompts(updates, pairs, resets, _best(spark), model="m", system="s").collect()
    got = {r.update_id: json.loads(r.request) for r in out}
    assert set(got) == {1, 2}
    assert got[1]["model"] == "m" and got[1]["system"] == "s" and got[1]["max_tokens"] == 1024
    assert len(got[1]["messages"]) == 11 and len(got[2]["messages"]) == 1
    last = got[1]["messages"][-1]
    assert last["role"] == "user" and last["content"].startswith("Data:\nGW10 Predictions:\n")
    assert last["content"].endswith("\n\nQuestion: who then")
    assert got[1]["messages"][-2] == {"role": "assistant", "content": "b7"}


def test_prompts_see_what_was_said_before_them(spark):
    turns = [
        (1, 1, "user", "who a"), (1, 2, "assistant", "x"), (1, 3, "user", "rain"), (1, 4, "assistant", "no"),
        (1, 5, "user", "who b"), (1, 6, "assistant", "y"), (1, 7, "system", "/start"), (1, 8, "user", "who c"),
        (1, 9, "assistant", "z"), (1, 10, "user", "who d"), (2, 1, "user", "who e"),
    ]
    df = spark.createDataFrame(turns, "chat_id long, seq long, role string, text string")
    pairs, resets = messages.exchanges(df, "chat_id", "seq"), df.filter("role = 'system'").select("chat_id", "seq")
    asked = df.filter("role = 'user'").select("chat_id", "seq", "text")
    out = messages.build_prompts(asked, pairs, resets, messages.context_text(_best(spark))).collect()
    got = {(r.chat_id, r.seq): [m.content for m in r.messages[:-1]] for r in out}
    assert got == {(1, 1): [], (1, 5): ["who a", "x"], (1, 8): [], (1, 10): ["who c", "z"], (2, 1): []}


def test_a_reset_in_the_batch_ends_the_history(spark):
    pairs = spark.createDataFrame([(2, 50, "who", "me")], "chat_id long, seq long, question string, answer string")
    resets = spark.createDataFrame([(2, 40)], "chat_id long, seq long")
    updates = spark.createDataFrame(
        [(1, _update(2, "who then")), (2, _update(2, "/start")), (3, _update(2, "best buy?"))], "update_id int, body string"
    )
    out = reports.prompts(updates, pairs, resets, _best(spark)).collect()
    assert {r.update_id: len(r.messages) for r in out} == {1: 3, 3: 1}


def test_a_long_chat_is_dealt_into_blocks(spark):
    rows = spark.range(1, 3001).select(F.lit(1).alias("chat_id"), F.col("id").alias("seq"), F.format_string("who %d", "id").alias("text"))
    pairs = rows.select("chat_id", "seq", F.col("text").alias("question"), F.col("seq").cast("string").alias("answer"))
    resets = rows.filter("seq % 1000 = 0").select("chat_id", "seq")
    out = messages.history_before(rows, pairs, resets, "chat_id", "seq", 5).collect()
    got = {r.seq: [m.content for m in r.messages] for r in out}
    for seq in range(1, 3001):
        since = (seq - 1) // 1000 * 1000
        said = [x for s in range(since + 1 if since else 1, seq) for x in (f"who {s}", str(s))]
        assert got.get(seq, []) == said[-5:], seq


def test_last_n_is_limited_before_the_shuffle(spark):
    out = messages.last_n(_turns(spark), "chat_id", "seq", 2)
    assert out.count() == 6
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_repeated_delivery_loses_no_turn():
    rows = pd.DataFrame({"chat_id": "c", "position": [2, 3, 4, 5, 6, 4, 5, 6], "question": "q", "answer": "a", "is_reset": False})
    kept, _ = chat_state._recent(rows, -1, 5)
    assert sorted(kept["position"]) == [2, 3, 4, 5, 6]
    thin = pd.concat(chat_state._thin(5)(iter([rows])))
    assert sorted(thin["position"]) == [2, 3, 4, 5, 6]
