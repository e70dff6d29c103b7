"""Keyed streaming state: the last n messages of every chat since its last reset (STR2)."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelwright import fixed_values as fixed
from panelwright.functions import text

STATE = "reset_at long, positions array<long>, questions array<string>, answers array<string>"
OUTPUT = "chat_id string, messages array<struct<role:string,content:string>>"
EXCHANGE = "chat_id string, position long, question string, answer string, is_reset boolean"

# the functions below travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _recent(rows: pd.DataFrame, reset_at: int, n: int) -> tuple[pd.DataFrame, int]:
    """Rows after the last reset, at most the n newest; and that reset's position."""
    resets = rows.loc[rows["is_reset"], "position"]
    if len(resets):
        reset_at = max(reset_at, int(resets.max()))
    kept = rows[~rows["is_reset"] & (rows["position"] > reset_at)]
    # a turn delivered twice is one turn: copies go before the newest are counted
    return kept.drop_duplicates("position").nlargest(n, "position"), reset_at


def _thin(n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per Arrow batch: keep only rows that can still matter, before they are shuffled by chat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            resets = rows[rows["is_reset"]].groupby("chat_id")["position"].transform("max")
            last = rows.loc[resets.index[rows.loc[resets.index, "position"] == resets]]
            once = rows[~rows["is_reset"]].drop_duplicates(["chat_id", "position"])
            kept = once.sort_values("position").groupby("chat_id").tail(n)
            yield pd.concat([last, kept])

    return run


def _update(n_messages: int, n_pairs: int):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["position", "question", "answer"]
        if state.exists:
            reset_at, positions, questions, answers = state.get
            kept = pd.DataFrame(
                {"position": list(positions), "question": list(questions), "answer": list(answers)}
            )
        else:
            reset_at, kept = -1, pd.DataFrame(columns=columns)
        kept["is_reset"] = False
        for rows in batches:
            merged = pd.concat([kept, rows[[*columns, "is_reset"]]]) if len(kept) else rows
            kept, reset_at = _recent(merged.astype({"is_reset": bool}), reset_at, n_pairs)
        kept = kept.sort_values("position")
        state.update(
            (
                reset_at,
                [int(p) for p in kept["position"]],
                list(kept["question"]),
                list(kept["answer"]),
            )
        )
        messages = [
            {"role": role, "content": content}
            for _, row in kept.iterrows()
            for role, content in (("user", row["question"]), ("assistant", row["answer"]))
        ]
        yield pd.DataFrame({"chat_id": [key[0]], "messages": [messages[-n_messages:]]})

    return run


def stateful_history(
    stream: DataFrame,
    n: int = fixed.MAX_HISTORY,
    keywords=fixed.TOPIC_KEYWORDS,
) -> DataFrame:
    """Current history of each chat touched by a micro-batch, for update output mode.

    stream: (chat_id, position, question, answer, is_reset). Rows may arrive in any order. Topic
    filter and thinning run before the shuffle, so a chat with most of the traffic sends only a
    few rows per Arrow batch to its state; the state itself holds at most n messages.
    """
    n_pairs = (n + 1) // 2
    usable = F.col("answer").isNotNull() & text.matches_any("question", keywords)
    rows = stream.select(
        F.col("chat_id").cast("string").alias("chat_id"),
        F.col("position").cast("long").alias("position"),
        "question",
        "answer",
        F.coalesce(F.col("is_reset"), F.lit(False)).alias("is_reset"),
    ).filter(F.col("is_reset") | usable)
    thinned = rows.mapInPandas(_thin(n_pairs), EXCHANGE)
    return thinned.groupBy("chat_id").applyInPandasWithState(
        _update(n, n_pairs), OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout
    )
