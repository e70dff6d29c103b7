"""Schemas of the feeds. Everything is nullable; numbers may arrive as text in the history."""

from __future__ import annotations

from pyspark.sql import types as T

from panelwright import fixed_values as fixed

_TEXT = ("web_name", "first_name", "second_name", "status", "news")
_IDS = ("id", "team")  # ids of any feed may be beyond 32 bits
_WHOLE = ("element_type", "now_cost", "minutes", "starts")

_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _struct(**columns: str) -> T.StructType:
    """Schema from name=type pairs; unlike a DDL string it needs no running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


def _player_field(name: str) -> T.StructField:
    if name in _IDS:
        return T.StructField(name, T.LongType())
    if name in _WHOLE:
        return T.StructField(name, T.IntegerType())
    if name in _TEXT or name == "selected_by_percent":
        return T.StructField(name, T.StringType())
    return T.StructField(name, T.DoubleType())


PLAYERS = T.StructType(
    [_player_field(name) for name in fixed.ENTITY_ATTRIBUTES]
    + [
        T.StructField("transfers_in_event", T.LongType()),
        T.StructField("transfers_out_event", T.LongType()),
    ]
)
TEAMS = _struct(id="long", name="string", short_name="string")
CALENDAR = _struct(id="int", finished="boolean")
FIXTURES = _struct(
    id="long", event="int", finished="string", kickoff_time="string", team_h="long", team_a="long",
    team_h_difficulty="int", team_a_difficulty="int", team_h_score="int", team_a_score="int",
)
HISTORY = T.StructType(
    [T.StructField("fixture", T.LongType()), T.StructField("round", T.IntegerType())]
    + [T.StructField(name, T.StringType()) for name in fixed.HISTORY_STATS]
)
PLAYER_CODES = _struct(id="long", web_name="string", team="long")
PREDICTIONS = T.StructType(
    [
        T.StructField(
            header,
            T.StringType() if header in ("Player", "Pos", "PriceSignal") else T.DoubleType(),
        )
        for header in fixed.PREDICTION_HEADERS.values()
    ]
)
RANKED_PREDICTIONS = T.StructType([T.StructField("Rank", T.IntegerType()), *PREDICTIONS.fields])
