"""Text, JSON and message-array columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from panelwright import fixed_values as fixed
from panelwright.functions.scalars import _col

MESSAGE = "struct<role:string,content:string>"
UPDATE = "struct<message:struct<chat:struct<id:bigint>,text:string>>"


def contains_ci(c, query: str) -> Column:
    """Case-insensitive substring, FALSE on NULL (SC15)."""
    return F.coalesce(F.lower(_col(c)).contains(query.lower()), F.lit(False))


def matches_ci(c, pattern: str) -> Column:
    """Case-insensitive regular expression, FALSE on NULL (FLT7)."""
    return F.coalesce(_col(c).rlike(f"(?i){pattern}"), F.lit(False))


def matches_any(c, keywords: Sequence[str], word_boundary: bool = False) -> Column:
    """TRUE when any keyword occurs anywhere in the whole text, FALSE on NULL (FLT10).

    Plain substrings are searched one after the other until one is found, in a text lower-cased
    once (the one-element array binds it); that is several times faster than one alternation.
    Whole words need the alternation.
    """
    unique = list(dict.fromkeys(k.lower() for k in keywords))
    low = F.lower(_col(c))
    if word_boundary:
        body = "|".join(re.escape(k) for k in unique)
        return F.coalesce(low.rlike(rf"\b(?:{body})\b"), F.lit(False))
    # a keyword that contains another one can add nothing
    needed = [k for k in unique if not any(o != k and o in k for o in unique)]
    found = F.exists(
        F.array(low), lambda t: reduce(lambda x, y: x | y, [t.contains(k) for k in needed])
    )
    return F.coalesce(found, F.lit(False))


def period_from_name(c, tag: str = "gw") -> Column:
    """The number after the tag in a file or table name (SC16)."""
    return F.regexp_extract(_col(c), rf"{tag}(\d+)", 1).try_cast("int")


def format_line(name, price, points, difficulty, home, value) -> Column:
    """One report line: name padded to 20 but never cut (SC17)."""
    return F.format_string(
        "  %-20s Price: £%s  PredPts: %s  FDR: %s  Home: %s  Value: %s",
        *[_col(c).cast("string") for c in (name, price, points, difficulty, home, value)],
    )


def parse_update(c) -> Column:
    """JSON body to struct(chat_id, text); absent fields give NULL id and empty text (SC18)."""
    body = F.from_json(_col(c), UPDATE)
    return F.struct(
        body["message"]["chat"]["id"].alias("chat_id"),
        F.coalesce(body["message"]["text"], F.lit("")).alias("text"),
    )


def message(role, content) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), _col(content).alias("content")).cast(MESSAGE)


def append_message(messages, role, content) -> Column:
    """Message list with one more message; NULL list counts as empty (SC20)."""
    empty = F.array().cast(f"array<{MESSAGE}>")
    return F.concat(F.coalesce(_col(messages), empty), F.array(message(role, content)))


def tail(items, n: int) -> Column:
    """Last n elements (SC21)."""
    items = _col(items)
    return F.slice(items, F.greatest(F.size(items) - (n - 1), F.lit(1)), F.lit(n))


def build_request(messages, model, system, max_tokens: int = fixed.MAX_TOKENS) -> Column:
    """Request JSON of one prompt (SC19)."""
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.lit(max_tokens).alias("max_tokens"),
            F.lit(system).alias("system"),
            _col(messages).alias("messages"),
        )
    )
