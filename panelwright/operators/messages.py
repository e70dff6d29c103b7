"""Chat messages: routing, bounded history, report text and prompts (CHT*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright import fixed_values as fixed
from panelwright.functions import text
from panelwright.functions.windows import is_group_start, rank_in_group
from panelwright.operators.aggregates import join_lines
from panelwright.operators.joins import attach
from panelwright.session import materialise
from panelwright.sources.feeds import latest_partition


def parse_messages(df: DataFrame, body: str = "body") -> DataFrame:
    """chat_id and text of every update; columns other than the body are kept (SC18)."""
    return df.withColumn("__u", text.parse_update(body)).select(
        *[c for c in df.columns if c != body], "__u.chat_id", "__u.text"
    )


def valid_messages(df: DataFrame, chat: str = "chat_id", body: str = "text") -> DataFrame:
    """Messages with a chat (0 is none) and a text (FLT9)."""
    return df.filter((F.col(chat) != 0) & (F.col(body) != ""))


def keyword_intent(
    df: DataFrame,
    keywords: Sequence[str] = fixed.TOPIC_KEYWORDS,
    body: str = "text",
    word_boundary: bool = False,
    to: str = "on_topic",
) -> DataFrame:
    """Mark messages that mention a keyword (CHT2)."""
    return df.withColumn(to, text.matches_any(body, keywords, word_boundary))


def route(
    chat: str = "chat_id", body: str = "text", keywords: Sequence[str] = fixed.TOPIC_KEYWORDS
) -> Column:
    """ignore, reset, off_topic or answer, in this order of precedence (CHT1)."""
    usable = F.coalesce((F.col(chat) != 0) & (F.col(body) != ""), F.lit(False))
    return (
        F.when(~usable, "ignore")
        .when(F.col(body) == fixed.RESET_COMMAND, "reset")
        .when(~text.matches_any(body, keywords), "off_topic")
        .otherwise("answer")
    )


def route_messages(
    df: DataFrame, body: str = "body", keywords: Sequence[str] = fixed.TOPIC_KEYWORDS
) -> DataFrame:
    """Parsed updates with their route (CHT1)."""
    return parse_messages(df, body).withColumn("route", route(keywords=keywords))


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n last rows per key (WIN12); limited per task before the shuffle."""
    rank = rank_in_group(key, [F.col(order).desc()])
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def since_reset(df: DataFrame, key: str, order: str, is_reset: Column, salt: int = 0) -> DataFrame:
    """Rows after the key's last reset; all rows of keys without one (WIN13).

    The last reset is an aggregate, not a running sum, so a hot key is never gathered in one task;
    salt splits its rows in the join as well.
    """
    resets = df.groupBy(key).agg(F.max(F.when(is_reset, F.col(order))).alias("__reset"))
    joined = attach(df, resets, key, salt=salt, salt_by=[key, order])
    kept = joined.filter(F.col("__reset").isNull() | (F.col(order) > F.col("__reset")))
    return kept.drop("__reset")


def exchanges(
    turns: DataFrame, chat: str, order: str, role: str = "role", body: str = "text"
) -> DataFrame:
    """Question and answer of each exchange: an assistant turn answers the turn right before it.

    Joined on (chat, position), which spreads one long thread over all tasks.
    """
    asked = turns.filter(F.col(role) == "user").select(chat, order, F.col(body).alias("question"))
    said = turns.filter(F.col(role) == "assistant").select(
        chat, (F.col(order) - 1).alias(order), F.col(body).alias("answer")
    )
    return asked.join(said, [chat, order], "left")


def chat_history(
    pairs: DataFrame,
    resets: DataFrame,
    chat: str,
    order: str,
    n: int = fixed.MAX_HISTORY,
    keywords: Sequence[str] = fixed.TOPIC_KEYWORDS,
) -> DataFrame:
    """The last n messages per chat since its last reset, off-topic exchanges left out (CHT3).

    pairs: (chat, order, question, answer); resets: (chat, order). The last n messages overall are
    taken first and those before the reset dropped after: the same rows, and both sides of the
    join are bounded per chat.
    """
    usable = pairs.filter(F.col("answer").isNotNull() & (F.col("question") != ""))
    on_topic = usable.filter(text.matches_any("question", keywords))
    needed = last_n(on_topic, chat, order, (n + 1) // 2)
    marks = resets.groupBy(chat).agg(F.max(order).alias("__reset"))
    recent = needed.join(marks, chat, "left").filter(
        F.col("__reset").isNull() | (F.col(order) > F.col("__reset"))
    )
    both = F.array(text.message("user", "question"), text.message("assistant", "answer"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), both.alias("m"))))
    messages = F.flatten(F.transform(ordered, lambda s: s["m"]))
    per_chat = recent.groupBy(chat).agg(messages.alias("messages"))
    return per_chat.withColumn("messages", text.tail("messages", n))


def context_text(
    best: DataFrame,
    period: str = "gw",
    value: int | None = None,
    group: str = "Pos",
    order: Sequence[str] = ("Rank",),
    groups: Sequence[str] = tuple(fixed.POSITIONS.values()),
    n: int = fixed.REPORT_TOP,
) -> DataFrame:
    """One text block per period with a header line per group (CHT4).

    best is the ranked report partitioned by period; the newest period is taken unless one is
    given. The report holds at most n rows per group, which also bounds the text.
    """
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group))
    rows = latest_partition(best, period, value)
    rows = rows.filter(F.col(group).isin(list(groups)) & (F.col("Rank") <= n))
    rows = rows.withColumn("__place", place)
    start = is_group_start(group, [period], ["__place", *order])
    line = text.format_line("Player", "`Price(£m)`", "PredPts", "FDR", "Home", "Value")
    with_header = F.when(start, F.concat(F.lit("\n"), F.col(group), F.lit(":\n"), line))
    rows = rows.withColumn("__line", with_header.otherwise(line))
    body = join_lines(rows, "__line", ["__place", *order], [period])
    title = F.format_string("GW%s Predictions:\n", F.col(period).cast("string"))
    return body.withColumn("text", F.concat(title, F.col("text")))


def history_before(
    questions: DataFrame,
    pairs: DataFrame,
    resets: DataFrame,
    chat: str,
    order: str,
    n: int = fixed.MAX_HISTORY,
    keywords: Sequence[str] = fixed.TOPIC_KEYWORDS,
) -> DataFrame:
    """The last n messages before each question and after the last reset before it (CHT3 at a point in time).

    One row per (chat, order) of a question that has a history. Events are dealt by range, so a chat of
    any length spreads over many blocks; a block counts its exchanges on its own and takes the counts of
    the blocks before it. A question then asks for the numbers right below its own, at most (n + 1) // 2.
    """
    usable = pairs.filter(F.col("answer").isNotNull() & (F.col("question") != ""))
    usable = usable.filter(text.matches_any("question", keywords))
    keys = [F.col(chat), F.col(order)]
    # at the same place a question comes first: it doesn't see its own exchange
    events = (
        questions.select(*keys).distinct().withColumn("__kind", F.lit(0))
        .unionByName(resets.select(*keys, F.lit(1).alias("__kind")))
        .unionByName(usable.select(*keys, F.lit(2).alias("__kind"), "question", "answer"), allowMissingColumns=True)
    )
    dealt = events.repartitionByRange(chat, order, "__kind").withColumn("__block", F.spark_partition_id())
    dealt = materialise(dealt, "chat-events")
    is_pair = (F.col("__kind") == 2).cast("long")
    reset = F.when(F.col("__kind") == 1, F.col(order))
    blocks = dealt.groupBy(chat, "__block").agg(F.sum(is_pair).alias("__pairs"), F.max(reset).alias("__mark"))
    earlier = Window.partitionBy(chat).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        chat,
        "__block",
        F.coalesce(F.sum("__pairs").over(earlier), F.lit(0)).alias("__before"),
        F.max("__mark").over(earlier).alias("__earlier"),
    )
    within = Window.partitionBy(chat, "__block").orderBy(order, "__kind")
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = dealt.select("*", F.sum(is_pair).over(within).alias("__in"), F.max(reset).over(within).alias("__mark"))
    placed = counted.join(offsets, [chat, "__block"]).withColumns(
        {"__place": F.col("__before") + F.col("__in"), "__reset": F.coalesce("__mark", "__earlier")}
    )
    asked = placed.filter((F.col("__kind") == 0) & (F.col("__place") > 0)).select(chat, order, "__reset", "__place")
    first = F.greatest(F.col("__place") - ((n + 1) // 2 - 1), F.lit(1))
    wanted = asked.withColumn("__place", F.explode(F.sequence(first, F.col("__place"))))
    said = placed.filter(F.col("__kind") == 2)
    said = said.select(chat, "__place", F.col(order).alias("__said"), "question", "answer")
    found = wanted.join(said, [chat, "__place"]).filter(
        F.col("__reset").isNull() | (F.col("__said") > F.col("__reset"))
    )
    both = F.array(text.message("user", "question"), text.message("assistant", "answer"))
    ordered = F.array_sort(F.collect_list(F.struct("__place", both.alias("m"))))  # (n + 1) // 2 at most
    messages = F.flatten(F.transform(ordered, lambda s: s["m"]))
    per_question = found.groupBy(chat, order).agg(messages.alias("messages"))
    return per_question.withColumn("messages", text.tail("messages", n))


def build_prompts(
    questions: DataFrame,
    pairs: DataFrame,
    resets: DataFrame,
    context: DataFrame,
    chat: str = "chat_id",
    order: str = "seq",
    n: int = fixed.MAX_HISTORY,
    keywords: Sequence[str] = fixed.TOPIC_KEYWORDS,
    model: str = "chat-model",
    system: str = "Answer from the prediction data provided.",
    label: str = "Data",
    max_tokens: int = fixed.MAX_TOKENS,
) -> DataFrame:
    """One request per on-topic question: its history, then context and question (CHT5). Nothing is sent.

    The history is the one at the time of the question: see history_before. context is one row; it
    enters the plan as a scalar subquery.
    """
    asked = questions.filter(F.coalesce(F.col("text") != "", F.lit(False)) & text.matches_any("text", keywords))
    history = history_before(asked, pairs, resets, chat, order, n, keywords)
    joined = asked.join(history, [chat, order], "left")
    content = F.concat(
        F.lit(f"{label}:\n"),
        context.select("text").scalar(),
        F.lit("\n\nQuestion: "),
        F.col("text"),
    )
    out = joined.withColumn("messages", text.append_message("messages", "user", content))
    return out.withColumn("request", text.build_request("messages", model, system, max_tokens))
