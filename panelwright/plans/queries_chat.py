"""Registered queries: message routing, bounded history, prompts, streaming state."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright import fixed_values as fixed
from panelwright.functions import text
from panelwright.operators import messages
from panelwright.plans import tables as t
from panelwright.plans.queries_reports import GROUPS, SQL_CONTEXT_TEXT, best_parts
from panelwright.plans.registry import query
from panelwright.plans.tables import sql_with
from panelwright.session import scratch_path
from panelwright.streaming.chat_state import stateful_history

# the words of the driver's prose are invented, so these queries look for common syllables
TOPICS = ["the", "qu", "sch", "por"]
SQL_TOPIC = "(" + " OR ".join(f"contains(lower({{c}}), '{k}')" for k in TOPICS) + ")"
SQL_KEYWORDS = " OR ".join(
    f"contains(lower(text), '{k}')" for k in dict.fromkeys(fixed.TOPIC_KEYWORDS)
)


@query(
    "keyword_intent",
    "CHT2 FLT10 SC14 SC15",
    f"SELECT conv_id, turn, ({SQL_KEYWORDS}) AS on_topic FROM conversations",
)
def keyword_intent(spark, sf):
    turns = t.table(spark, sf, "conversations")
    return messages.keyword_intent(turns).select("conv_id", "turn", "on_topic")


@query(
    "keyword_intent_documents",
    "CHT2 FLT10 SC14 SC15",
    f"""SELECT doc_id, ({SQL_KEYWORDS}) AS on_topic,
      regexp_matches(lower(text), '(^|[^a-z0-9_])(the|value|team)($|[^a-z0-9_])') AS has_word FROM documents""",
)
def keyword_intent_documents(spark, sf):
    docs = spark.read.schema("doc_id bigint, text string").parquet(f"{sf}/documents.parquet")
    words = text.matches_any("text", ["the", "value", "team"], word_boundary=True)
    marked = messages.keyword_intent(docs).withColumn("has_word", words)
    return marked.select("doc_id", "on_topic", "has_word")


def _updates(spark, sf):
    """Conversations wrapped as update JSON, with absent ids, empty texts and resets."""
    kind = F.col("conv_id") % 9
    chat = F.when(kind == 0, F.lit(None).cast("bigint")).when(kind == 1, F.lit(0)).otherwise(F.col("conv_id"))
    body = F.when(kind == 2, "").when(F.col("role") == "system", fixed.RESET_COMMAND)
    body = body.when(kind != 3, F.col("text"))
    message = F.struct(F.struct(chat.alias("id")).alias("chat"), body.alias("text"))
    update = F.to_json(F.struct(message.alias("message")))
    return t.table(spark, sf, "conversations").select("conv_id", "turn", update.alias("body"))


SQL_UPDATES = """
updates AS (SELECT conv_id, turn, CASE conv_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE conv_id END AS chat_id,
  CASE WHEN conv_id % 9 = 2 THEN '' WHEN role = 'system' THEN '/start' WHEN conv_id % 9 <> 3 THEN text ELSE '' END AS text
  FROM conversations)"""


@query(
    "parse_update",
    "SC18",
    sql_with(SQL_UPDATES) + "SELECT conv_id, turn, coalesce(chat_id, -1) AS chat_id, text FROM updates",
)
def parse_update(spark, sf):
    parsed = messages.parse_messages(_updates(spark, sf))
    return parsed.withColumn("chat_id", F.coalesce("chat_id", F.lit(-1)))


@query(
    "valid_messages",
    "FLT9",
    sql_with(SQL_UPDATES) + "SELECT conv_id, turn FROM updates WHERE chat_id <> 0 AND text <> ''",
)
def valid_messages(spark, sf):
    parsed = messages.parse_messages(_updates(spark, sf))
    return messages.valid_messages(parsed).select("conv_id", "turn")


@query(
    "route_messages",
    "CHT1 SC18 FLT9 FLT10",
    sql_with(SQL_UPDATES)
    + f"""SELECT conv_id, turn, CASE WHEN chat_id IS NULL OR chat_id = 0 OR text = '' THEN 'ignore'
      WHEN text = '/start' THEN 'reset' WHEN NOT {SQL_TOPIC.format(c="text")} THEN 'off_topic'
      ELSE 'answer' END AS route FROM updates""",
)
def route_messages(spark, sf):
    routed = messages.route_messages(_updates(spark, sf), keywords=TOPICS)
    return routed.select("conv_id", "turn", "route")


@query(
    "last_n",
    "WIN12",
    sql_with(t.SQL_TURNS)
    + """SELECT chat_id, seq, role FROM turns
    QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) <= 4""",
)
def last_n(spark, sf):
    return messages.last_n(t.chat_turns(spark, sf), "chat_id", "seq", 4).select("chat_id", "seq", "role")


SQL_SINCE = sql_with(t.SQL_TURNS, """
marks AS (SELECT chat_id, max(seq) AS reset_at FROM turns WHERE role = 'system' GROUP BY 1)""") + """
SELECT chat_id, seq, role FROM turns LEFT JOIN marks USING (chat_id) WHERE reset_at IS NULL OR seq > reset_at"""


@query("since_reset", "WIN13", SQL_SINCE)
def since_reset(spark, sf):
    turns = t.chat_turns(spark, sf).select("chat_id", "seq", "role")
    return messages.since_reset(turns, "chat_id", "seq", F.col("role") == "system")


@query("since_reset_salted", "WIN13", SQL_SINCE)
def since_reset_salted(spark, sf):
    turns = t.chat_turns(spark, sf).select("chat_id", "seq", "role")
    return messages.since_reset(turns, "chat_id", "seq", F.col("role") == "system", salt=4)


SQL_HISTORY = f"""
pairs AS (SELECT q.chat_id, q.seq, q.text AS question, a.text AS answer FROM turns q JOIN turns a
    ON a.chat_id = q.chat_id AND a.seq = q.seq + 1 AND a.role = 'assistant'
  WHERE q.role = 'user' AND q.text <> '' AND {SQL_TOPIC.format(c="q.text")}),
marks AS (SELECT chat_id, max(seq) AS reset_at FROM turns WHERE role = 'system' GROUP BY 1),
kept AS (SELECT chat_id, seq AS pos, 'user' AS role, question AS content FROM pairs LEFT JOIN marks USING (chat_id)
    WHERE reset_at IS NULL OR seq > reset_at
  UNION ALL SELECT chat_id, seq + 0.5, 'assistant', answer FROM pairs LEFT JOIN marks USING (chat_id)
    WHERE reset_at IS NULL OR seq > reset_at),
history AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY pos DESC) <= 4)"""
SQL_HISTORY_ROWS = """SELECT chat_id, count(*) AS n_messages,
  string_agg(role || ': ' || content, chr(10) ORDER BY pos) AS text FROM history GROUP BY 1"""


def _pairs(spark, sf):
    turns = t.chat_turns(spark, sf).select("chat_id", "seq", "role", "text")
    resets = turns.filter("role = 'system'").select("chat_id", "seq")
    return messages.exchanges(turns, "chat_id", "seq"), resets


def _history(spark, sf):
    pairs, resets = _pairs(spark, sf)
    return messages.chat_history(pairs, resets, "chat_id", "seq", 4, TOPICS)


def _as_text(history):
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return history.select(
        "chat_id", F.size("messages").cast("bigint").alias("n_messages"), joined.alias("text")
    )


@query(
    "chat_history",
    "CHT3 WIN12 WIN13 SC20 SC21",
    sql_with(t.SQL_TURNS, SQL_HISTORY) + SQL_HISTORY_ROWS,
)
def chat_history(spark, sf):
    return _as_text(_history(spark, sf))


@query(
    "exchanges",
    "CHT3",
    sql_with(t.SQL_TURNS)
    + """SELECT q.chat_id, q.seq, q.text AS question, a.text AS answer FROM turns q LEFT JOIN turns a
      ON a.chat_id = q.chat_id AND a.seq = q.seq + 1 AND a.role = 'assistant' WHERE q.role = 'user'""",
)
def exchanges(spark, sf):
    return _pairs(spark, sf)[0]


@query(
    "append_and_tail",
    "SC20 SC21",
    """SELECT conv_id, turn, 'a: x' || chr(10) || role || ': ' || text AS both, role || ': ' || text AS last
    FROM conversations""",
)
def append_and_tail(spark, sf):
    first = text.append_message(F.lit(None), "a", F.lit("x"))
    both = text.append_message(first, F.col("role"), "text")

    def shown(arr):
        return F.array_join(F.transform(arr, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")

    return t.table(spark, sf, "conversations").select(
        "conv_id", "turn", shown(both).alias("both"), shown(text.tail(both, 1)).alias("last")
    )


# each on-topic question with the exchanges before it, since the last reset before it
SQL_PROMPT_HISTORY = f"""
asked AS (SELECT chat_id, seq, text FROM turns WHERE role = 'user' AND text <> '' AND {SQL_TOPIC.format(c="text")}),
since AS (SELECT a.chat_id, a.seq, max(s.seq) AS reset_at FROM asked a
  LEFT JOIN turns s ON s.chat_id = a.chat_id AND s.role = 'system' AND s.seq < a.seq GROUP BY 1, 2),
earlier AS (SELECT a.chat_id, a.seq, p.seq AS pos, p.question, p.answer FROM since a
  JOIN pairs p ON p.chat_id = a.chat_id AND p.seq < a.seq AND (a.reset_at IS NULL OR p.seq > a.reset_at)
  QUALIFY row_number() OVER (PARTITION BY a.chat_id, a.seq ORDER BY p.seq DESC) <= 2),
before AS (SELECT chat_id, seq, 2 * count(*) AS n_messages,
  string_agg('user: ' || question || chr(10) || 'assistant: ' || answer || chr(10), '' ORDER BY pos) AS text
  FROM earlier GROUP BY 1, 2)"""


def _prompts(spark, sf):
    turns = t.chat_turns(spark, sf).filter("role = 'user'").select("chat_id", "seq", "text")
    context = messages.context_text(best_parts(spark, sf), groups=GROUPS)
    pairs, resets = _pairs(spark, sf)
    return messages.build_prompts(turns, pairs, resets, context, n=4, keywords=TOPICS, system="Be brief.")


@query(
    "build_prompts",
    "CHT5 SC19 SC20",
    sql_with(t.SQL_TURNS, SQL_HISTORY, SQL_CONTEXT_TEXT, SQL_PROMPT_HISTORY)
    + """SELECT a.chat_id, a.seq, 'chat-model' AS model, 1024 AS max_tokens, 'Be brief.' AS system,
      coalesce(n_messages, 0) + 1 AS n_messages, coalesce(b.text, '') || 'user: Data:' || chr(10) || c.text
      || chr(10) || chr(10) || 'Question: ' || a.text AS messages
    FROM asked a LEFT JOIN before b ON b.chat_id = a.chat_id AND b.seq = a.seq, context c""",
)
def build_prompts(spark, sf):
    """The request JSON, parsed back into its fields; all messages in order."""
    schema = (
        "model string, max_tokens int, system string, messages array<struct<role:string,content:string>>"
    )
    parsed = _prompts(spark, sf).select("chat_id", "seq", F.from_json("request", schema).alias("r"))
    lines = F.transform("r.messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return parsed.select(
        "chat_id",
        "seq",
        "r.model",
        "r.max_tokens",
        "r.system",
        F.size("r.messages").cast("bigint").alias("n_messages"),
        F.array_join(lines, "\n").alias("messages"),
    )


@query("request_json", "SC19")
def request_json(spark, sf):
    """The request text itself."""
    return _prompts(spark, sf).select("chat_id", "seq", "request")


@query(
    "stateful_history",
    "STR2",
    sql_with(t.SQL_TURNS, SQL_HISTORY) + SQL_HISTORY_ROWS,
)
def stateful_history_query(spark, sf):
    """The batch history again, from a stream of exchanges and resets read in several batches."""
    pairs, resets = _pairs(spark, sf)
    chat, position = F.col("chat_id").cast("string").alias("chat_id"), F.col("seq").alias("position")
    landed = pairs.select(chat, position, "question", "answer", F.lit(False).alias("is_reset")).unionByName(
        resets.select(chat, position, F.lit(True).alias("is_reset")), allowMissingColumns=True
    )
    landing, out = scratch_path(spark, "exchanges"), scratch_path(spark, "chat-state")
    landed.repartition(6, "chat_id", "position").write.parquet(landing)
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 2).parquet(landing)

    def land(batch, batch_id):
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/table/batch={batch_id}"
        )

    state = stateful_history(stream, 4, TOPICS)
    run = (
        state.writeStream.outputMode("update")
        .foreachBatch(land)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    schema = "chat_id string, messages array<struct<role:string,content:string>>, version bigint, batch int"
    versions = spark.read.schema(schema).parquet(f"{out}/table")
    newest = versions.groupBy("chat_id").agg(F.max_by("messages", "version").alias("messages"))
    return _as_text(newest.filter(F.size("messages") > 0)).withColumn(
        "chat_id", F.col("chat_id").cast("bigint")
    )
