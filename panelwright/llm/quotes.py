"""Chat formatting by quotation linking: who replies to whom, and conversations without quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import ranks
from panelwright.llm.stored import stored

MARKS = r"^\s*(?:>\s*)+"
ATTRIBUTION = r"(?i)^\s*(?:on\s.+|.{1,80})\b(?:wrote|writes|said)\s*:\s*$"
SPAN = 1024  # turns of a conversation, or of one passage of it, that meet in a task


def level(line: Column) -> Column:
    """How deep a line is quoted: the number of its leading marks."""
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normalised(line: Column) -> Column:
    """A line without quote marks, case, and differences of white space or sign."""
    bare = F.regexp_replace(line, MARKS, "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """Each message with its lines as (level, hash of the normalised passage) and its text without quotes."""
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)
    read = messages.withColumn("__lines", lines)
    read = read.withColumn("__levels", F.transform("__lines", level))

    def own(line: Column, k: Column) -> Column:
        introduces = line.rlike(ATTRIBUTION) & (F.coalesce(F.get("__levels", k + 1), F.lit(0)) > 0)
        return (F.get("__levels", k) == 0) & ~introduces

    passages = F.transform(
        "__lines", lambda x, k: F.struct(F.get("__levels", k).alias("level"), normalised(x).alias("passage"))
    )
    kept = F.trim(F.array_join(F.filter("__lines", own), "\n"), F.lit("\n\r\t "))
    return read.select(
        *messages.columns, kept.alias("__own"),
        F.transform(
            F.filter(passages, lambda x: x["passage"] != ""),
            lambda x: F.struct(x["level"].alias("level"), F.xxhash64(x["passage"]).alias("hash"), F.md5(x["passage"]).alias("check")),
        ).alias("__passages"),
    )


def _links(parsed: DataFrame) -> DataFrame:
    """For each message that quotes: the message it answers, and how many of its quoted lines were found.

    A quoted passage belongs to the latest earlier message of the conversation that holds it as its own,
    found by a running maximum over the turns that hold or quote it, so no pairs are made. A message
    answers the one that most of its least nested found passages lead to, the later one of two.
    """
    seen = parsed.select("conv_id", "turn", F.explode("__passages").alias("p"))
    seen = seen.groupBy("conv_id", "turn", F.col("p.hash").alias("hash"), F.col("p.check").alias("check")).agg(
        F.min("p.level").alias("lowest"), F.min(F.when(F.col("p.level") > 0, F.col("p.level"))).alias("level")
    )
    seen = seen.withColumn("own", F.when(F.col("lowest") == 0, F.col("turn"))).withColumn("__span", F.floor(F.col("turn") / SPAN))
    found = ranks.running_max(seen, ["conv_id", "hash", "check"], ["turn"], "__span", "own", "source", before=True)
    found = found.filter("level IS NOT NULL AND source IS NOT NULL")
    votes = found.groupBy("conv_id", "turn", "source", "level").agg(F.count(F.lit(1)).alias("votes"))
    best = F.max_by("source", F.struct(-F.col("level"), "votes", "source"))
    return votes.groupBy("conv_id", "turn").agg(best.alias("__source"), F.sum("votes").alias("__found"))


def _starts(turns: DataFrame) -> DataFrame:
    """Place of the first message of each branch in reply order: columns conv, branch, start.

    turns: conv, turn, branch (the turn at which its branch begins), source (of a branch's first turn: the
    turn answered) and rows. In reply order a message is followed by its answers, each with all that answers
    it, in the order of turns. The next message of a branch is the first answer, so a branch comes whole, then
    the branches that answer its messages, from its last message back, and those of one message by turn. Each
    branch is thus preceded by its parent, or by the last branch below its sibling before; both are found by
    pointers that double their reach, as are the sums of what precedes a branch. Nothing is gathered by
    conversation or message.
    """
    branches = turns.groupBy("conv", "branch").agg(F.sum("rows").alias("rows"))
    heads = turns.filter("turn = branch AND source IS NOT NULL").select("conv", "branch", F.col("source").alias("turn"))
    kids = stored(heads.join(turns.select("conv", "turn", F.col("branch").alias("parent")), ["conv", "turn"]), "quotes-answers")
    if kids.isEmpty():
        return branches.select("conv", "branch", F.lit(0).cast("bigint").alias("start"))

    # the sibling before: of the branches that answer the same message the one before, or else the last of
    # those that answer the next message of the parent that has any
    spanned = kids.withColumn("__span", F.floor(F.col("branch") / SPAN))
    same = ranks.running_max(spanned, ["conv", "turn"], ["branch"], "__span", "branch", "sibling", before=True).drop("__span")
    answered = kids.groupBy("conv", "parent", "turn").agg(F.max("branch").alias("last"))
    back = answered.withColumn("__back", -F.col("turn")).withColumn("__last", F.struct("__back", "last"))
    back = back.withColumn("__span", F.floor(F.col("__back") / SPAN))
    back = ranks.running_max(back, ["conv", "parent"], ["__back"], "__span", "__last", "__prior", before=True)
    siblings = same.join(back.select("conv", "turn", F.col("__prior.last").alias("__other")), ["conv", "turn"])
    siblings = siblings.select("conv", "branch", "parent", F.coalesce("sibling", "__other").alias("sibling"))

    below = answered.groupBy("conv", "parent").agg(F.min(F.struct("turn", (-F.col("last")).alias("last"))).alias("x"))
    last = stored(below.select("conv", F.col("parent").alias("branch"), (-F.col("x.last")).alias("last")), "quotes-last")
    while True:  # the last branch below each branch that has any
        onward = last.select("conv", F.col("branch").alias("last"), F.col("last").alias("next"))
        longer = last.join(onward, ["conv", "last"], "left")
        longer = stored(longer.select("conv", "branch", F.coalesce("next", "last").alias("last"), F.col("next").isNotNull().alias("moved")), "quotes-last")
        last = longer.select("conv", "branch", "last")
        if longer.filter("moved").isEmpty():
            break

    reached = last.select("conv", F.col("branch").alias("sibling"), "last")
    before = siblings.join(reached, ["conv", "sibling"], "left")
    before = before.select("conv", "branch", F.coalesce("last", "sibling", "parent").alias("before"))
    sizes = branches.select("conv", F.col("branch").alias("before"), F.col("rows").alias("start"))
    chain = branches.join(before, ["conv", "branch"], "left").join(sizes, ["conv", "before"], "left")
    chain = stored(chain.select("conv", "branch", "before", F.coalesce("start", F.lit(0)).alias("start")), "quotes-chain")
    while not chain.filter("before IS NOT NULL").isEmpty():
        onward = chain.select("conv", F.col("branch").alias("before"), F.col("before").alias("next"), F.col("start").alias("more"))
        longer = chain.join(onward, ["conv", "before"], "left")
        chain = stored(longer.select("conv", "branch", F.col("next").alias("before"), (F.col("start") + F.coalesce("more", F.lit(0))).alias("start")), "quotes-chain")
    return chain.select("conv", "branch", "start")


def thread(
    messages: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """Conversations in reply order, without quotes: one row per message.

    reply_to: the turn answered: the one quoted or else the one before; null for the first. branch: the
    turn at which the message's line of talk begins; a message that quotes another one than the message
    before begins a branch, the messages after it go on with it. position: place in the conversation when
    each message is followed by all that answers it, directly or not, earlier answers first. n_linked: quoted
    passages found in earlier messages; those not found are taken out of the text as well. An attribution
    line before a quote goes with it.

    Null or empty text: an empty message. Null conversation: a conversation of its own. A null turn comes
    first and takes no part in links. Repeated turns and rows are kept, ordered by role and text; they
    share the links of their turn. Other columns are ignored, whatever their names. Empty table: empty.
    """
    wanted = {"conv_id": conv_column, "turn": turn_column, "role": role_column, "text": text_column}
    parsed = stored(parse(messages.select(*[F.col(c).alias(k) for k, c in wanted.items()])), "quotes-parsed")
    turns = parsed.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("rows"))
    turns = turns.filter("turn IS NOT NULL").withColumn("__span", F.floor(F.col("turn") / SPAN))
    turns = ranks.running_max(turns, ["conv_id"], ["turn"], "__span", "turn", "__previous", before=True)
    links = _links(parsed).select(
        F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), "__source", "__found"
    )
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("turn") == F.col("__turn"))
    turns = turns.join(links, same, "left").drop("__conv", "__turn")
    begins = F.col("__previous").isNull() | (F.col("__source") != F.col("__previous"))
    turns = turns.withColumn("__begin", F.when(begins, F.col("turn")))
    turns = ranks.running_max(turns, ["conv_id"], ["turn"], "__span", "__begin", "branch")
    turns = stored(turns.select(
        F.struct("conv_id").alias("conv"), "turn", "branch", "rows", F.when(begins, F.col("__source")).alias("source"),
        F.coalesce("__source", "__previous").alias("reply_to"), F.coalesce("__found", F.lit(0)).cast("bigint").alias("n_linked"),
    ), "quotes-turns")
    loose = parsed.filter("turn IS NULL").groupBy(F.struct("conv_id").alias("conv")).agg(F.count(F.lit(1)).alias("loose"))
    known = turns.join(_starts(turns), ["conv", "branch"]).join(loose, "conv", "left")
    known = known.select(
        F.col("conv").alias("__conv"), F.col("turn").alias("__turn"), "branch", "reply_to", "n_linked",
        (F.col("start") + F.coalesce("loose", F.lit(0))).alias("__start"),
    )
    joined = parsed.drop("__passages").withColumn("conv", F.struct("conv_id"))
    joined = joined.join(known, (F.col("conv") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left")
    joined = joined.withColumn("__one", F.lit(1).cast("bigint")).drop("__conv", "__turn")
    # rows without a turn are dealt by a hash, as any number of them may share a conversation
    some = F.pmod(F.xxhash64("role", "text"), F.lit(SPAN)) - (1 << 62)
    joined = joined.withColumn("__span", F.coalesce(F.floor(F.col("turn") / SPAN), some))
    joined = joined.withColumn("__hash", F.when(F.col("turn").isNull(), F.xxhash64("role", "text")))
    order = [F.col("turn").asc_nulls_first(), "__hash", "role", "text"]
    placed = ranks.running_sum(joined, ["conv", "branch"], order, "__span", "__one", "__place")
    return placed.select(
        F.col("conv_id").alias(conv_column), F.col("turn").alias(turn_column), F.col("role").alias(role_column), "reply_to",
        "branch", (F.coalesce("__start", F.lit(0)) + F.col("__place") - 1).alias("position"),
        F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"), F.col("__own").alias("text"),
    )
