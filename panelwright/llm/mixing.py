"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import ranks
from panelwright.llm.stored import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3  # a source, and so each document, is taken at most so often
KEY_DIGITS = 3  # hexadecimal digits of a document's hash that cut a source into buckets
STEPS = 4096  # buckets of virtual time between 0 and 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], repeats: int) -> DataFrame:
    """Target of each source: by weight, at most `repeats` times its size, the excess dealt on by weight.

    sizes: one row per source with its size. Sources take the weights in turn, by code point, null
    last. With sources in the order in which they reach their limit, the level at which no further
    one does is the share of a unit of weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    shares = sizes.select("source", "source_size", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")).alias("w"))
    shares = shares.withColumn("limit", F.col("source_size") * F.lit(float(repeats)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    rest = F.sum("source_size").over(everything) - F.coalesce(
        F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    left = F.sum("w").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    levels = shares.withColumn("level", rest / left).withColumn("order", F.row_number().over(by_limit))
    free = F.min_by("level", F.when(F.col("level") <= F.col("limit") / F.col("w"), F.col("order"))).over(everything)
    level = F.coalesce(free, F.lit(0.0))
    return levels.select("source", "source_size", F.least("limit", level * F.col("w")).alias("target"))


def _queue(sized: DataFrame, weights: Sequence[float], repeats: int) -> DataFrame:
    """Each row with its source's size and target and the words of its source up to it."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources, weights, repeats).withColumnRenamed("source", "__source")
    ordered = sized.withColumn("__bucket", F.substring("__key", 1, KEY_DIGITS))
    ordered = ranks.running_sum(ordered, ["source"], ["__key", "size", "__tie"], "__bucket", "size", "__words")
    return ordered.join(goals, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "__bucket")


def _times(repeats: int) -> Column:
    """Virtual finish times of a document's first, second, ... copy; null where nothing is wanted."""
    wanted = F.when((F.col("target") > 0) & (F.col("size") > 0), F.col("target"))
    return F.array(*[(F.col("source_size") * F.lit(k) + F.col("__words")) / wanted for k in range(repeats)])


def _cutoff(queue: DataFrame, repeats: int) -> Column:
    """The last virtual time at which all copies so far still fit the total budget."""
    budget = queue.agg(F.sum("size").alias("budget")).scalar()
    time = F.col("time")
    copies = queue.select("size", F.explode(_times(repeats)).alias("time")).filter(time.isNotNull())
    far = F.floor(F.log(time) * 1000) + 4 * STEPS
    copies = copies.withColumn("step", F.when(time < 4, F.floor(time * STEPS)).otherwise(far))
    sums = copies.groupBy("step").agg(F.sum("size").alias("sum"))
    through = F.sum("sum").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    steps = sums.withColumn("through", through).withColumn("budget", budget)
    last = steps.filter(F.col("through") > F.col("budget")).agg(F.min("step")).scalar()
    before = steps.filter(F.col("through") <= F.col("budget")).agg(F.coalesce(F.max("through"), F.lit(0))).scalar()
    crossing = copies.filter(F.col("step") == last)  # the range of times in which the budget runs out
    crossing = crossing.withColumn("upto", F.sum("size").over(Window.partitionBy("step").orderBy("time")))
    inside = crossing.filter(F.col("upto") + before <= budget).agg(F.max("time"))
    whole = copies.filter(F.col("step") < F.coalesce(last, F.lit(1 << 62))).agg(F.max("time"))
    return F.greatest(inside.scalar(), whole.scalar())


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """How many words of each document a mix to target weights takes.

    Every source is shuffled by a hash of the id. A copy's virtual finish time is the words of its
    source up to and with it, over the source's target; all copies are ranged by that time and cut
    where the total of all sizes is reached, so every source stops near its target. Sums run over
    buckets (see ranks), so a hot source is shared among tasks. Same input, same result.

    Null text or one without words: size 0, nothing taken. A null source is a source, the last. Null ids
    and repeated rows: each row counts by itself; rows equal in id and text are interchangeable. Copies
    that end at the same virtual time are taken together or not at all. Other columns are ignored,
    whatever their names. Empty table: empty result.
    """
    sized = stored(_sized(docs, id_column, text_column, source_column), "mix-sizes")
    queue = stored(_queue(sized, weights, repeats), "mix-queue")
    taken = F.size(F.filter(_times(repeats), lambda t: t <= F.col("__cut")))
    return queue.withColumn("__cut", _cutoff(queue, repeats)).select(
        F.col("id").alias(id_column), "source", "size", "source_size", "target",
        (F.col("size") * taken).cast("bigint").alias("taken"), F.col("__tie"), taken.alias("__copies"),
    )


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))).alias("__key"),
        F.xxhash64(text_column).alias("__tie"),
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, each as often as it is taken; columns as in `docs`.

    Rows equal in id, source and text share their copies, dealt one after the other.
    """
    names = {k: options.get(k, v) for k, v in (("id_column", "doc_id"), ("text_column", "text"), ("source_column", "source"))}
    found = mix(docs, **options).groupBy(F.col(names["id_column"]).alias("__id"), F.col("source").alias("__source"), "__tie").agg(
        F.sum("__copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")
    )
    keyed = docs.withColumn("__text", F.xxhash64(names["text_column"]))
    same = keyed[names["id_column"]].eqNullSafe(found["__id"]) & keyed[names["source_column"]].eqNullSafe(found["__source"])
    joined = keyed.join(found.filter("__copies > 0"), same & (keyed["__text"] == found["__tie"]))
    single = joined.filter("__rows = 1").withColumn("__n", F.col("__copies"))
    group = Window.partitionBy("__id", "__source", "__text").orderBy(F.lit(0))
    place = F.row_number().over(group) - 1
    several = joined.filter("__rows > 1").withColumn("__n", F.floor((F.col("__copies") + F.col("__rows") - 1 - place) / F.col("__rows")))
    repeated = F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))
    return single.unionByName(several.filter("__n > 0")).withColumn("__copy", repeated).select(docs.columns)


# The rows of the query op4 in DuckDB.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), shares AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
         source_size * 3.0::DOUBLE AS lim FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS ord
  FROM shares WINDOW o AS (ORDER BY lim / w, source NULLS LAST)
), goals AS (
  SELECT source, source_size, least(lim, w * (SELECT min_by(level, ord) FROM levels WHERE level <= lim / w)) AS target FROM levels
), queue AS (
  SELECT s.*, g.source_size, g.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.size, s.doc_id ROWS UNBOUNDED PRECEDING) AS words
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT doc_id, size, (source_size * e + words) / target AS t FROM queue, (VALUES (0), (1), (2)) x(e) WHERE target > 0 AND size > 0
), upto AS (SELECT *, sum(size) OVER (ORDER BY t) AS total FROM copies
), chosen AS (
  SELECT doc_id, sum(size) AS taken FROM upto WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(c.taken, 0) AS BIGINT) AS taken
FROM queue q LEFT JOIN chosen c USING (doc_id)
"""
