"""Exact ranks and order statistics of groups of any size (WIN9, SRT2, SRT5, MLP1, AGG10, OUT3, OUT4).

Neither gathers a group in a task. Ranks come from a range-partitioned sort, with one offset for each part
of a group. Percentiles come from brackets around the wanted ranks that are narrowed pass by pass: a sketch
proposes tighter ones, exact counts decide, and only the last few values of a bracket are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.scalars import null_if_nan
from panelwright.session import materialise

GRID = 256  # steps of a sketch: a pass keeps about three of them
LOCAL = 4096  # values of a bracket that are sorted at once
ROW_BITS = (1 << 33) - 1  # the part of a monotonically increasing id that counts a partition's rows


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equal keys; nulls are equal."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    return out


def exact_ranks(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], to: str = "rank") -> DataFrame:
    """Place of each row in its group, from 1, in a total order.

    Rows are dealt by ranges of (group, order) and sorted, so a group of any size lies in neighbouring parts;
    what a row's place adds to its place in the part is the number of the group's rows in the parts before, a
    table of one row per group and part. Runs jobs at once: the sorted rows are written.
    """
    group = list(group)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(f"`{c}`") for c in group], *order]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    ranged = materialise(ranged.select("*", F.spark_partition_id().alias("__part"), row.alias("__row")), "ranks")
    names = [f"__g{k}" for k in range(len(group))]
    spans = ranged.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(group, names, strict=True)], F.col("__part").alias("__p"))
    spans = spans.agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    spans = spans.select(*names, "__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__add"))
    found = ranged.join(spans, (F.col("__part") == F.col("__p")) & _same(group, names))
    return found.select(*[f"`{c}`" for c in df.columns], (F.col("__row") + F.col("__add")).alias(to))


def _grid_of(x: Column, inside: Column | None = None) -> Column:
    """GRID + 1 approximate quantiles as an array."""
    shares = F.expr("array(" + ", ".join(f"{k / GRID!r}D" for k in range(GRID + 1)) + ")")
    return F.percentile_approx(x if inside is None else F.when(inside, x), shares, 10 * GRID)


def _within(x: Column, low: Column, high: Column) -> Column:
    """Strictly between two bounds, of which a null one is none."""
    return (low.isNull() | (x > low)) & (high.isNull() | (x < high))


def percentiles(df: DataFrame, columns: Sequence[str], by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated percentiles: `by`, column, share, value, for each group with a value.

    All columns, shares and groups are narrowed in the same passes over the rows. A pass keeps, of the values
    between the bounds of a wanted rank, the few steps of a sketch around it and counts exactly what lies
    below and at the new bounds, so that one value that very many rows have is a bound and needs no further
    pass. Null and NaN values don't count. Runs jobs at once and writes its small tables of brackets.
    """
    by = list(by)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns]
    names = [f"__b{k}" for k in range(len(by))]
    keys = [*names, "column"]
    values = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True)], F.inline(F.array(*cells)))
    values = values.filter(null_if_nan("x").isNotNull())

    position = F.col("share") * (F.col("n") - 1)
    every = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _grid_of(F.col("x")).alias("grid"))
    every = materialise(every, "percentile-grids")
    wanted = every.select(*keys, "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    none = F.lit(None).cast("double")
    targets = wanted.select(*keys, F.explode(F.array(F.floor(position), F.ceil(position))).alias("k")).distinct()
    state = targets.join(every.withColumnsRenamed({n: f"_{n}" for n in keys}), _same(keys, [f"_{n}" for n in keys]))
    state = state.select(*keys, "k", none.alias("low"), none.alias("high"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), "grid", none.alias("value"))
    many = F.col("value").isNull() & (F.col("inside") > LOCAL)
    while not state.filter(many).isEmpty():
        state = _narrowed(values, keys, state)
        if state.filter(many).isEmpty():
            break
        sketched = _attached(values, state.filter("value IS NULL"), keys).filter(_within(F.col("x"), F.col("low"), F.col("high")))
        sketched = sketched.groupBy(*keys, "k").agg(_grid_of(F.col("x")).alias("grid"))
        renamed = sketched.withColumnsRenamed({n: f"_{n}" for n in [*keys, "k"]})
        state = state.drop("grid").join(renamed, _same([*keys, "k"], [f"_{n}" for n in [*keys, "k"]]), "left")
        state = materialise(state.select(*keys, "k", "low", "high", "below", "inside", "grid", "value"), "percentile-brackets")

    few = _attached(values, state.filter("value IS NULL"), keys).filter(_within(F.col("x"), F.col("low"), F.col("high")))
    few = few.groupBy(*keys, "k", "below").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # LOCAL values at most
    found = state.filter("value IS NOT NULL").select(*keys, "k", "value").unionByName(
        few.select(*keys, "k", F.get("xs", (F.col("k") - F.col("below")).cast("int")).alias("value"))
    )
    ends = wanted.select(*keys, "share", position.alias("at"), F.inline(F.array(
        F.struct(F.floor(position).alias("k"), F.lit(True).alias("first")), F.struct(F.ceil(position).alias("k"), F.lit(False).alias("first")))))
    other = found.withColumnsRenamed({n: f"_{n}" for n in [*keys, "k"]})
    picked = ends.join(other, _same([*keys, "k"], [f"_{n}" for n in [*keys, "k"]])).groupBy(*keys, "share", "at").agg(
        F.max(F.when(F.col("first"), F.col("value"))).alias("lo"), F.max(F.when(~F.col("first"), F.col("value"))).alias("hi")
    )
    part, width = F.col("at") - F.floor("at"), F.col("hi") - F.col("lo")
    # from the nearer end, as little is lost there between values of very unlike size
    value = F.when(part < 0.5, F.col("lo") + width * part).otherwise(F.col("hi") - width * (1 - part))
    return picked.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], "column", "share", value.alias("value"))


def _attached(values: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each value with the brackets of its group and column; a group's brackets are as many as its shares."""
    brackets = state.groupBy(*keys).agg(F.collect_list(F.struct("k", "low", "high", "below")).alias("__brackets"))
    brackets = brackets.withColumnsRenamed({n: f"_{n}" for n in keys})
    joined = values.join(brackets, _same(keys, [f"_{n}" for n in keys]))
    return joined.select(*keys, "x", F.inline("__brackets"))


def _narrowed(values: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """Brackets around the ranks by the steps of their sketch; a rank that falls on a bound has its value."""
    step = F.floor((F.col("k") - F.col("below") + 0.5) / F.col("inside") * GRID)
    low = F.get("grid", F.greatest(step - 1, F.lit(0)).cast("int"))
    high = F.get("grid", F.least(step + 2, F.lit(GRID)).cast("int"))
    tried = state.filter("value IS NULL").select(*keys, "k", "low", "high", "below", low.alias("to_low"), high.alias("to_high"))
    brackets = tried.groupBy(*keys).agg(F.collect_list(F.struct("k", "low", "high", "below", "to_low", "to_high")).alias("__brackets"))
    brackets = brackets.withColumnsRenamed({n: f"_{n}" for n in keys})
    rows = values.join(brackets, _same(keys, [f"_{n}" for n in keys])).select(*keys, "x", F.inline("__brackets"))
    x = F.col("x")
    rows = rows.filter(_within(x, F.col("low"), F.col("high")))
    counted = rows.groupBy(*keys, "k", "low", "high", "below", "to_low", "to_high").agg(
        F.count_if(x < F.col("to_low")).alias("less"), F.count_if(x == F.col("to_low")).alias("at_low"),
        F.count_if((x > F.col("to_low")) & (x < F.col("to_high"))).alias("between"),
        F.count_if((x == F.col("to_high")) & (x != F.col("to_low"))).alias("at_high"), F.count_if(x > F.col("to_high")).alias("more"),
    )
    rank = F.col("k") - F.col("below")
    edges = [F.lit(0)]
    for c in ("less", "at_low", "between", "at_high", "more"):
        edges.append(edges[-1] + F.col(c))
    place = F.lit(4)
    for k in (3, 2, 1, 0):
        place = F.when(rank < edges[k + 1], k).otherwise(place)
    counted = counted.withColumn("__place", place)

    def chosen(less: Column, between: Column, more: Column) -> Column:
        at = F.col("__place")
        return F.when(at == 0, less).when(at == 2, between).when(at == 4, more)

    after = F.col("below") + chosen(edges[0], edges[2], edges[4])
    moved = counted.select(
        *keys, "k",
        chosen(F.col("low"), F.col("to_low"), F.col("to_high")).alias("low"),
        chosen(F.col("to_low"), F.col("to_high"), F.col("high")).alias("high"),
        after.cast("bigint").alias("below"), chosen(F.col("less"), F.col("between"), F.col("more")).alias("inside"),
        F.lit(None).cast("array<double>").alias("grid"),
        F.when(F.col("__place") == 1, F.col("to_low")).when(F.col("__place") == 3, F.col("to_high")).alias("value"),
    )
    done = state.filter("value IS NOT NULL").withColumn("grid", F.lit(None).cast("array<double>"))
    return materialise(done.unionByName(moved), "percentile-brackets")
