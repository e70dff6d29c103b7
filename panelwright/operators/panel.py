"""Reshaping: two-sided records to sides, sparse facts to a complete panel, de-duplication (RSH*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright import fixed_values as fixed
from panelwright.functions.scalars import falsy_default
from panelwright.functions.windows import rank_in_group

CALENDAR_BYTES = 4 << 20  # of a calendar that each task holds
PANEL_ROWS = 1 << 17  # of a panel in a task, on average: windows over its features hold a few hundred MB
_WIDTHS = {"byte": 1, "short": 2, "integer": 4, "long": 8, "date": 4, "timestamp": 8}


def mirror_sides(
    fixtures: DataFrame,
    pairs: Mapping[str, tuple[str, str]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Each two-sided record as two rows, the own and the other side's value next to each other.

    pairs maps a name to its (home column, away column); the result has `name` and `opp_name`
    plus is_home. One pass over the records, no self-join (JOI15).
    """

    def side(home: bool) -> Column:
        fields = []
        for name, (h, a) in pairs.items():
            own, other = (h, a) if home else (a, h)
            fields += [F.col(own).alias(name), F.col(other).alias(f"opp_{name}")]
        return F.struct(*fields, F.lit(1.0 if home else 0.0).alias("is_home"))

    return fixtures.select(*keep, F.inline(F.array(side(True), side(False))))


def unpivot_sides(
    fixtures: DataFrame, period: str = "event", keep: Sequence[str] = (), defaults: bool = True
) -> DataFrame:
    """One row per team and match: team, opponent, fdr, is_home, score_for, score_ag (RSH1).

    With defaults an absent or zero difficulty is neutral and an absent score is 0.
    """
    sides = mirror_sides(
        fixtures,
        {
            "team": ("team_h", "team_a"),
            "fdr": ("team_h_difficulty", "team_a_difficulty"),
            "score": ("team_h_score", "team_a_score"),
        },
        keep=[period, *keep],
    )
    fdr, own, other = (F.col(c).cast("double") for c in ("fdr", "score", "opp_score"))
    if defaults:
        fdr = falsy_default("fdr", fixed.NEUTRAL_DIFFICULTY)
        own, other = falsy_default("score", 0), falsy_default("opp_score", 0)
    return sides.select(
        period,
        *keep,
        "team",
        F.col("opp_team").alias("opponent"),
        fdr.alias("fdr"),
        "is_home",
        own.alias("score_for"),
        other.alias("score_ag"),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in an explicit total order (RSH3, RSH4).

    The rank filter becomes a WindowGroupLimit, so every task keeps one row per key before the
    shuffle and a hot key does not gather its copies anywhere.
    """
    rank = rank_in_group(list(keys), list(order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def grid(ids: DataFrame, periods: DataFrame, entity: str, period: str = "event", parts: int | None = None) -> DataFrame:
    """Every entity with every period (JOI14), for calendars of any length; dealt by entity to `parts` tasks, if given.

    The periods are counted first. A calendar of up to CALENDAR_BYTES, as good as any, is an array that each
    entity row explodes where it is: no join, and the result is partitioned by entity as the ids are. A longer
    one is copied once per bucket of entities, by a join on the bucket that spills like any other, and the
    pairs, two narrow columns, are then dealt by entity.
    """
    entities, days = _distinct(ids, entity), _distinct(periods, period)
    width = _WIDTHS.get(days.schema[period].dataType.typeName(), 64)
    if days.count() * width > CALENDAR_BYTES:
        pairs = replicated_grid(ids, periods, entity, period)
        return pairs.repartition(parts, entity) if parts else pairs.repartition(entity)
    entities = entities.repartition(parts, entity) if parts else entities
    return entities.select(entity, F.explode(days.agg(F.array_sort(F.collect_list(period))).scalar()).alias(period))


def replicated_grid(ids: DataFrame, periods: DataFrame, entity: str, period: str = "event") -> DataFrame:
    """Every entity with every period, by a copy of the periods for each bucket of entities."""
    buckets = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = _distinct(ids, entity).withColumn("__bucket", F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int"))
    copies = _distinct(periods, period).withColumn("__bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return mine.join(copies, "__bucket").drop("__bucket")


def panel_parts(ids: DataFrame, periods: DataFrame, entity: str, period: str = "event") -> int:
    """Tasks for a panel, so that each has PANEL_ROWS of its rows on average.

    The rows are counted before: Spark sizes tasks by the bytes it shuffles, which are those of the ids alone.
    """
    rows = _distinct(ids, entity).count() * _distinct(periods, period).count()
    least = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with fewer, later joins would deal the panel again
    return max(least, -(-rows // PANEL_ROWS))


def _distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def complete_panel(
    ids: DataFrame,
    periods: DataFrame,
    facts: DataFrame,
    entity: str = "player_id",
    period: str = "event",
    stats: Sequence[str] | None = None,
    fills: Mapping[str, float] | None = None,
) -> DataFrame:
    """Dense entity x period panel with defaults in the gaps (RSH2).

    facts must have one row per (entity, period). Unlisted fills are 0.

    Only ids and the sparse facts are shuffled, by entity, to so many tasks as the panel's rows ask for; the grid is exploded after that, where
    it stays (of a very long calendar also the pairs of entity and period, see grid). Grid rows and facts are put next to each other by one sort on (entity, period), and
    each grid row takes the fact right before it. The result is partitioned by entity and sorted,
    so windows over the entity's periods need neither another exchange nor another sort.
    """
    stats = list(stats) if stats is not None else [
        c for c in facts.columns if c not in (entity, period)
    ]
    defaults = {s: 0.0 for s in stats} | dict(fills or {})
    kinds = dict(facts.dtypes)
    parts = panel_parts(ids, periods, entity, period)
    skeleton = grid(ids, periods, entity, period, parts)
    empty = [F.lit(None).cast(kinds[s]).alias(s) for s in stats]
    wanted = skeleton.select(entity, period, F.lit(1).alias("__grid"), *empty)
    known = facts.repartition(parts, entity).select(entity, period, F.lit(0).alias("__grid"), *stats)
    spec = Window.partitionBy(entity).orderBy(period, "__grid")
    before = {f"__{s}": F.lag(s).over(spec) for s in stats}
    found = (F.lag("__grid").over(spec) == 0) & (F.lag(period).over(spec) == F.col(period))
    paired = wanted.unionByName(known).select(
        entity, period, "__grid", found.alias("__found"), *[c.alias(n) for n, c in before.items()]
    )
    return paired.filter("__grid = 1").select(
        entity,
        period,
        *[
            F.coalesce(F.when(F.col("__found"), F.col(f"__{s}")), F.lit(defaults[s])).alias(s)
            for s in stats
        ],
    )
